"""Sources, sinks and streams of tape."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import sequence
from tapeloom.sources import tape
from tapeloom.streaming import tape as streams


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lines_records_and_days(spark, tmp_path):
    (tmp_path / "books" / "dt=2026-06-03").mkdir(parents=True)
    (tmp_path / "books" / "dt=2026-06-01.jsonl").write_text('{"a":1,"schema_version":"v1"}\n\n  \n{"a":"x","schema_version":"v0"}\n[1]\n{cut\n')
    with gzip.open(tmp_path / "books" / "dt=2026-06-02.jsonl.gz", "wt") as f:
        f.write('{"a":3,"schema_version":"v1"}\n')
    (tmp_path / "books" / "notes.txt").write_text("x")
    read = tape.lines(spark, f"file://{tmp_path}")
    assert rows(tape.days(read)) == [("books", "2026-06-01"), ("books", "2026-06-02")]
    typed = tape.records(read, "a int, schema_version string")
    assert typed.count() == 5 and typed.where("bad").count() == 3
    assert rows(tape.records(read, "a int, schema_version string", "v1").select("a")) == [(1,), (3,)]


def test_append_and_roll_up(spark, tmp_path):
    df = spark.sql("select 2 as b, cast(null as string) as a, timestamp_ntz'2026-06-01 23:59:59' as t union all select 3, 'x', timestamp_ntz'2026-06-02 00:00:00'")
    tape.append(df, f"file://{tmp_path}", "fam", "t")
    tape.append(df.where("false"), f"file://{tmp_path}", "fam", "t")
    text = spark.read.text(f"file://{tmp_path}/fam").select("value", F.col("dt").cast("string"))
    assert {(json.loads(v)["b"], d) for v, d in rows(text)} == {(2, "2026-06-01"), (3, "2026-06-02")}
    assert all(v.startswith('{"a":') for v, _ in rows(text)) and any('"a":null' in v for v, _ in rows(text))
    out = f"file://{tmp_path}/daily"
    day = lambda *r: spark.createDataFrame(r, "d string, n int")
    tape.roll_up(spark, day(("x", 1)), out, "d")
    tape.roll_up(spark, day(("x", 9), ("y", 2)), out, "d")
    assert rows(spark.read.parquet(out).select("n")) == [(1,), (2,)]
    tape.roll_up(spark, day(("x", 9)), out, "d", force=True)
    assert rows(spark.read.parquet(out).select("n")) == [(2,), (9,)]


def test_what_is_appended_is_read_again(spark, tmp_path):
    df = spark.sql("select 2 as b, timestamp_ntz'2026-06-01 23:59:59.999999' as t union all select 3, timestamp_ntz'2026-06-02 00:00:00' union all select 4, null")
    for k, compression in enumerate(("none", "gzip")):
        tape.append(df, f"file://{tmp_path}", f"fam{k}", "t", compression)
    tape.append(df.where("b = 3"), f"file://{tmp_path}", "fam1", "t")
    read = tape.lines(spark, f"file://{tmp_path}")
    got = rows(read.select("family", "dt", "file_name", F.get_json_object("line", "$.b")))
    two, three = ("2026-06-01", "dt=2026-06-01.jsonl", "2"), ("2026-06-02", "dt=2026-06-02.jsonl", "3")
    assert got == sorted((f, d, f"{f}/{n}", b) for f, (d, n, b) in [("fam0", two), ("fam0", three), ("fam1", two), ("fam1", three), ("fam1", three)])
    assert list((tmp_path / "fam1").rglob("*.gz"))


def test_a_stream_s_lines_are_read_again(spark, tmp_path):
    schema = "b int, t timestamp"
    at = lambda d, h: dt.datetime(2026, 6, d, h)
    s = stream(spark, tmp_path, [[(1, at(1, 5)), (2, at(2, 5))], [(3, at(1, 9)), (4, None)]], schema)
    for _ in range(2):
        streams.append_lines(s, f"file://{tmp_path}/tape", "fam", "t", f"file://{tmp_path}/state").awaitTermination()
    got = rows(tape.lines(spark, f"file://{tmp_path}/tape").select("dt", F.get_json_object("line", "$.b")))
    assert got == [("2026-06-01", "1"), ("2026-06-01", "3"), ("2026-06-02", "2")]


def test_canonical_bytes(spark):
    values = [
        {"b": "é \U0001f600 \"\\\n\u2028", "a": 1e-05, "n": None, "s": {"z": 1, "a": [1.5, 1e16, 123456789.0, 0.0001, 2.0]}},
        {"b": "", "a": -0.0, "n": 7, "s": {"z": None, "a": []}}, {"b": None, "a": 1e22, "n": -1, "s": None},
    ]
    df = spark.createDataFrame(values, "b string, a double, n bigint, s struct<z: int, a: array<double>>")
    want = [json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values]
    assert [r.c for r in df.select(tape.canonical(["s", "b", "n", "a"]).alias("c")).collect()] == want
    assert rows(df.where("false").select(tape.canonical(["b"]))) == []


def test_tagged_records_and_unknown_kinds(spark):
    orders, fills = spark.createDataFrame([("o1", 5), ("o2", None)], "order_id string, qty int"), spark.createDataFrame([("f1", 0.5)], "fill_id string, price double")
    ledger = tape.tagged({"order": orders, "fill": fills})
    kinds = {"order": "order_id string, qty int", "fill": "fill_id string, price double"}
    back = tape.untagged(ledger, kinds)
    assert rows(back["order"]) == rows(orders) and rows(back["fill"]) == rows(fills)
    with pytest.raises(Exception, match="unknown kind of record: fill"):
        tape.untagged(ledger, {"order": kinds["order"]})["order"].collect()


def test_pages_follow_their_cursors(spark, tmp_path):
    for series in ("a", "b"):
        (tmp_path / series).mkdir()
        for n, cursor in enumerate(("1", "2", "")):
            (tmp_path / series / f"page-{n}.json").write_text(json.dumps({"cursor": cursor, "records": [{"n": n, "s": series}] * 2}))
    spark.dataSource.register(tape.Pages)
    assert spark.read.format("pages").load(str(tmp_path)).count() == 12
    cut = spark.read.format("pages").option("maxPages", 2).load(str(tmp_path))
    assert cut.count() == 8 and cut.where("truncated").count() == 2


def stream(spark, path, batches, schema):
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"file://{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}/in")


def test_stream_gaps_equal_the_batch_twin(spark, tmp_path):
    schema = "market string, t bigint, seq bigint, is_snapshot boolean"
    batches = [[("m", 1, 10, True), ("m", 2, 11, False), ("n", 1, 5, False)], [("m", 3, 14, False), ("m", 4, 15, None), ("n", 2, 3, True), (None, 1, 1, False)]]
    got = streams.replayed(streams.sequence_gaps(stream(spark, tmp_path, batches, schema)), f"file://{tmp_path}", streams.GAPS)
    assert rows(got) == [("m", 3, 12, 14, 2)]
    whole = spark.createDataFrame([r for b in batches for r in b], schema).where("market is not null")
    assert rows(sequence.sequence_gaps(whole, ["market"], ["t"], "seq", F.coalesce("is_snapshot", F.lit(False)))) == rows(got)


def test_stream_appends_once(spark, tmp_path):
    schema = "k string, v int"
    s = stream(spark, tmp_path, [[("a", 1), ("b", 1)], [("b", 2), ("c", 2), ("c", 3)]], schema)
    for _ in range(2):
        streams.append_once(s, ["k"], f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert rows(streams.committed(spark, f"file://{tmp_path}/out").select("k")) == [("a",), ("b",), ("c",)]


def test_stream_cadence_and_first_deliveries(spark, tmp_path):
    schema = "f string, at timestamp, c string"
    at = lambda m: dt.datetime(2026, 6, 1, 10, m)
    s = stream(spark, tmp_path, [[("x", at(1), "p"), ("x", at(1), "p"), ("x", at(2), "q")], [("x", at(30), "r")], [("x", at(50), "s")]], schema)
    got = streams.replayed(streams.cadence(s, "f", "at", "c", "10 minutes", "1 minute"), f"file://{tmp_path}/a")
    assert [(r.n_rows, r.n_captures) for r in got.orderBy("starts").collect()][:1] == [(3, 2)]
    once = streams.replayed(streams.first_deliveries(s, ["c"], "at", "1 hour"), f"file://{tmp_path}/b")
    assert rows(once.select("c")) == [("p",), ("q",), ("r",), ("s",)]


def test_times_are_utc_whatever_the_session_s_zone(spark, small):
    from tapeloom.functions import tickers
    from tapeloom.functions.times import iso_micros, micros
    from tapeloom.sources.tables import table

    def told():
        strings = spark.createDataFrame([(x,) for x in ("2026-03-08T02:30:00", "20260308T0230Z", "2026-03-08 02:30:00.5+01:00")], "v string")
        times = spark.sql("select timestamp_ntz'2026-03-08 02:30:00.000001' as a, timestamp_ntz'1969-12-31 23:59:59.5' as b, date'1970-01-02' as c, cast(null as timestamp_ntz) as d, timestamp'2026-03-08 02:30:00Z' as e")
        return (
            table(spark, small, "book_snapshots").agg(F.min(micros("ts_utc")), F.max(micros("ts_utc")), F.sum(F.pmod(micros("ts_utc"), F.lit(1000003)))).first(),
            [r[0] for r in strings.select(iso_micros("v")).collect()], tuple(times.select(*[micros(c) for c in "abcde"]).first()),
            spark.range(1).select(tickers.hour_token_micros(F.lit("26JUL0621"))).first()[0],
        )

    utc = told()
    assert utc[1] == [1772937000000000, 1772937000000000, 1772933400500000]
    assert utc[2] == (1772937000000001, -500000, 86400000000, None, 1772937000000000) and utc[3] == 1783386000000000
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert told() == utc and spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

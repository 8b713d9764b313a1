"""Queries p1 to p6: equal to their SQL twins, and defined results on awkward tables."""

from __future__ import annotations

import datetime as dt
import json
import random
from collections import Counter

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.functions.keys import hash_key, key
from tapeloom.functions.times import iso_micros
from tapeloom.operators import dedup, drift, grid, nested, orphans, pointintime
from tapeloom.plans import dealt

T0 = dt.datetime(2026, 6, 1, 10, 0, 0)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(dealt.SQL))
def test_equals_sql(spark, duck, small, name):
    assert oracle.compare(spark, duck, name, small) == ""


def test_iso_forms(spark):
    forms = {
        "20260602T004153Z": 1780360913000000, "2026-06-02T00:41:57.346079+00:00": 1780360917346079, "2026-06-02T02:30:27-04:00": 1780381827000000,
        "20260602T004153-0430": 1780377113000000, "2026-06-02T00:41Z": 1780360860000000, "2026-06-02T00:41:57,5+02": 1780353717500000,
        " 20260602t004153.25z ": 1780360913250000, "2026-13-02T00:41:00Z": None, "x": None, "": None,
        "2026": None, "2026-07-01": None, "T12:30": None, "12:30:00": None, "2026-06-02T00:41:61Z": None, "2026-06-02 00:41:00 +0100": 1780357260000000, "2026-06-02T00:41:00.1234567891": 1780360860123456,
    }
    got = spark.createDataFrame([(k,) for k in forms], "v string").select("v", iso_micros("v").alias("t")).collect()
    assert {r.v: r.t for r in got} == forms


# --- p1


GRID = "ticker string, ts_utc timestamp_ntz, value double, source string, slot bigint, n bigint"


def test_grid_marks_and_fills(spark):
    data = [("a ", at(0), 1.0), ("A", at(10), 3.0), ("A", at(1210), 4.0), (None, at(0), 1.0), (" ", at(0), 1.0), ("A", None, 1.0), ("b", at(0), None), ("b", at(900), None)]
    df = spark.createDataFrame([(*d, "clash", 7, 7) for d in data], GRID)
    got = rows(grid.regular_series(df, key("ticker"), "ts_utc", F.col("value")))
    epoch = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    a = [r for r in got if r[0] == "A"]
    assert [(r[1] - epoch, r[2], r[4]) for r in a] == [(0, 2, False), (300, 0, True), (600, 0, True), (900, 0, True), (1200, 1, False)]
    assert a[0][3] == 2.0 and a[4][3] == 4.0 and all(2 < r[3] < 4 and r[5] for r in a[1:4])
    b = [r for r in got if r[0] == "B"]
    assert [(r[3], r[4], r[5]) for r in b] == [(None, False, False), (None, True, False), (None, True, False), (None, False, False)]
    assert len(got) == len(a) + len(b)
    assert rows(grid.regular_series(df.where("false"), key("ticker"), "ts_utc", F.col("value"))) == []


def test_grid_days_are_apart_and_old_times_floor(spark):
    data = [("A", dt.datetime(2026, 6, 1, 23, 50)), ("A", dt.datetime(2026, 6, 2, 0, 10)), ("A", dt.datetime(1969, 12, 31, 23, 49, 59)), ("A", dt.datetime(1969, 12, 31, 23, 59, 59)), ("A", dt.datetime(9999, 1, 1))]
    df = spark.createDataFrame(data, "ticker string, ts_utc timestamp_ntz")
    got = rows(grid.regular_series(df, key("ticker"), "ts_utc", F.lit(1.0), only_missing=True))
    assert [r[1] for r in got] == [-600]


def test_singular_spectrum_restores_a_wave():
    t = np.arange(200)
    x = np.vstack([np.sin(t / 5), np.cos(t / 7) * 3 + 10])
    seen = np.random.default_rng(1).random(x.shape) > 0.3
    filled = grid.ssa_fill(np.where(seen, x, np.nan), seen)
    assert np.allclose(filled[seen], x[seen])
    assert np.abs(filled - x)[~seen].mean() < 0.05 * x.std()
    assert np.isnan(grid.ssa_fill(np.full((1, 5), np.nan), np.zeros((1, 5), bool))).all()
    assert np.allclose(grid.ssa_fill(np.array([[2.0, np.nan]]), np.array([[True, False]])), 2.0)


def test_imputation_goes_on_until_nothing_moves():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=(12, 60)), axis=1)
    seen = rng.random(x.shape) > 0.6
    seen[:, [0, -1]] = True
    x = np.where(seen, x, np.nan)
    filled, state = grid.ssa_impute(x, seen)
    assert (state == 1).all()
    for row, known in zip(filled, seen):  # one more round, written out
        at = np.arange(60)
        start = np.interp(at, at[known], row[known])
        z = row - start.mean()
        hankel = np.array([z[k : k + 45] for k in range(16)])
        u, s, v = np.linalg.svd(hankel, full_matrices=False)
        flat = (u[:, :3] * s[:3]) @ v[:3]
        mean = np.array([np.mean([flat[k, i - k] for k in range(16) if 0 <= i - k < 45]) for i in at])
        assert np.abs(mean - z)[~known].max() <= 2 * grid.TOLERANCE * start.std()
    assert (grid.ssa_impute(x, seen, iterations=1)[1] == 0).all()


def test_series_of_other_lengths_do_not_matter():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 2, 3, 4, 9, 31, 40])
    x = np.full((7, 40), np.nan)
    for i, n in enumerate(lengths):
        x[i, :n] = np.where(rng.random(n) < 0.7, rng.random(n), np.nan)
        x[i, [0, n - 1]] = 0.3, 0.5
    filled, state = grid.ssa_impute(x, ~np.isnan(x), iterations=300, lengths=lengths)
    for i, n in enumerate(lengths):
        alone, own = grid.ssa_impute(x[i : i + 1, :n], ~np.isnan(x[i : i + 1, :n]), iterations=300)
        assert np.allclose(alone[0], filled[i, :n]) and own[0] == state[i] and np.isnan(filled[i, n:]).all()


# --- p2


LINES = "file_name string, line_no int, line_id bigint, received_at timestamp_ntz, payload string, fields string, n int, stream string"


def lines(spark, files):
    out = []
    for name, payloads in files.items():
        for no, p in enumerate(payloads, 1):
            out.append((name, no, len(out), at(len(out)), p if p is None or isinstance(p, str) else json.dumps(p), "clash", 1, "clash"))
    return spark.createDataFrame(out, LINES)


def changes(spark, files):
    schemas = drift.file_schemas(drift.path_values(lines(spark, files)))
    return rows(drift.schema_changes(schemas).select("file_name", "field", "change", "new_field"))


def test_every_kind_of_change(spark):
    got = changes(spark, {
        "s/dt=2026-06-01.jsonl": [{"a": 1, "b": "x", "c": True, "o": 1}, {"a": 2, "b": "y", "c": None, "half": 1}, "{cut", "", None, "[1]", "3"],
        "s/dt=2026-06-02.jsonl": [{"a": "1", "bb": "x", "c": False, "d": []}, {"a": "2", "bb": None, "c": False, "d": [1]}],
        "s/dt=2026-06-03.jsonl": [{"a": "1", "c": False}],
        "t/dt=2026-06-01.jsonl": [{"z": 1}],
    })
    day = "s/dt=2026-06-0%d.jsonl"
    assert got == sorted([(day % 2, "a", "retyped", ""), (day % 2, "b", "renamed", "bb"), (day % 2, "d", "added", ""), (day % 3, "bb", "removed", ""), (day % 3, "d", "removed", "")], key=repr)


def test_drift_of_nothing_and_of_repeated_lines(spark):
    assert changes(spark, {}) == []
    df = lines(spark, {"s/dt=2026-06-01.jsonl": [{"a": 1}, {"a": 1, "b": 1}], "s/dt=2026-06-02.jsonl": [{"a": 1}]})
    twice = df.unionByName(df.withColumn("line_id", F.col("line_id") + 100).withColumn("received_at", F.lit(None).cast("timestamp_ntz")))
    values = drift.path_values(twice)
    assert rows(values.select("line_id")) == [(0,), (1,), (2,)]


def test_consistent_rows_follow_renames_and_report_casts(spark):
    values = drift.path_values(lines(spark, {
        "s/dt=2026-06-01.jsonl": [{"qty": 5, "event_ticker": "E", "x": [1]}],
        "s/dt=2026-06-02.jsonl": [{"contracts": "7", "event_ticker": {"t": "E"}}],
        "s/dt=2026-06-03.jsonl": [{"contracts": 8, "event_ticker": None}],
        "s/dt=2026-06-04.jsonl": [{"amount": 9}],
        "s/dt=2026-06-05.jsonl": [{"amount": "many"}],
    }))
    schemas = drift.file_schemas(values)
    table = drift.consistent_rows(values, schemas, drift.schema_changes(schemas), {"qty": "bigint", "event_ticker": "string"})
    got = {r.file_name[5:18]: r for r in table.collect()}
    assert [got[f"2026-06-0{d}.js"].qty for d in range(1, 6)] == [5, None, None, None, None]
    assert got["2026-06-01.js"].qty == 5 and got["2026-06-01.js"].rest == {"x": "[1]"}
    assert got["2026-06-02.js"].event_ticker == '{"t":"E"}'
    assert rows(drift.failed_casts(table)) == []


def test_rename_chain_keeps_the_first_name(spark):
    values = drift.path_values(lines(spark, {"s/dt=2026-06-01.jsonl": [{"qty": 1}], "s/dt=2026-06-02.jsonl": [{"contracts": 2}], "s/dt=2026-06-03.jsonl": [{"amount": "3x"}, {"amount": 4}, {"amount": 5}]}))
    schemas = drift.file_schemas(values)
    table = drift.consistent_rows(values, schemas, drift.schema_changes(schemas), {"qty": "bigint"})
    assert sorted((r.qty or 0, tuple(r.failed)) for r in table.collect()) == [(0, ("qty",)), (1, ()), (2, ()), (4, ()), (5, ())]
    assert rows(drift.failed_casts(table)) == [("s/dt=2026-06-03.jsonl", "qty", 1)]


def table_of(spark, files, target):
    values = drift.path_values(lines(spark, files))
    schemas = drift.file_schemas(values)
    return drift.consistent_rows(values, schemas, drift.schema_changes(schemas), target).orderBy("file_name", "line_no").collect()


DAY = "s/dt=2026-06-0%d.jsonl"


def test_a_name_that_is_removed_and_comes_back_is_read_as_itself(spark):
    got = table_of(spark, {
        DAY % 1: [{"qty": 1}], DAY % 2: [{"quantity": 2}], DAY % 3: [{"other": "x"}], DAY % 4: [{"qty": 4, "other": "x"}],
        DAY % 5: [{"amount": 5, "other": "x"}], DAY % 6: [{"amount": 6, "other": "x"}, {"amount": 7, "quantity": 8}],
    }, {"qty": "bigint"})
    assert [(r.qty, r.rest) for r in got] == [(1, {}), (2, {}), (None, {"other": '"x"'}), (4, {"other": '"x"'}), (5, {"other": '"x"'}), (6, {"other": '"x"'}), (7, {"quantity": "8"})]


def test_own_names_are_never_hidden_and_nothing_is_lost(spark):
    got = table_of(spark, {
        DAY % 1: [{"qty": 1, "tif": "a"}], DAY % 2: [{"quantity": 2}] * 4 + [{"quantity": 5, "qty": 7}, {"quantity": 6, "qty": None}, {"quantity": None, "qty": 8}],
        DAY % 3: [{"quantity": 3, "qty": 9}, {"quantity": 4, "qty": 9}], DAY % 4: [{"quantity": "many", "qty": [1]}],
    }, {"qty": "bigint", "tif": "string"})
    assert [(r.qty, r.rest, r.failed) for r in got] == [
        (1, {}, []), *[(2, {}, [])] * 4, (7, {"quantity": "5"}, []), (6, {"qty": "null"}, []), (8, {"quantity": "null"}, []),
        (9, {"quantity": "3"}, []), (9, {"quantity": "4"}, []), (None, {"quantity": '"many"', "qty": "[1]"}, ["qty"]),
    ]


def test_a_rename_to_another_target_s_name_fills_that_column(spark):
    got = table_of(spark, {DAY % 1: [{"a": 1}], DAY % 2: [{"b": 2}], DAY % 3: [{"x": 3}], DAY % 4: [{"a": 4}]}, {"a": "bigint", "b": "bigint"})
    assert [(r.a, r.b) for r in got] == [(1, None), (None, 2), (None, 3), (4, None)]


def test_paths_inside_of_objects(spark):
    files = {DAY % 1: [{"a": {"b": 1, "c.d": {"e": []}}, "o": {}, "z": None}], DAY % 2: [{"a": {"b": "1"}, "o": {}, "z": 1}]}
    values = drift.path_values(lines(spark, files), levels=3)
    assert [sorted(r.fields) for r in values.orderBy("file_name").collect()] == [["a.b", "a.c\\.d.e", "o", "z"], ["a.b", "o", "z"]]
    got = rows(drift.schema_changes(drift.file_schemas(values)).select("field", "change"))
    assert got == [("a.b", "retyped"), ("a.c\\.d.e", "removed")]
    assert [sorted(r.fields) for r in drift.path_values(lines(spark, files), levels=2).orderBy("file_name").collect()][0] == ["a.b", "a.c\\.d", "o", "z"]


# --- p3


def known(spark, facts, events):
    a = spark.createDataFrame(facts, "city string, e bigint, k bigint, id bigint, note string, entity string, t bigint, best int")
    b = spark.createDataFrame(events, "signal_id bigint, city string, at bigint, note string, version int")
    return pointintime.known_at(b, key("city"), F.col("at"), a, key("city"), F.col("e"), F.col("k"), "id", ["id", "note"])


def test_known_at_against_brute_force(spark):
    rng = random.Random(5)
    hour = 3_600_000_000
    facts = [(rng.choice(["a", "A ", "b", None, ""]), rng.choice([None, rng.randrange(5) * hour, rng.randrange(9)]), rng.choice([None, rng.randrange(6) * hour, rng.randrange(12)]), i, f"n{i}", "clash", 1, 1) for i in range(150)]
    events = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(7) * hour, rng.randrange(14)]), "clash", 1) for i in range(120)]
    want = []
    for s, city, t, _, _ in events:
        fit = [f for f in facts if city and f[0] and f[0].strip().upper() == city.upper() and None not in (t, f[1], f[2]) and f[1] <= t and f[2] <= t]
        if fit:
            best = max(fit, key=lambda f: (f[1], f[2], -f[3]))
            want.append((s, best[3], best[4]))
    got = known(spark, facts, events).select("signal_id", "id", "known_note")
    assert rows(got) == sorted(want, key=repr)
    assert rows(known(spark, facts, events[:0])) == [] and rows(known(spark, facts[:0], events)) == []


def test_repeated_events_each_get_their_row(spark):
    got = known(spark, [("a", 1, 1, 7, "x", "", 0, 0)], [(1, "a", 5, "n", 0)] * 2)
    assert rows(got.select("signal_id", "id")) == [(1, 7)] * 2


# --- p4


def test_orphans_of_every_kind(spark):
    children = spark.createDataFrame(
        [(1, "k1", at(10)), (2, " K1", at(1)), (3, "k2", at(10)), (4, "none", at(10)), (5, None, at(10)), (6, "  ", at(10)), (7, "k1", None), (8, "none", None), (9, "k3", at(0)), (10, "k2", at(4))],
        "row bigint, ref string, loaded_at timestamp_ntz",
    ).withColumn("key", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("period", F.lit("clash"))
    parents = spark.createDataFrame([("K1", at(5), None), ("k1 ", at(9), None), ("k2", at(1), None), ("k2", at(2), at(5)), ("k3", None, None), (None, at(0), None)], "ref string, listed timestamp_ntz, gone timestamp_ntz").withColumn("key", F.lit("clash"))

    def run(c, p, share=0.3):
        return rows(orphans.orphan_references(c, key("ref"), "row", "loaded_at", p, key("ref"), "listed", "gone", "t", share))

    want = [("t", 2, "2026-06-01", "late"), ("t", 3, "2026-06-01", "deleted"), ("t", 4, "2026-06-01", "missing"), ("t", 8, None, "missing")]
    assert run(children, parents) == run(children, parents, 0.9) == sorted(want, key=repr)
    assert run(children.where("false"), parents) == []
    assert {r[3] for r in run(children, parents.where("false"))} == {"missing"}


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_orphans_and_their_counts_against_brute_force(spark, share):
    rng = random.Random(12)
    when = lambda: rng.choice([None, *[at(3600 * h + m) for h in range(0, 60, 5) for m in (0, 1)]])
    child = [(i, rng.choice(["a", "a", "a", " A", "b", "c", "d", "e", "", None]), when()) for i in range(400)]
    parent = [(rng.choice("abcd"), when(), when()) for _ in range(9)]
    want = []
    for i, k, t in child:
        own = [p for p in parent if k and p[0] == k.strip().lower()]
        first, gone = (min((p[n] for p in own if p[n]), default=None) for n in (1, 2))
        kind = "missing" if not own else "late" if t and first and first > t else "deleted" if t and gone and gone <= t else None
        if k and kind:
            want.append(("t", i, t and t.strftime("%Y-%m-%d"), kind))
    c = spark.createDataFrame(child, "row bigint, ref string, loaded_at timestamp_ntz")
    p = spark.createDataFrame(parent, "ref string, listed timestamp_ntz, gone timestamp_ntz")
    args = (c, key("ref"), "row", "loaded_at", p, key("ref"), "listed", "gone", "t", share)
    assert rows(orphans.orphan_references(*args)) == sorted(want, key=repr)
    assert rows(orphans.orphan_counts(*args)) == sorted(((*k, n) for k, n in Counter((s, d, kind) for s, _, d, kind in want).items()), key=repr)
    assert rows(orphans.orphan_counts(c.where("false"), *args[1:])) == []


# --- p5


def deliveries(spark, data):
    return spark.createDataFrame([(*d, "clash", 1) for d in data], "delivery_id bigint, a string, b string, delivered_at timestamp_ntz, k1 string, code int")


def test_one_copy_of_each_message_over_batches(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, rng.choice(["x", " X", "y", None, ""]), rng.choice([f"sha256:{'a' * 64}", "A" * 64, "b" * 64, None, "short"]), rng.choice([None, at(rng.randrange(4))])) for i in range(200)]

    def kept_first(part, seen):
        first = {}
        for i, a, b, t in sorted(part, key=lambda r: (r[3] is None, r[3] or T0, r[0])):
            k = ((a or "").strip().upper() or None, (b or "")[-64:].lower() if b and len(b) >= 64 else None)
            if None not in k:
                first.setdefault(k, i)
        return {i for k, i in first.items() if k not in seen}, seen | set(first)

    store = dedup.SeenStore(spark, f"file://{tmp_path}/seen", shards=4)
    seen = set()
    for a, b in ((0, 7), (7, 120), (120, 120), (120, 200)):
        part = data[a:b]
        want, seen = kept_first(part, seen)
        got = store.ingest(deliveries(spark, part), key("a"), hash_key("b"), F.struct(F.col("delivered_at").isNull().alias("n"), F.col("delivered_at").alias("t")), "delivery_id")
        assert {r.row_id for r in got.collect()} == want
    assert store.versions() == [1, 2, 3, 4]
    bits = store.bitmaps().agg(F.sum(F.bitmap_count("bits"))).first()[0]
    assert bits == store.dictionary().count() == len(seen)


def test_repeated_and_deduplicated(spark):
    data = [(1, "x", "a" * 64, at(5)), (2, "x", "a" * 64, at(1)), (3, "x", "a" * 64, at(1)), (4, None, "a" * 64, at(1)), (5, None, "a" * 64, at(1)), (6, "x", None, at(1))]
    df = deliveries(spark, data)
    args = (key("a"), hash_key("b"), "delivered_at", "delivery_id")
    assert rows(dedup.repeated(df, *args)) == [(1,), (3,)]
    assert sorted(r.delivery_id for r in dedup.deduplicated(df, *args).collect()) == [2, 4, 5, 6]
    assert rows(dedup.repeated(df.where("false"), *args)) == []


def arrived():
    return F.struct(F.col("delivered_at").isNull().alias("n"), F.col("delivered_at").alias("t"))


def test_a_second_writer_leaves_the_first_one_s_bytes_alone(spark, tmp_path):
    path = f"file://{tmp_path}/seen"
    winner, loser = dedup.SeenStore(spark, path), dedup.SeenStore(spark, path)
    first = loser.snapshot()  # what the loser starts from
    batch = lambda names: deliveries(spark, [(i, n, "a" * 64, at(i)) for i, n in enumerate(names)])
    winner.ingest(batch(["x", "y", "z"]), key("a"), hash_key("b"), arrived(), "delivery_id")
    files = {p: p.read_bytes() for p in (tmp_path / "seen").rglob("*") if p.is_file()}
    loser.snapshot = lambda: first
    with pytest.raises(RuntimeError):
        loser.ingest(batch(["x", "p", "q", "r"]), key("a"), hash_key("b"), arrived(), "delivery_id")
    assert all(p.read_bytes() == b for p, b in files.items())
    again = dedup.SeenStore(spark, path)
    assert again.versions() == [1] and [r[0] for r in rows(again.dictionary())] == ["X", "Y", "Z"]
    with pytest.raises(RuntimeError):
        again._publish(1)


def test_the_number_of_shards_is_stored(spark, tmp_path):
    path = f"file://{tmp_path}/seen"
    data = deliveries(spark, [(i, f"m{i}", "a" * 64, at(i)) for i in range(50)])
    dedup.SeenStore(spark, path, shards=64).ingest(data, key("a"), hash_key("b"), arrived(), "delivery_id")
    with pytest.raises(ValueError):
        dedup.SeenStore(spark, path, shards=80)
    again = dedup.SeenStore(spark, path)
    assert again.shards == 64 and rows(again.ingest(data, key("a"), hash_key("b"), arrived(), "delivery_id")) == []


def test_the_bit_decides_and_not_the_dictionary(spark, tmp_path):
    store = dedup.SeenStore(spark, f"file://{tmp_path}/seen", shards=3)
    ids = spark.createDataFrame([(f"m{i}", "x", i) for i in range(20)], "k1 string, k2 string, row_id bigint")
    coded = store.encode(ids)
    assert store.dictionary().count() == 20 and store.bitmaps().count() == 0
    some = coded.where("row_id < 7")
    assert {r.row_id for r in store.accept(some).collect()} == set(range(7))
    assert {r.row_id for r in store.accept(coded).collect()} == set(range(7, 20))
    assert rows(store.accept(store.encode(ids))) == []


def test_folding_the_bitmaps_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "FOLD_AT", 2)
    store = dedup.SeenStore(spark, f"file://{tmp_path}/seen", shards=2)
    kept = []
    for n in (3, 5, 9, 9, 12):
        got = store.ingest(deliveries(spark, [(i, f"m{i}", "a" * 64, at(i)) for i in range(n)]), key("a"), hash_key("b"), arrived(), "delivery_id")
        kept.append(sorted(r.row_id for r in got.collect()))
    assert kept == [[0, 1, 2], [3, 4], [5, 6, 7, 8], [], [9, 10, 11]] and len(store.snapshot().bitmaps) <= 2


def test_slices_do_not_matter_and_a_store_remembers(spark, tmp_path):
    rng = random.Random(9)
    data = [(i, rng.choice(["x", "y", "z", None]), rng.choice(["a" * 64, "b" * 64]), rng.choice([None, *map(at, range(9))])) for i in range(150)]
    df, args = deliveries(spark, data), (key("a"), hash_key("b"), "delivered_at", "delivery_id")
    whole = rows(dedup.repeated(df, *args, slices=1))
    assert whole == rows(dedup.repeated(df, *args)) == rows(dedup.repeated(df, *args, slices=7)) and len(whole) > 100
    store = dedup.SeenStore(spark, f"file://{tmp_path}/seen")
    assert rows(dedup.repeated(df, *args, store)) == whole
    assert len(rows(dedup.repeated(df, *args, store))) == sum(d[1] is not None for d in data)


# --- p6


def tree(value, parent=None, field=None, place=None):
    """Rows of json_nodes without node numbers: (depth-first) (field, place, type, text)."""
    if isinstance(value, dict):
        yield (field, place, "object", None)
        for k, v in value.items():
            yield from tree(v, None, k, None)
    elif isinstance(value, list):
        yield (field, place, "array", None)
        for i, v in enumerate(value, 1):
            yield from tree(v, None, None, i)
    elif isinstance(value, str):
        yield (field, place, "string", value)
    else:
        yield (field, place, "scalar", json.dumps(value))


def index(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["row_id", "payload"])
    out = {}
    for b in nested._nodes(iter([batch])):
        for r in b.to_pylist():
            out.setdefault(r["row_id"], []).append(r)
    return out


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(JSON, st.booleans(), st.sampled_from([None, 1])), min_size=1, max_size=6), st.randoms())
def test_structural_index_equals_a_parser(values, rnd):
    texts = []
    for v, ascii_only, indent in values:
        t = json.dumps(v, ensure_ascii=ascii_only, indent=indent)
        if rnd.random() < 0.4 and len(t) > 1:  # damage it
            k = rnd.randrange(len(t))
            t = t[:k] + rnd.choice(["", "{", "]", ",", '"', ":", "\\", "x", "0"]) + t[k + rnd.randrange(2) :]
        texts.append(t)
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    got = index(texts)

    def no(_):
        raise ValueError

    for i, t in enumerate(texts):
        try:
            pairs = []
            json.loads(t, parse_constant=no, object_pairs_hook=lambda p: pairs.append(p) or dict(p))
        except ValueError:
            assert i not in got, t
            continue
        if any(len({k for k, _ in p}) < len(p) for p in pairs):
            continue
        want = [(f, p, k, x if k == "string" or x is None else json.loads(x)) for f, p, k, x in tree(json.loads(t))]
        mine = [(r["field"], r["place"], r["type"], json.loads(r["text"]) if r["type"] == "scalar" else r["text"]) for r in got[i]]
        clean = lambda s: s.encode("utf-8", "replace").decode() if isinstance(s, str) else s
        assert mine == [tuple(map(clean, w)) for w in want], t


def test_levels_of_every_layout(spark):
    book = {"yes_bids": [[0.5, 1], None, [None, 2], {"price": "0.2500", "size": "3.5"}, {"size": 1}, []], "no_bids": None}
    event = {"event_ticker": "E", "outcomes": [{"ticker": "T1", "book": book}, None, {"ticker": "T2", "books": [None, {"no_bids": [["0.1", "1"]]}]}, {"ticker": "T3", "depth": {"books": [{"yes_bids": [[1, 1]]}]}}, {"ticker": "T4", "book": None}]}
    odds = {"odds_leg": {"bookmakers": [{"outcomes": [{"name": "x", "price": 1.5}]}]}}
    payloads = [json.dumps(event | odds), json.dumps([{"game": event}, {"game": event}]), json.dumps({"manifests": [event]}), json.dumps(event)[:-9], "", None, "7", "null", "[]", json.dumps({"outcomes": [], "x": "a" * 100_000})]
    df = spark.createDataFrame(list(enumerate(payloads)), "line_id bigint, payload string").withColumn("kind", F.lit("clash")).withColumn("node", F.lit(1))
    flat = nested.game_tables(df)
    one = [("E", "T1", 1, "yes", 1, 5000), ("E", "T1", 1, "yes", 4, 2500), ("E", "T2", 2, "no", 1, 1000), ("E", "T3", 1, "yes", 1, 10000)]
    want = Counter((i, *o) for i, n in ((0, 1), (1, 2), (2, 1)) for o in one for _ in range(n))
    levels = flat.where("kind = 'level'")
    assert Counter(tuple(r) for r in levels.select("line_id", "event_ticker", "ticker", "book_no", "side", "level_no", "price_tt").collect()) == want
    linked = flat.alias("c").join(flat.alias("p"), F.expr("c.line_id = p.line_id and c.parent = p.node"))
    assert set(rows(linked.select("c.kind", "p.kind").distinct())) == {("outcome", "manifest"), ("book", "outcome"), ("level", "book")}
    assert flat.where("kind != 'manifest' and parent is null").count() == 0
    assert rows(nested.game_tables(df.where("false"))) == []

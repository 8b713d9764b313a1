"""Readers, projections and small joins: equal to SQL, and to plain loops on small fixtures."""

from __future__ import annotations

import oracle
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import ladder, tickers
from tapeloom.operators import quality, sets
from tapeloom.plans import records
from tapeloom.sources import readers


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(records.SQL))
def test_equals_sql(spark, duck, small, name):
    assert oracle.compare(spark, duck, name, small) == ""


def test_decided_ladders(spark):
    data = [("a", "x", True), ("a", "x", None), ("a", "y", False), ("b", "x", True), ("b", "y", True), ("c", "x", True), ("d", "x", None), ("d", "y", None), (None, "x", True)]
    df = spark.createDataFrame(data, "g string, m string, w boolean")
    assert rows(readers.decided(df, "g", "m", "w", 2)) == [("a", 2, "x")]
    assert rows(readers.decided(df.where("false"), "g", "m", "w", 2)) == []


def test_watch_list_keeps_the_order_and_says_when_it_is_cut(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4), (None, 0)], "k string, i int")
    cut = readers.watch_list(df, "k", "i", 2)
    assert rows(cut) == [("a", True), ("b", True)] and rows(readers.watch_list(df, "k", "i", 3)) == [("a", False), ("b", False), ("c", False)]
    assert rows(readers.watch_list(df.where("false"), "k", "i", 2)) == []


def test_two_sided_readings(spark):
    df = spark.createDataFrame([(1, 2), (0, 5), (5, 5), (3, 10_000), (None, 7)], "bid int, ask int")
    assert rows(readers.two_sided(df)) == [(1, 2, 3)]


def test_folded_caches(spark):
    make = lambda d, s: spark.createDataFrame(d, s)
    caches = [make([("a", 1), ("b", 1), (None, 1)], "k string, v int"), make([("b",), ("c",)], "k string")]
    assert rows(sets.fold(caches, ["k"], make([("a",)], "k string"))) == [("b", 1, 1), ("c", 2, None)]


def test_normalised_books(spark):
    df = spark.sql("select array(array(0.4D, 5D), array(0.45D, 1D)) as y, array(array(0.5D, 2D)) as n, cast(array() as array<array<double>>) as e, cast(null as array<array<double>>) as z")
    got = df.select(ladder.normalized(F.col("y"), F.col("n")).alias("a"), ladder.normalized(F.col("e"), F.col("z")).alias("b")).first()
    assert tuple(got.a) == (0.45, 0.5, 0.5, 0.55, 3) and tuple(got.b) == (None, None, None, None, 0)


def test_flags_against_what_was_known(spark):
    now = spark.createDataFrame([("new", True), ("again", True), ("missed", False), ("gone", False), ("back", True), ("quiet", False)], "k string, flag boolean")
    state = spark.createDataFrame([("again", 2, 5, False), ("missed", 2, 5, False), ("gone", 1, 9, True), ("back", 1, 9, True), ("unseen", 3, 4, False)], "k string, hits bigint, days bigint, expired boolean")
    got = {r.k: r.event for r in quality.reconciled(now, state, "k").collect()}
    assert got == {"new": "observed", "again": "recheck_hit", "missed": "recheck_miss", "gone": None, "back": "recheck_hit", "quiet": None}


def test_game_tickers(spark):
    df = spark.createDataFrame([("KXGAME-26JUN02ESTMUN43",), ("KXGAME-26JUN02",), (None,)], "t string")
    got = [tuple(r.g) for r in df.select(tickers.game(F.col("t")).alias("g")).collect()]
    assert got[0] == ("KXGAME", "26JUN02", "EST", "MUN", None) and got[1][4] == "no game"


def test_reports_alerts_and_snapshots(spark, tmp_path):
    import json

    from tapeloom.sources import reports

    df = spark.sql("select 'a|b' as k, date'2026-06-01' as d, array(2, 1) as x, named_struct('y', 1) as s union all select null, null, null, null")
    assert reports.write_report(df, f"file://{tmp_path}/r", "Days") == 2
    said = json.loads((tmp_path / "r.json").read_text())
    assert said["title"] == "Days" and {"k": "a|b", "d": "2026-06-01", "x": [2, 1], "s": {"y": 1}} in said["rows"]
    assert "| a\\|b | 2026-06-01 |" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError):
        reports.write_report(df, f"file://{tmp_path}/r", "Days", most=1)
    posted = []
    assert reports.alert(df, F.col("k") == "x", posted.append) == 0 and not posted
    assert reports.alert(df, F.col("k").isNotNull(), posted.append) == 1 and posted[0].startswith("1 alerts")
    for n in (1, 2):
        reports.write_snapshot(spark.range(n), f"file://{tmp_path}/snap")
    assert spark.read.parquet(f"file://{tmp_path}/snap").count() == 2 and [p.name for p in tmp_path.glob("snap*")] == ["snap"]


def test_orders_come_ahead_of_fills_in_one_sequence(spark):
    from tapeloom.sources import reports

    orders, fills = spark.createDataFrame([(5, "o2"), (1, "o1")], "t int, id string"), spark.createDataFrame([(0, "f1"), (3, "f2")], "t int, id string")
    got = reports.in_order([("order", orders, "t"), ("fill", fills, "t")]).orderBy("seq").collect()
    assert [(r.kind, r.line) for r in got] == [("order", '{"id":"o1","t":1}'), ("order", '{"id":"o2","t":5}'), ("fill", '{"id":"f1","t":0}'), ("fill", '{"id":"f2","t":3}')]


def test_sheets_of_workbooks(spark, tmp_path):
    import zipfile

    from tapeloom.sources import dimensions

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="Odds" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Home</t></si><si><r><t>Ha</t></r><r><t>ll</t></r></si></sst>")
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Avg</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.5</v></c></row><row r="3"><c r="B3"><v>2</v></c></row><row r="4"/>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    at = f"file://{tmp_path}/b.xlsx"
    assert [(r.row, r.cells) for r in dimensions.sheet_rows(spark, at, "Odds").orderBy("row").collect()] == [(2, {"Home": "Hall", "Avg": "1.5"}), (3, {"Avg": "2"})]
    assert [r.row for r in dimensions.sheet_rows(spark, at, "Odds", ("Home",)).collect()] == [2]
    with pytest.raises(Exception, match="no columns"):
        dimensions.sheet_rows(spark, at, "Odds", ("Away",)).collect()


def test_settings_by_indentation(spark, tmp_path):
    from tapeloom.sources import dimensions

    (tmp_path / "s.yaml").write_text('# stations\ncities:\n  GALT:\n    station: "KGAL"  # verified\n    series:\n      - KXHIGHGALT\n      - \'KXLOWGALT\'\n  SAND:\n    station: KSAN\nfamilies:\n  - name: final\n    rank: 2\n  - name: semi\n    rank: 1\n')
    got = [(tuple(r.keys), r.place, r.value) for r in dimensions.settings(spark, f"file://{tmp_path}/s.yaml").collect()]
    assert got == [
        (("cities", "GALT", "station"), None, "KGAL"), (("cities", "GALT", "series"), 1, "KXHIGHGALT"), (("cities", "GALT", "series"), 2, "KXLOWGALT"), (("cities", "SAND", "station"), None, "KSAN"),
        (("families", "name"), 1, "final"), (("families", "rank"), 1, "2"), (("families", "name"), 2, "semi"), (("families", "rank"), 2, "1"),
    ]
    assert dimensions.settings(spark, f"file://{tmp_path}/none.yaml").count() == 0

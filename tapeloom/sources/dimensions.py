"""Small dimensions from files that Spark has no reader for: sheets of workbooks, and nested lists of settings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The name spaces of workbooks, and where they keep things.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = "path string, row int, cells map<string,string>"


def _sheet(content: bytes, sheet: str) -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, column letters to text) of every row of a sheet that has a cell."""
    book = zipfile.ZipFile(io.BytesIO(content))
    words = []
    if "xl/sharedStrings.xml" in book.namelist():
        words = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
    ids = {s.get("name"): s.get(LINK) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
    if sheet not in ids:
        raise ValueError(f"no sheet {sheet}")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    with book.open("xl/" + links[ids[sheet]].removeprefix("/xl/")) as part:
        for _, row in ElementTree.iterparse(part):
            if row.tag != f"{MAIN}row":
                continue
            cells = {}
            for c in row.iter(f"{MAIN}c"):
                raw = c.findtext(f"{MAIN}v")
                text = words[int(raw)] if c.get("t") == "s" and raw is not None else "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if c.get("t") == "inlineStr" else raw
                if text is not None:
                    cells[re.sub(r"\d", "", c.get("r"))] = text
            if cells:
                yield int(row.get("r")), cells
            row.clear()


def sheet_rows(spark: SparkSession, path: str, sheet: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one sheet of every workbook at ``path`` under the names in its first row: (path, row, cells).

    Workbooks are read one in a task. A workbook without the sheet or a ``required`` column is an
    error; rows without a value in a required column are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                rows = _sheet(bytes(content), sheet)
                names = next(rows, (0, {}))[1]
                missing = [r for r in required if r not in names.values()]
                if missing:
                    raise ValueError(f"{file} has no columns {missing}")
                out = [(file, n, {names[c]: v for c, v in cells.items() if c in names}) for n, cells in rows]
                yield pd.DataFrame([r for r in out if all(r[2].get(q) for q in required)], columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ROWS)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """Nested names, values and lists written by indentation, one leaf a row: (keys, place, value).

    ``keys`` are the names down to the leaf, ``place`` counts the items of a list from 1. Comments
    and blank lines are left out, quotes around values are taken off; a missing file has no rows.
    A name may be followed by a list, or an item by names of its own, whose place is the item's.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    rows: list[tuple[list[str], int | None, str | None]] = []
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    text = ""
    if fs.exists(at):
        stream = fs.open(at)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
    open_names: list[tuple[int, str]] = []
    places: dict[int, int] = {}
    clean = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    for line in text.splitlines():
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip():
            continue
        depth = len(body) - len(body.lstrip())
        said = body.strip()
        item = said.startswith("- ") or said == "-"
        while open_names and (open_names[-1][0] > depth or open_names[-1][0] == depth and not item):
            open_names.pop()
        for d in [d for d in places if d > depth or d == depth and not item]:
            if d > depth or not any(k < depth for k in places):
                places.pop(d)
        if item:
            places[depth] = places.get(depth, 0) + 1
            said = said[1:].strip()
            depth += 2
            for d in [d for d in places if d >= depth]:
                places.pop(d)
        place = places[max(places)] if places else None
        name = re.match(r"^([^:'\"]+):(?:\s+(.*))?$", said)
        if name and name[2] is None:
            open_names.append((depth, clean(name[1].strip())))
        elif name:
            rows.append(([n for _, n in open_names] + [clean(name[1].strip())], place, clean(name[2].strip())))
        elif said:
            rows.append(([n for _, n in open_names], place, clean(said)))
    return spark.createDataFrame(rows, "keys array<string>, place int, value string")

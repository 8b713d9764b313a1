"""Text decoded with the wrong character encoding: found, labelled by span, and restored.

A hidden Markov model labels the characters of a text. One state is clean; every other state is a
pair of encodings, the true one of the bytes and the wrong one they were decoded with. What a
state emits is what clean text holds at such a place, passed through its pair; so its probability
is that of the restored character between its neighbours. ASCII characters are the same in all
states and are stepped over. The statistics of clean text are learnt from the whole corpus by
hard expectation-maximisation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLEAN, LOST = "clean", "lost"
#: Fixed values: (state, true encoding, wrong encoding, times it happened).
PAIRS = (
    ("utf-8 as cp1252", "utf-8", "cp1252", 1),
    ("utf-8 as latin-1", "utf-8", "latin-1", 1),
    ("utf-8 as cp1252 twice", "utf-8", "cp1252", 2),
    ("utf-8 as mac-roman", "utf-8", "mac-roman", 1),
    ("utf-8 as cp437", "utf-8", "cp437", 1),
    ("utf-8 as cp850", "utf-8", "cp850", 1),
    ("cp1252 as cp437", "cp1252", "cp437", 1),
    ("cp1252 as cp850", "cp1252", "cp850", 1),
    ("cp1252 as mac-roman", "cp1252", "mac-roman", 1),
    ("mac-roman as cp1252", "mac-roman", "cp1252", 1),
    ("cp437 as cp1252", "cp437", "cp1252", 1),
    ("cp850 as cp1252", "cp850", "cp1252", 1),
)
#: The states; the last is text whose bytes became U+FFFD and cannot be restored.
STATES = (CLEAN, *(p[0] for p in PAIRS), LOST)
#: Log probabilities: a text begins in an encoding pair; a line after clean ones does, or turns clean again; the state changes within a line.
BEGIN, TURN, RETURN, WITHIN = -5.5, -6.5, -3.0, -14.0
#: Runs whose inverses a worker remembers, and the longest such run; this bounds memory and changes no result.
KNOWN_RUNS, KNOWN_RUN = 20_000, 48
#: Log probability of what a state cannot emit, and of an unknown character.
NEVER, UNKNOWN = -25.0, -16.0
ROUNDS = 2
POOL = 0x110000
STAT = "key bigint, n bigint"


def _decode(b: int, encoding: str) -> str | None:
    """The character of a byte; bytes that the encoding leaves undefined stand for themselves."""
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


@cache
def to_byte(encoding: str) -> dict[int, int]:
    """Code point to byte, above ASCII, of a single-byte encoding."""
    return {ord(_decode(b, encoding)): b for b in range(128, 256)}


@cache
def repertoire() -> np.ndarray:
    """Sorted code points that some encoding here has, so that their neighbours are counted, too."""
    found = {c for p in PAIRS for e in p[1:3] if e != "utf-8" for c in to_byte(e)}
    return np.array(sorted(found | {c for c in range(0x80, 0x180)} | {0x2010, 0x2011, 0x2012, 0x2015}), np.int64)


#: Neighbours: letters without case, then capitals, digits, space, line end, other ASCII, beyond ASCII, and end of text.
UPPER, DIGIT, SPACE, LINE, MARK, BEYOND, EDGE = range(26, 33)
AROUND = 33
GROUP = np.array([0] * 26 + [1, 2, 3, 4, 5, 6, 7])
NEIGHBOUR = np.full(256, BEYOND)
NEIGHBOUR[:128] = MARK
NEIGHBOUR[97:123] = np.arange(26)
NEIGHBOUR[65:91], NEIGHBOUR[48:58] = UPPER, DIGIT
NEIGHBOUR[[9, 32]], NEIGHBOUR[[10, 13]] = SPACE, LINE


def pooled(points: np.ndarray) -> np.ndarray:
    """Code points, those outside of the repertoire by block of 256, as a number under 2 ** 21."""
    known = repertoire()
    at = np.minimum(np.searchsorted(known, points), len(known) - 1)
    return np.where(known[at] == points, points, POOL + (points >> 8))


@dataclass
class Beyond:
    """The characters beyond ASCII of a batch: code point, neighbours, byte place and owner."""

    point: np.ndarray
    before: np.ndarray
    after: np.ndarray
    place: np.ndarray
    owner: np.ndarray


def beyond_ascii(data: np.ndarray, bounds: np.ndarray) -> Beyond:
    """Every character beyond ASCII in UTF-8 texts that lie one after another."""
    place = np.flatnonzero(data >= 0xC0)
    lead = data[place].astype(np.int64)
    size = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2))
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    tail = [padded[place + k] & 0x3F for k in (1, 2, 3)]
    point = np.where(size == 2, (lead & 0x1F) << 6 | tail[0], np.where(size == 3, (lead & 0x0F) << 12 | tail[0] << 6 | tail[1], (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
    owner = np.searchsorted(bounds, place, side="right") - 1
    before = np.where(place > bounds[owner], NEIGHBOUR[padded[place - 1]], EDGE)
    after = np.where(place + size < bounds[owner + 1], NEIGHBOUR[padded[place + size]], EDGE)
    return Beyond(point, before, after, place, owner)


def keys(point: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One number for a character between its neighbours; pooled characters have none."""
    point = pooled(point)
    around = np.where(point >= POOL, 0, before * AROUND + after)
    return point * (AROUND * AROUND) + around


class Clean:
    """How likely each character beyond ASCII is in clean text between its neighbours.

    Kept for the neighbours themselves, backed off to their groups and to the character alone.
    There are at most ``AROUND ** 2`` rows for each of some hundred characters of the repertoire,
    and one for each of 4,352 blocks, whatever the size of the corpus.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray):
        order = np.argsort(key)
        self.key, n = key[order].astype(np.int64), n[order].astype(float)
        point, around = self.key // AROUND**2, self.key % AROUND**2
        group = point * 64 + GROUP[around // AROUND] * 8 + GROUP[around % AROUND]
        self.tables = []
        for of, given in ((self.key, around), (group, group % 64), (point, point * 0)):
            names, inverse = np.unique(of, return_inverse=True)
            total = np.bincount(inverse, n) if len(n) else np.zeros(0)
            within = np.zeros(AROUND**2)
            np.add.at(within, given, n)
            self.tables.append((names, total, within))

    def _counts(self, level: int, name: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, total, within = self.tables[level]
        if not len(names):
            return np.zeros(len(name)), np.zeros(len(name))
        at = np.minimum(np.searchsorted(names, name), len(names) - 1)
        return np.where(names[at] == name, total[at], 0), within[given]

    def logp(self, point: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        key = keys(point, before, after)
        own, around = key // AROUND**2, key % AROUND**2
        group = GROUP[around // AROUND] * 8 + GROUP[around % AROUND]
        n, total = self._counts(2, own, own * 0)
        p = (n + 1e-3) / (total + 10)
        for level, name, given in ((1, own * 64 + group, group), (0, key, around)):
            n, total = self._counts(level, name, given)
            p = (n + 2 * p) / (total + 2)
        return np.where(point == 0xFFFD, NEVER, np.maximum(np.log(p), UNKNOWN))


def _utf8_runs(values: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, code point) of the valid sequences of several bytes; -1 is no byte."""
    out, k = [], 0
    while k < len(values):
        b = values[k]
        size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if size and k + size <= len(values) and min(values[k : k + size]) >= 0:
            try:
                out.append((k, size, ord(bytes(values[k : k + size]).decode())))
                k += size
                continue
            except UnicodeDecodeError:
                pass
        k += 1
    return out


def undo(text: list[int], true: str, wrong: str) -> list[tuple[int, int, int]]:
    """The restored characters of a run beyond ASCII: (start, length, code point); what is missing cannot be."""
    table = to_byte(wrong)
    values = [table.get(c, -1) for c in text]
    if true == "utf-8":
        return _utf8_runs(values)
    return [(k, 1, ord(_decode(b, true))) for k, b in enumerate(values) if b >= 0]


def _undone(run: tuple[int, ...], state: int) -> tuple[tuple[int, int, int], ...]:
    """What the run was before its state's pair was applied, as (start, length, code point)."""
    return (_undone_known if len(run) <= KNOWN_RUN else _undo_run)(run, state)


def _undo_run(run: tuple[int, ...], state: int) -> tuple[tuple[int, int, int], ...]:
    _, true, wrong, times = PAIRS[state - 1]
    parts = undo(list(run), true, wrong)
    for _ in range(times - 1):  # once more, over what came out; a part that is still wrong disappears
        again = []
        for k, size, point in undo([p for _, _, p in parts], true, wrong):
            group = parts[k : k + size]
            if all(a[0] + a[1] == b[0] for a, b in zip(group, group[1:])):
                again.append((group[0][0], group[-1][0] + group[-1][1] - group[0][0], point))
        parts = again
    return tuple(parts)


_undone_known = lru_cache(maxsize=KNOWN_RUNS)(_undo_run)


def _emissions(text: str, runs: list[tuple[int, int]], model: Clean) -> np.ndarray:
    """Log probability of each run of characters beyond ASCII (rows) in each state (columns)."""
    table = np.full((len(runs), len(STATES)), 0.0)
    points, before, after, row, column = [], [], [], [], []
    code = [ord(c) for c in text]
    near = lambda k: EDGE if k < 0 or k >= len(code) else int(NEIGHBOUR[min(code[k], 255)])

    def ask(r: int, s: int, parts) -> None:
        start, stop = runs[r]
        last = len(parts) - 1
        for i, (k, size, point) in enumerate(parts):
            points.append(point)
            before.append(near(start - 1) if k == 0 else BEYOND)
            after.append(near(stop) if start + k + size == stop and i == last else BEYOND)
            row.append(r)
            column.append(s)

    for r, (start, stop) in enumerate(runs):
        run = tuple(code[start:stop])
        ask(r, 0, [(k, 1, c) for k, c in enumerate(run)])
        for s in range(1, len(PAIRS) + 1):
            parts = _undone(run, s)
            ask(r, s, parts)
            table[r, s] = NEVER * (len(run) - sum(size for _, size, _ in parts))
        table[r, -1] = sum(-1.0 if c == 0xFFFD else NEVER for c in run)
    if points:
        np.add.at(table, (np.array(row), np.array(column)), model.logp(np.array(points), np.array(before), np.array(after)))
    return table


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of a change of state at a line end and within a line."""
    k = len(STATES)
    line = np.full((k, k), TURN + RETURN)
    line[0, :], line[:, 0] = TURN, RETURN
    np.fill_diagonal(line, 0.0)
    within = np.full((k, k), WITHIN)
    np.fill_diagonal(within, 0.0)
    return line, within


LINE_MOVE, WITHIN_MOVE = _moves()


def label(text: str, model: Clean) -> list[tuple[int, int, int]]:
    """The runs of characters beyond ASCII as (start, stop, state), by the likeliest path of states."""
    runs, k = [], 0
    beyond = [i for i, c in enumerate(text) if c > "\x7f"]
    while k < len(beyond):
        j = k
        while j + 1 < len(beyond) and beyond[j + 1] == beyond[j] + 1:
            j += 1
        runs.append((beyond[k], beyond[j] + 1))
        k = j + 1
    if not runs:
        return []
    emitted = _emissions(text, runs, model)
    score = emitted[0] + np.where(np.arange(len(STATES)) == 0, 0.0, BEGIN)
    back = np.zeros((len(runs), len(STATES)), np.int64)
    for r in range(1, len(runs)):
        moves = score[:, None] + (LINE_MOVE if "\n" in text[runs[r - 1][1] : runs[r][0]] else WITHIN_MOVE)
        back[r] = moves.argmax(axis=0)
        score = moves.max(axis=0) + emitted[r]
    state = int(score.argmax())
    path = [state]
    for r in range(len(runs) - 1, 0, -1):
        state = int(back[r, state])
        path.append(state)
    return [(a, b, s) for (a, b), s in zip(runs, reversed(path))]


def restored(text: str, labels: list[tuple[int, int, int]]) -> str:
    """The text with each labelled span put through its state's inverse; what cannot be restored stays."""
    out, at = [], 0
    for start, stop, state in labels:
        out.append(text[at:start])
        at = start
        if 0 < state <= len(PAIRS):
            for k, size, point in _undone(tuple(map(ord, text[start:stop])), state):
                out.append(text[at : start + k] + chr(point))
                at = start + k + size
        out.append(text[at:stop])
        at = stop
    return "".join([*out, text[at:]])


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of texts; a null one is empty."""
    column = pa.concat_arrays([column.fill_null("").cast(pa.large_string())])
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


@cache
def _inverses() -> list[np.ndarray]:
    """For each pair that maps single bytes, the restored code point by place in the repertoire (0 where it has none)."""
    known = repertoire().tolist()
    out = []
    for _, true, wrong, _ in PAIRS:
        if true != "utf-8":
            table = to_byte(wrong)
            out.append(np.array([ord(_decode(table[c], true)) if c in table else 0 for c in known], np.int64))
    return out


@cache
def _as_bytes() -> list[np.ndarray]:
    """For each wrong encoding of UTF-8 bytes, the byte by place in the repertoire (0 where it has none)."""
    known = repertoire().tolist()
    return [np.array([to_byte(e).get(c, 0) for c in known], np.int64) for e in sorted({w for _, t, w, _ in PAIRS if t == "utf-8"})]


def _best_stretch(gain: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(greatest sum, text): by text, the greatest sum of ``gain`` over neighbouring characters; 0 at least."""
    total = np.cumsum(gain)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    start = np.repeat(total[first] - gain[first], np.diff(np.append(first, len(gain))))
    within = total - start  # up to and with each character of its own text
    # The least sum ahead of each character, by text: texts are set apart by more than any sum.
    apart = (np.abs(within).max() + 1) * (owner.max() - owner)
    least = np.minimum.accumulate(np.minimum(within - gain, 0) + apart) - apart
    return np.maximum.reduceat(np.maximum(within - np.minimum(least, 0), 0), first), owner[first]


def suspects(x: Beyond, model: Clean) -> np.ndarray:
    """The texts in which some state could pay for its entry; in all others the clean path is the likeliest.

    A path that beats the clean one has a stretch in some one state that gains more than the
    cheapest entry costs. U+FFFD is in no clean text. What a state that undoes single bytes gains
    over a stretch is the sum over its characters, those that it cannot emit among them; the
    greatest such sum of each text is compared. A state that undoes UTF-8 gains nothing without
    a lead and a continuation side by side.
    """
    if not len(x.point):
        return np.zeros(0, int)
    point, owner = x.point, x.owner - x.owner[0]
    clean = model.logp(point, x.before, x.after)
    out = np.zeros(owner[-1] + 1, bool)
    out[owner[point == 0xFFFD]] = True
    known = repertoire()
    at = np.minimum(np.searchsorted(known, point), len(known) - 1)
    inside = known[at] == point
    for inverse in _inverses():
        back = np.where(inside, inverse[at], 0)
        able = np.flatnonzero(back > 0)
        if not len(able):
            continue
        gain = NEVER - clean
        gain[able] = model.logp(back[able], x.before[able], x.after[able]) - clean[able]
        best, of = _best_stretch(gain, owner)
        out[of[best >= -max(BEGIN, TURN) - 1e-6]] = True
    for table in _as_bytes():
        byte = np.where(inside, table[at], 0)
        lead, follows = (byte[:-1] >= 0xC2) & (byte[:-1] <= 0xF4), (byte[1:] >= 0x80) & (byte[1:] < 0xC0)
        side = (x.after[:-1] == BEYOND) & (x.before[1:] == BEYOND) & (owner[1:] == owner[:-1])
        out[owner[:-1][lead & follows & side]] = True
    return np.flatnonzero(out) + x.owner[0]


def _tally(key: np.ndarray) -> pa.RecordBatch:
    names, n = np.unique(key, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def _count(batches: Iterator[pa.RecordBatch], model: Clean | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = beyond_ascii(*_buffers(batch.column(0)))
        if model is None:  # at first only characters that stand alone, as wrongly decoded UTF-8 never does
            alone = (x.before != BEYOND) & (x.after != BEYOND)
            yield _tally(keys(x.point[alone], x.before[alone], x.after[alone]))
            continue
        odd = suspects(x, model)
        plain = ~np.isin(x.owner, odd)
        yield _tally(keys(x.point[plain], x.before[plain], x.after[plain]))
        texts = batch.column(0).take(pa.array(odd)).to_pylist()
        mended = [restored(t, label(t, model)) for t in texts]
        y = beyond_ascii(*_buffers(pa.array(mended, pa.string())))
        yield _tally(keys(y.point, y.before, y.after))


def learn(documents: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Clean:
    """The statistics of clean text from all ``documents``; each round counts what the last one restored."""
    model = None
    for _ in range(rounds):
        known = documents.sparkSession.sparkContext.broadcast(model)
        counted = documents.select(text).where(F.col(text).rlike(r"[^\x00-\x7F]")).mapInArrow(lambda b, known=known: _count(b, known.value), STAT)
        rows = counted.groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # bounded, see Clean
        model = Clean(rows["key"].to_numpy(), rows["n"].to_numpy())
        known.unpersist()
    return model


FOUND = "doc_id bigint, states array<string>, n_runs int, lost boolean, text string"


def garbled(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Clean | None = None) -> DataFrame:
    """The documents with wrongly decoded characters: (doc_id, states, n_runs, lost, text).

    ``states`` are the encoding pairs found, ``n_runs`` counts the wrong runs, ``lost`` says that
    some of the original is beyond restoring, and ``text`` is the restored text. Clean, empty and
    null texts give no row; repeated documents give a row each. Without a ``model`` it is learnt
    from ``documents`` themselves.
    """
    spark = documents.sparkSession
    rows = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text"))
    known = spark.sparkContext.broadcast(model or learn(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = suspects(beyond_ascii(*_buffers(batch.column(1))), known.value)
            out = []
            for i, t in zip(odd.tolist(), batch.column(1).take(pa.array(odd)).to_pylist()):
                wrong = [x for x in label(t, known.value) if x[2]]
                if wrong:
                    mended = restored(t, wrong)
                    out.append((batch.column(0)[i].as_py(), sorted({STATES[s] for _, _, s in wrong}), len(wrong), "�" in mended, mended))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["doc_id", "states", "n_runs", "lost", "text"]), pa.schema([("doc_id", pa.int64()), ("states", pa.list_(pa.string())), ("n_runs", pa.int32()), ("lost", pa.bool_()), ("text", pa.string())]), preserve_index=False)

    return rows.where(F.col("text").rlike(r"[^\x00-\x7F]")).mapInArrow(run, FOUND)

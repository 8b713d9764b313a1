"""Deeply nested JSON records into flat linked tables, by vectorised structural indexing.

A batch of payloads is one byte array. Bitmaps of quotes, brackets and delimiters are taken over
all of it at once, a running parity tells strings from structure, prefix sums of the brackets give
the nesting depth, and spans between structural positions become nodes that know their parent. No
payload is parsed by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

WHITE, STRUCTURE, QUOTE, OTHER = 1, 2, 3, 0
CLASS = np.zeros(256, np.uint8)
CLASS[[9, 10, 13, 32]] = WHITE
CLASS[[ord(c) for c in "{}[]:,"]] = STRUCTURE
CLASS[34] = QUOTE
OBJECT, END_OBJECT, ARRAY, END_ARRAY, COLON, COMMA, STRING = (ord(c) for c in '{}[]:,"')
SCALAR = ord("v")
LITERAL = r"^(true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)$"
ESCAPES = r'^([^\\]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*$'
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: Bytes of payload that are indexed at once.
CHUNK_BYTES = 4_000_000


@dataclass
class Nodes:
    """The tokens of the readable records in a batch. A value's node is the token it starts with."""

    kind: np.ndarray  # byte of the token: { } [ ] : , " or v
    record: np.ndarray
    parent: np.ndarray  # token that opens the enclosing object or array; -1 at the top
    key: np.ndarray  # token of the key of an object's value; -1 otherwise
    index: np.ndarray  # place in an array, from 0; -1 otherwise
    is_value: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    readable: np.ndarray  # by record

    def texts(self, tokens: np.ndarray) -> pa.Array:
        """Text of string and scalar tokens, strings without quotes and with escapes resolved."""
        quoted = self.kind[tokens] == STRING
        raw = spans(self.data, self.start[tokens] + quoted, self.end[tokens] - quoted).cast(pa.string(), safe=False)
        if len(tokens) and pc.any(slashed := pc.match_substring(raw, "\\")).as_py():
            at = np.flatnonzero(slashed.to_numpy(zero_copy_only=False))
            words = raw.to_pylist()
            for i in at:
                words[i] = json.loads(f'"{words[i]}"').encode("utf-8", "replace").decode()
            raw = pa.array(words, pa.string())
        return raw

    def child(self, name: str, codes: np.ndarray, names: list[str]) -> np.ndarray:
        """By object token, its value under ``name`` (the last of several), or -1."""
        found = np.full(len(self.kind) + 1, -1)
        if name in names:
            at = np.flatnonzero(codes == names.index(name))
            found[self.parent[at]] = at
        found[-1] = -1
        return found


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each start to each end, as one binary array."""
    sizes = end - start
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    taken = data[np.repeat(start - bounds[:-1], sizes) + np.arange(bounds[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(taken))])


def _last(marked: np.ndarray) -> np.ndarray:
    """At each place the index of the last marked place up to and with it, or -1."""
    return np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1)) if len(marked) else np.zeros(0, int)


def structural_index(data: np.ndarray, bounds: np.ndarray) -> Nodes:
    """Index records that lie in ``data`` between consecutive ``bounds``; unreadable ones yield no tokens."""
    n, records = len(data), len(bounds) - 1
    size = np.diff(bounds)
    owner = np.repeat(np.arange(records), size)
    bad = size == 0

    slash = data == 92
    escaped = np.zeros(n, bool)
    if slash.any():  # a character after an odd run of backslashes is escaped
        plain = np.maximum(_last(~slash), bounds[:-1][owner] - 1)
        run = np.arange(n) - plain  # backslashes up to and with this place
        escaped[1:] = (run[:-1] % 2 == 1) & (owner[1:] == owner[:-1])
    quote = (data == 34) & ~escaped
    quotes = np.cumsum(quote)
    at_start = np.concatenate([[0], quotes])[bounds[:-1]]
    odd = (quotes - at_start[owner]) % 2 == 1  # from the opening quote to before the closing one
    bad |= (np.concatenate([[0], quotes])[bounds[1:]] - at_start) % 2 == 1
    bad[owner[odd & (data < 32)]] = True

    kinds = CLASS[data]
    structure = (kinds == STRUCTURE) & ~odd
    opening = quote & odd
    scalar = (kinds == OTHER) & ~odd
    begins = scalar.copy()
    begins[1:] &= ~(scalar[:-1] & (owner[1:] == owner[:-1]))
    token = np.flatnonzero(structure | opening | begins)
    kind = np.where(opening[token], STRING, np.where(begins[token], SCALAR, data[token])).astype(np.int64)
    rec = owner[token]
    closing = np.flatnonzero(quote & ~odd)
    end = token + 1
    strings = np.flatnonzero(kind == STRING)
    after = np.searchsorted(closing, token[strings])
    closed = after < len(closing)
    bad[rec[strings[~closed]]] = True
    end[strings[closed]] = closing[after[closed]] + 1
    scalars = np.flatnonzero(kind == SCALAR)
    stops = np.flatnonzero(scalar & ~np.concatenate([scalar[1:] & (owner[1:] == owner[:-1]), [False]])[:n]) if n else np.zeros(0, int)
    end[scalars] = stops + 1

    def keep(ok: np.ndarray) -> None:
        nonlocal token, kind, rec, end
        token, kind, rec, end = token[ok], kind[ok], rec[ok], end[ok]

    # Scalars and escapes that are no JSON.
    if len(scalars):
        words = spans(data, token[scalars], end[scalars])
        bad[rec[scalars[~pc.fill_null(pc.match_substring_regex(words, LITERAL), False).to_numpy(zero_copy_only=False)]]] = True
    if slash.any():
        slashes = np.concatenate([[0], np.cumsum(slash)])
        some = strings[slashes[end[strings]] > slashes[token[strings]]]
        words = spans(data, token[some] + 1, np.maximum(end[some] - 1, token[some] + 1))
        bad[rec[some[~pc.match_substring_regex(words, ESCAPES).to_numpy(zero_copy_only=False)]]] = True

    # Depth by prefix sums; a record must stay above 0 until its last token and end at 0.
    step = np.isin(kind, (OBJECT, ARRAY)).astype(np.int64) - np.isin(kind, (END_OBJECT, END_ARRAY))
    total = np.bincount(rec, step, records) if len(rec) else np.zeros(records)
    depth = np.cumsum(step)
    first = np.searchsorted(rec, np.arange(records))
    depth = depth - np.concatenate([[0], depth])[first][rec]
    bad |= total != 0
    bad[rec[depth < 0]] = True
    bad |= np.bincount(rec, minlength=records) == 0
    ok = ~bad[rec]
    depth, step = depth[ok], step[ok]
    keep(ok)

    # The enclosing bracket of a token is the last one opened at the depth around it.
    m = len(kind)
    around = depth - (step > 0)  # depth outside of an opening bracket, inside of a closing one's pair
    around = np.where(step < 0, depth + 1, around)
    opens = np.flatnonzero(step > 0)
    place = np.concatenate([np.arange(m) * 2, opens * 2 + 1])  # an opening bracket takes effect after itself
    level = np.concatenate([around, depth[opens]])
    by_depth = np.lexsort((place, level))
    is_open = by_depth >= m
    last = np.maximum.accumulate(np.where(is_open, np.arange(len(by_depth)), -1)) if len(by_depth) else np.zeros(0, int)
    holder = np.full(m, -1)
    plain = ~is_open
    near = last[plain]
    holder[by_depth[plain]] = np.where(near >= 0, opens[np.maximum(by_depth[np.maximum(near, 0)] - m, 0)], -1) if len(opens) else -1
    holder[around == 0] = -1

    inside = np.where(holder >= 0, kind[np.maximum(holder, 0)], 0) if m else np.zeros(0, int)
    before = np.concatenate([[0], kind[:-1]]) if m else np.zeros(0, int)
    starts = np.concatenate([[True], rec[1:] != rec[:-1]]) if m else np.zeros(0, bool)
    before[starts] = 0
    value_start = np.isin(kind, (OBJECT, ARRAY, STRING, SCALAR))
    fresh = np.isin(before, (OBJECT, COMMA))
    is_key = (kind == STRING) & (inside == OBJECT) & fresh
    key_before = np.concatenate([[False], is_key[:-1]]) if m else np.zeros(0, bool)
    ended = np.isin(before, (STRING, SCALAR, END_OBJECT, END_ARRAY)) & ~key_before
    fine = np.select(
        [starts, value_start & (inside == OBJECT), value_start & (inside == ARRAY), value_start, kind == COLON, kind == COMMA, kind == END_OBJECT, kind == END_ARRAY],
        [
            value_start,
            is_key | (before == COLON),
            np.isin(before, (ARRAY, COMMA)),
            False,
            key_before & (inside == OBJECT),
            ended & (inside != 0),
            (inside == OBJECT) & (ended | (before == OBJECT)),
            (inside == ARRAY) & (ended | (before == ARRAY)),
        ],
        False,
    )
    bad[rec[~fine.astype(bool)]] = True
    value = value_start & ~is_key
    key = np.where(value & (inside == OBJECT), np.arange(m) - 2, -1)

    # The place in an array: commas of the same bracket so far.
    index = np.full(m, -1)
    comma = (kind == COMMA) & (inside == ARRAY)
    member = value & (inside == ARRAY)
    both = np.flatnonzero(comma | member)
    by = both[np.argsort(holder[both], kind="stable")]
    passed = np.cumsum(comma[by])
    new = np.concatenate([[True], holder[by][1:] != holder[by][:-1]]) if len(by) else np.zeros(0, bool)
    base = (passed - comma[by])[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else passed
    index[by] = passed - base
    index[~member] = -1

    alive = ~bad[rec]
    if not alive.all():  # renumber what is left of the readable records
        number = np.cumsum(alive) - 1
        holder = np.where(holder >= 0, number[np.maximum(holder, 0)], -1)[alive]
        key = np.where(key >= 0, number[np.maximum(key, 0)], -1)[alive]
        index, value = index[alive], value[alive]
        keep(alive)
    return Nodes(kind, rec, holder, key, index, value, token, end, data, ~bad)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(row ids, bytes, bounds) of the non-null payloads, some megabytes at a time, a record always whole."""
    for batch in batches:
        ids, payload = batch.column(0), batch.column(1).cast(pa.large_binary())
        here = pc.is_valid(payload)
        ids, payload = ids.filter(here), payload.filter(here)
        if not len(payload):
            continue
        sizes = pc.binary_length(payload).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_BYTES)) + 1
        for a, b in zip([0, *cut], [*cut, len(payload)]):
            part = pa.concat_arrays([payload.slice(a, b - a)])
            raw = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] else np.zeros(0, np.uint8)
            bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            yield ids.slice(a, b - a), raw[bounds[0] : bounds[-1]], bounds - bounds[0]


NODES = "row_id bigint, node int, parent int, field string, place int, type string, text string"
TYPES = {OBJECT: "object", ARRAY: "array", STRING: "string", SCALAR: "scalar"}


def _number(nodes: Nodes) -> np.ndarray:
    """Each token's number within its record."""
    first = np.searchsorted(nodes.record, nodes.record)
    return np.arange(len(nodes.record)) - first


def _nodes(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...] | None = None) -> Iterator[pa.RecordBatch]:
    for ids, data, bounds in _records(batches):
        x = structural_index(data, bounds)
        at = np.flatnonzero(x.is_value)
        if fields is not None:
            at = at[x.key[at] >= 0]
            at = at[pc.is_in(x.texts(x.key[at]), pa.array(fields, pa.string())).to_numpy(zero_copy_only=False)]
        number = _number(x)
        up, key = x.parent[at], x.key[at]
        plain = np.isin(x.kind[at], (STRING, SCALAR))
        text, field = np.full(len(at), None, object), np.full(len(at), None, object)
        text[plain] = x.texts(at[plain]).to_pylist()
        field[key >= 0] = x.texts(key[key >= 0]).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(x.record[at])), pa.array(number[at], pa.int32()), pa.array(np.where(up >= 0, number[np.maximum(up, 0)], 0), pa.int32(), mask=up < 0), pa.array(field, pa.string()),
             pa.array(x.index[at] + 1, pa.int32(), mask=x.index[at] < 0), pa.array([TYPES[k] for k in x.kind[at].tolist()], pa.string()), pa.array(text, pa.string())],
            names=["row_id", "node", "parent", "field", "place", "type", "text"],
        )


def json_nodes(payloads: DataFrame, row_id: str, payload: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Every value of every readable payload as a row linked to its parent: (row_id, node, parent, field, place, type, text).

    ``node`` numbers the values within a record, ``parent`` is the node around it (null at the
    top), ``field`` its key, ``place`` its place in an array from 1. Unreadable, empty and null
    payloads give no rows; nesting may be of any depth. With ``fields``, only values under these keys are rows.
    """
    return payloads.select(row_id, payload).mapInArrow(lambda batches: _nodes(batches, fields), NODES)


FLAT = (
    "kind string, line_id bigint, node int, parent int, event_ticker string, ticker string, outcome_no int, book_no int, side string, level_no int, "
    "price_tt bigint, size double"
)


def _members(x: Nodes, arrays: np.ndarray) -> np.ndarray:
    """Values directly inside of the given array tokens."""
    inside = np.zeros(len(x.kind) + 1, bool)
    inside[arrays[(arrays >= 0) & (x.kind[arrays] == ARRAY)]] = True
    inside[-1] = False
    return np.flatnonzero(x.is_value & inside[x.parent])


def _either(*choices: np.ndarray) -> np.ndarray:
    out = choices[0]
    for other in choices[1:]:
        out = np.where(out >= 0, out, other)
    return out


def _of(x: Nodes, tokens: np.ndarray, kind: int) -> np.ndarray:
    """The tokens of one kind, others as -1."""
    return np.where((tokens >= 0) & (x.kind[np.maximum(tokens, 0)] == kind), tokens, -1) if len(x.kind) else tokens


def _numeric(x: Nodes, tokens: np.ndarray) -> np.ndarray:
    """Numbers, and strings that hold one, as doubles; NaN for anything else."""
    out = np.full(len(tokens), np.nan)
    plain = np.flatnonzero((tokens >= 0) & np.isin(x.kind[np.maximum(tokens, 0)], (STRING, SCALAR))) if len(x.kind) else np.zeros(0, int)
    if len(plain):
        words = x.texts(tokens[plain])
        good = pc.fill_null(pc.match_substring_regex(words, NUMBER), False)
        values = pc.utf8_ltrim(pc.utf8_trim_whitespace(words.filter(good)), "+")
        out[plain[good.to_numpy(zero_copy_only=False)]] = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out


def _text_of(x: Nodes, tokens: np.ndarray) -> pa.Array:
    """Text of string tokens, null where there is none."""
    tokens = _of(x, tokens, STRING)
    words, where = np.unique(tokens, return_inverse=True)
    texts = pa.concat_arrays([pa.nulls(1, pa.string()), x.texts(words[words >= 0])]) if len(tokens) else pa.array([], pa.string())
    shift = 0 if len(words) and words[0] < 0 else 1
    return texts.take(pa.array(where + shift)) if len(tokens) else texts


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, bounds in _records(batches):
        x = structural_index(data, bounds)
        m = len(x.kind)
        if not m:
            continue
        keyed = np.flatnonzero(x.key >= 0)
        coded = x.texts(x.key[keyed]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        codes = np.full(m, -1)
        codes[keyed] = coded.indices.to_numpy()
        child = {f: x.child(f, codes, names) for f in ("manifests", "game", "event_ticker", "outcomes", "ticker", "book", "books", "depth", "yes_bids", "no_bids", "price", "size")}
        number = np.concatenate([_number(x), [-1]])

        # Envelopes: lists of records and objects that hold such a list.
        manifests, front = [], np.flatnonzero(x.is_value & (x.parent < 0))
        while len(front):
            lists = front[x.kind[front] == ARRAY]
            objects = front[x.kind[front] == OBJECT]
            held = _of(x, child["manifests"][objects], ARRAY)
            manifests.append(objects[held < 0])
            front = _members(x, np.concatenate([lists, held[held >= 0]]))
        manifest = np.sort(np.concatenate(manifests)) if manifests else np.zeros(0, int)

        game = _of(x, child["game"][manifest], OBJECT)
        event = _either(_of(x, child["event_ticker"][game], STRING), _of(x, child["event_ticker"][manifest], STRING))
        lists = _either(_of(x, child["outcomes"][game], ARRAY), _of(x, child["outcomes"][manifest], ARRAY))
        of_list = np.full(m + 1, -1)
        of_list[lists[lists >= 0]] = np.flatnonzero(lists >= 0)
        outcome = _members(x, lists)
        outcome = outcome[x.kind[outcome] == OBJECT]
        in_manifest = of_list[x.parent[outcome]]

        depth = _of(x, child["depth"][outcome], OBJECT)
        single = _either(_of(x, child["book"][outcome], OBJECT), _of(x, child["book"][depth], OBJECT))
        several = _either(_of(x, child["books"][outcome], ARRAY), _of(x, child["books"][depth], ARRAY))
        several = np.where(single >= 0, -1, several)
        of_list[:] = -1
        of_list[several[several >= 0]] = np.flatnonzero(several >= 0)
        listed = _members(x, several)
        listed = listed[x.kind[listed] == OBJECT]
        book = np.concatenate([single[single >= 0], listed])
        in_outcome = np.concatenate([np.flatnonzero(single >= 0), of_list[x.parent[listed]]])
        book_no = np.concatenate([np.ones((single >= 0).sum(), int), x.index[listed] + 1])

        levels, in_book, sides = [], [], []
        for side, field in (("yes", "yes_bids"), ("no", "no_bids")):
            arrays = _of(x, child[field][book], ARRAY)
            of_list[:] = -1
            of_list[arrays[arrays >= 0]] = np.flatnonzero(arrays >= 0)
            found = _members(x, arrays)
            levels.append(found)
            in_book.append(of_list[x.parent[found]])
            sides.append(np.full(len(found), side, object))
        level, in_book, side = np.concatenate(levels), np.concatenate(in_book), np.concatenate(sides)
        nth = np.full((2, m + 1), -1)  # the first and second member of a level that is a list
        members = np.flatnonzero(x.is_value & (x.index >= 0) & (x.index < 2))
        nth[x.index[members], x.parent[members]] = members
        pair = x.kind[level] == ARRAY
        price = _numeric(x, np.where(pair, nth[0][level], child["price"][level]))
        size = _numeric(x, np.where(pair, nth[1][level], child["size"][level]))
        good = np.isfinite(price)
        level, in_book, side, price, size = level[good], in_book[good], side[good], price[good], size[good]

        groups = (("manifest", manifest), ("outcome", outcome), ("book", book), ("level", level))
        node = np.concatenate([g for _, g in groups])
        kinds = np.repeat([k for k, _ in groups], [len(g) for _, g in groups])
        outcome_of = np.concatenate([np.full(len(manifest), -1), np.arange(len(outcome)), in_outcome, in_outcome[in_book]])
        manifest_of = np.concatenate([np.arange(len(manifest)), in_manifest, in_manifest[in_outcome], in_manifest[in_outcome[in_book]]])
        up = np.concatenate([np.full(len(manifest), -1), manifest[in_manifest], outcome[in_outcome], book[in_book]])
        book_of = np.concatenate([np.full(len(manifest) + len(outcome), -1), np.arange(len(book)), in_book])
        tail = len(node) - len(level)
        pad = lambda a, fill: np.concatenate([np.full(tail, fill), a])
        ticker = child["ticker"][outcome]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.string()),
                ids.take(pa.array(x.record[node])),
                pa.array(number[node], pa.int32()),
                pa.array(number[up], pa.int32(), mask=up < 0),
                _text_of(x, event[manifest_of]),
                _text_of(x, np.where(outcome_of >= 0, ticker[outcome_of] if len(ticker) else -1, -1)),
                pa.array((x.index[outcome] + 1)[outcome_of] if len(outcome) else np.zeros(len(node)), pa.int32(), mask=outcome_of < 0),
                pa.array(book_no[book_of] if len(book) else np.zeros(len(node)), pa.int32(), mask=book_of < 0),
                pa.array(np.concatenate([np.full(tail, None), side]), pa.string()),
                pa.array(pad(x.index[level] + 1, -1), pa.int32(), mask=np.arange(len(node)) < tail),
                pa.array(np.rint(pad(price, 0) * 10_000).astype(np.int64), mask=np.arange(len(node)) < tail),
                pa.array(pad(size, np.nan), mask=~np.isfinite(pad(size, np.nan))),
            ],
            names=["kind", "line_id", "node", "parent", "event_ticker", "ticker", "outcome_no", "book_no", "side", "level_no", "price_tt", "size"],
        )


def game_tables(lines: DataFrame) -> DataFrame:
    """GamePairManifest payloads as flat linked rows: kind is manifest, outcome, book or level.

    (line_id, parent) of a row names its parent's (line_id, node); manifests have none. Records
    may stand alone, in a list or under ``manifests``, with their event in ``game`` or not; an
    outcome's books in ``book``, ``books`` or ``depth``. ``book_no``, ``level_no`` and
    ``outcome_no`` are places from 1 with nulls counted; a single book is 1. A level is a list
    that starts with a price or an object with one, as number or text; levels that are null or
    have no price give no row, nor do unreadable, cut, empty or null payloads. Of a key that
    occurs twice in an object the last counts. Repeated lines are separate lines.
    """
    return lines.select("line_id", "payload").mapInArrow(_flat, FLAT)

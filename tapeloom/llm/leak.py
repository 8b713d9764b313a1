"""Evaluation passages that leaked into training pages, found through the damage of scanning.

Both sides are reduced to small letters and digits, so that case, punctuation, spacing, breaks
inside words and wrongly decoded characters leave no trace. Pages are read down their columns. A
Wu-Manber search over all columns of a batch at once finds exact pieces of the items; where enough
of an item could be there, its words are followed along the column from each piece, over misread
words and over lines that do not belong to it, on all paths at once.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A case has this many consecutive words, of which one in so many may be misread.
WORDS, MISREAD_IN = 24, 8
#: Length of the test strings, their distance in an item, the block of the shift table.
LENGTH, EVERY, BLOCK = 12, 3, 4
#: Length of the pieces that are counted where test strings have been found.
PIECE = 5
#: Columns are apart by more than this many pixels between the left ends of lines.
GUTTER = 120
#: Words in a row that may be misread before one is read again.
IN_A_ROW = 3
BASE, GAP = 37, 36
CODE = np.full(256, GAP, np.int64)
CODE[97:123], CODE[48:58] = np.arange(26), np.arange(26, 36)
KEEP_BYTES = bytes(range(97, 123)) + bytes(range(48, 58))
DROP = bytes(b for b in range(256) if b not in KEEP_BYTES and b != 10)
FOUND = "doc_id bigint, item_id bigint, first_word int, n_words int, n_misread int"


@dataclass(frozen=True)
class Search:
    """How far the search goes.

    ``line``: the fewest letters that a line of a passage is taken to have. With so many or more,
    foreign lines behind every one of them, and one word in MISREAD_IN misread, no passage falls
    below the counts that the candidates must reach (:class:`Patterns`); 1 looks at every
    candidate. ``skip``: foreign lines that may lie between two lines of a passage; None is any
    number.
    """

    line: int = 20
    skip: int | None = None


EXACT = Search(line=1)


def letters(text: str) -> bytes:
    """Small ASCII letters and digits of a text, line ends kept."""
    return text.lower().encode("ascii", "ignore").translate(None, DROP)


class _Symbols(dict):
    """Letters of scripts other than Latin as one of 36 symbols each; everything else but line ends goes."""

    def __missing__(self, point: int) -> str | None:
        char = chr(point)
        own = point >= 0x370 and not 0x1E00 <= point < 0x1F00 and char.isalpha()
        self[point] = chr((97 + point % 36) if point % 36 < 26 else (22 + point % 36)) if own else "\n" if char == "\n" else None
        return self[point]


_SYMBOLS = _Symbols()


def beyond(text: str) -> bytes:
    """The letters of other scripts than Latin as symbols, line ends kept."""
    return text.lower().translate(_SYMBOLS).encode()


def scripts_beyond(text: str) -> bool:
    """Whether a text is mostly of another script than Latin."""
    return not text.isascii() and len(beyond(text)) > len(letters(text))


@dataclass
class Item:
    """An evaluation item: its letters, and where its words begin in them."""

    item_id: int
    stream: bytes
    bounds: list[int]  # of its words, ending with the stream's length
    latin: bool = True

    @staticmethod
    def of(item_id: int, text: str) -> Item:
        """Words are set apart by white space; an ideograph is a word of its own."""
        latin = not scripts_beyond(text)
        parts = [w for w in text.split() if any(c.isalnum() for c in w)]
        if latin:
            words = [letters(w) for w in parts]
        else:
            words = [beyond(x) for w in parts for x in re.findall("[\u2e80-\u9fff]|[^\u2e80-\u9fff]+", w)]
            words = [w for w in words if w]
        bounds = [0]
        for w in words:
            bounds.append(bounds[-1] + len(w))
        return Item(item_id, b"".join(words), bounds, latin)


@dataclass(frozen=True)
class Pieces:
    """An item's pieces, and for every stretch of WORDS words how many of them no damage can take.

    ``fewest`` counts without ends of lines, which take ``at_ends`` more; ``some`` are those at every EVERY letters.
    """

    code: np.ndarray
    first: np.ndarray
    end: np.ndarray
    fewest: np.ndarray
    at_ends: np.ndarray
    some_first: np.ndarray
    some_end: np.ndarray
    fewest_some: np.ndarray


class Patterns:
    """The items' test strings in Wu-Manber tables.

    ``shift`` says by block how far the window may move on, 0 where a test string could end;
    strings are in buckets by their last block, in order of their whole code, which is exact
    (``BASE ** LENGTH`` fits a machine word).
    """

    def __init__(self, items: list[Item], search: Search = Search()):
        self.items, self.search_for = items, search
        need = [self._fewest_strings(it, search.line) for it in items]
        self.need = np.concatenate([*need, np.ones(1, np.int64)])
        self.need_at = np.cumsum([0, *[len(n) for n in need]])
        self.pieces = [self._pieces(it, search.line) for it in items]
        # Letters from the first test string of a stretch of WORDS words to its last, by item.
        self.reach = np.array([max(b - a for a, b in zip(it.bounds, it.bounds[min(WORDS, len(it.bounds) - 1) :])) - LENGTH for it in items] or [0])
        code, item, offset = [], [], []
        for i, it in enumerate(items):
            x = CODE[np.frombuffer(it.stream, np.uint8)]
            at = np.arange(0, max(len(x) - LENGTH + 1, 0), EVERY)
            code.append(coded(x, LENGTH)[at] if len(at) else np.zeros(0, np.int64))
            item.append(np.full(len(at), i))
            offset.append(at)
        self.code, self.item, self.offset = (np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64) for a in (code, item, offset))
        order = np.lexsort((self.code, self.code % BASE**BLOCK))
        self.code, self.item, self.offset = self.code[order], self.item[order], self.offset[order]
        self.suffix = self.code % BASE**BLOCK
        far = LENGTH - BLOCK + 1
        self.shift = np.full(BASE**BLOCK, far, np.int8)
        for k in range(far):  # a block that ends k characters before a string's end
            np.minimum.at(self.shift, self.code // BASE**k % BASE**BLOCK, k)
        self.bucket = np.searchsorted(self.suffix, np.arange(BASE**BLOCK + 1)).astype(np.int32)

    @staticmethod
    def _windows(item: Item) -> tuple[np.ndarray, np.ndarray]:
        """(first letter, one behind the last) of every stretch of WORDS words."""
        bounds = np.array(item.bounds)
        return bounds[: len(bounds) - WORDS], bounds[WORDS:]

    @classmethod
    def _fewest_strings(cls, item: Item, line: int) -> np.ndarray:
        """By test string, how many are left, itself among them, of a stretch of WORDS words that starts up to half of one before it.

        Every line that is whole and without a misread word holds some.
        """
        strings = max(len(item.stream) - LENGTH, 0) // EVERY + 1
        each = (line - LENGTH - EVERY + 1) // EVERY + 1
        if each < 1:
            return np.ones(strings, np.int64)
        a, b = cls._windows(item)
        left = np.maximum(((b - a) // line - WORDS // MISREAD_IN - 1) * each, 1)
        low = np.searchsorted(a, np.arange(strings) * EVERY - (b - a).max(initial=0) // 2)
        high = np.searchsorted(a, np.arange(strings) * EVERY, side="right")
        return np.array([left[i:j].min(initial=left.max(initial=1)) for i, j in zip(low, high)], np.int64)

    @classmethod
    def _pieces(cls, item: Item, line: int) -> Pieces:
        """A misread word takes the pieces of its letters and those that reach into it, a line's end with other lines behind it those across it."""
        a, b = cls._windows(item)
        x = CODE[np.frombuffer(item.stream, np.uint8)]
        size = np.diff(item.bounds)
        wrong, around = WORDS // MISREAD_IN, PIECE - 1
        worst = np.array([np.sort(size[k : k + WORDS])[-wrong:].sum() for k in range(len(a))], np.int64)
        end, lines = np.maximum(b - around, a), (b - a) // max(line, 1)
        some, some_end = -(-a // EVERY), -(-end // EVERY)
        fewest_some = some_end - some - (worst + around * wrong) // EVERY - 2 * wrong - (around // EVERY + 1) * lines
        return Pieces(coded(x, PIECE) & 0xFFFF, a, end, end - a - worst - around * wrong, around * lines, some, some_end, fewest_some)

    def search(self, x: np.ndarray, lane: int = 96) -> tuple[np.ndarray, np.ndarray]:
        """(start in ``x``, test string) of every occurrence of a test string in the codes ``x``."""
        last = len(x) - BLOCK
        if not len(self.code) or len(x) < LENGTH:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = coded(x, BLOCK)
        # The text is cut into lanes that are scanned side by side; a lane has the windows that end in it.
        front = np.arange(LENGTH - BLOCK, last + 1, lane)
        stop = np.minimum(front + lane, last + 1)
        hits = []
        while len(front):
            move = self.shift[blocks[front]].astype(np.int64)
            hits.append(front[move == 0])
            front = front + np.maximum(move, 1)
            going = front < stop
            front, stop = front[going], stop[going]
        end = np.concatenate(hits)
        start = end - (LENGTH - BLOCK)
        suffix = blocks[end]
        code = (blocks[start] * BASE**BLOCK + blocks[start + BLOCK]) * BASE**BLOCK + suffix
        # In its bucket the strings are in order: halve it until the code's place is found.
        low, high = self.bucket[suffix].astype(np.int64), self.bucket[suffix + 1].astype(np.int64)
        stop_at = high.copy()
        while (low < high).any():
            middle = (low + high) // 2
            less = (low < high) & (self.code[np.minimum(middle, len(self.code) - 1)] < code)
            low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
        out_start, out_string = [], []
        here = np.flatnonzero(low < stop_at)
        at = low[here]
        while len(here):  # direct comparison; the same string may belong to several items
            same = self.code[at] == code[here]
            here, at = here[same], at[same]
            out_start.append(start[here])
            out_string.append(at)
            at = at + 1
            inside = at < stop_at[here]
            here, at = here[inside], at[inside]
        return (np.concatenate(out_start), np.concatenate(out_string)) if out_start else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def coded(x: np.ndarray, size: int) -> np.ndarray:
    """The code of the ``size`` characters that start at each place."""
    out = x[: max(len(x) - size + 1, 0)].copy()
    for k in range(1, size):
        out = out * BASE + x[k : len(x) - size + 1 + k]
    return out


@lru_cache(maxsize=20_000)
def _places(word: bytes) -> dict[int, int]:
    """Where each letter stands in a word, as bits."""
    out: dict[int, int] = {}
    for i, x in enumerate(word):
        out[x] = out.get(x, 0) | 1 << i
    return out


def edits(a: bytes, b: bytes) -> int:
    """Edit distance, a column of the table at once in the bits of a number."""
    if not a or not b:
        return len(a) + len(b)
    places, top, whole = _places(a), 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, score = whole, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        flat = (((same & up) + up) ^ up) | same
        rises, falls = down | (whole & ~(flat | up)), up & flat
        score += bool(rises & top) - bool(falls & top)
        rises, falls = rises << 1 | 1, falls << 1
        same |= down
        up, down = (falls | ~(same | rises)) & whole, rises & same & whole
    return score


def alike(word: bytes) -> bytes:
    """The word with the letter pairs that scanning takes for one letter replaced by it."""
    for pair, one in ((b"vv", b"w"), (b"rn", b"m"), (b"cl", b"d"), (b"ii", b"u")):
        word = word.replace(pair, one)
    return word


@lru_cache(maxsize=50_000)
def misread(word: bytes, seen: bytes) -> bool:
    """Whether ``seen`` can be the word with some letters misread: half of it is still there, pairs that look like one letter counting as it."""
    word, seen = alike(word), alike(seen)
    return edits(word, seen) * 2 <= max(len(word), 2)


@dataclass
class Column:
    """Lines of one column of a page as one stream; ``ends`` are the ends of its lines."""

    stream: bytes
    ends: list[int]
    starts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.starts = [0, *self.ends[:-1]]

    def later(self, line: int, skip: int | None) -> list[int]:
        """Where the lines behind the one after ``line`` start."""
        return self.starts[line + 2 : None if skip is None else line + 2 + skip]


def _backwards(column: Column, item: Item) -> tuple[Column, Item]:
    n, m = len(column.stream), len(item.stream)
    return Column(column.stream[::-1], [n - s for s in reversed(column.starts)]), Item(item.item_id, item.stream[::-1], [m - b for b in reversed(item.bounds)])


def _resumptions(column: Column, ahead: bytes, low: int, high: int, skip: int | None) -> Iterator[int]:
    """The places from ``low`` to ``high`` where the item's next letters stand, or do up to a line's end and go on at the start of a later line."""
    text, ends = column.stream, column.ends
    if not ahead:
        yield from range(low, high + 1)
        return
    at = text.find(ahead, low, high + len(ahead))
    while at >= 0:
        yield at
        at = text.find(ahead, at + 1, high + len(ahead))
    line = bisect.bisect_left(ends, low)
    while line < len(ends) and ends[line] - len(ahead) < high:
        for r in range(max(low, ends[line] - len(ahead) + 1), min(high, ends[line]) + 1):
            have = ends[line] - r
            if text.startswith(ahead[:have], r) and any(text.startswith(ahead[have:], q) for q in column.later(line, skip)):
                yield r
        line += 1


def _wrong(words: list[bytes], seen: bytes) -> int | None:
    """How many of the words are misread if ``seen`` stands for them; None if it cannot."""
    if len(words) == 1:
        return 0 if words[0] == seen else 1 if misread(words[0], seen) else None
    best = None
    first = words[0]
    for size in range(max(len(first) - len(first) // 2 - 1, 0), min(len(first) + len(first) // 2 + 1, len(seen)) + 1):
        here = 0 if first == seen[:size] else 1 if misread(first, seen[:size]) else None
        rest = None if here is None else _wrong(words[1:], seen[size:])
        if rest is not None and (best is None or here + rest < best):
            best = here + rest
    return best


def follow(column: Column, item: Item, p: int, w: int, skip: int | None = None) -> tuple[list[float], dict[int, dict[int, int]]]:
    """From letter ``p`` of the column the words of the item from ``w`` on, on all paths.

    Returns the fewest misread among the first n words for every n (infinite where no path has so
    many), and the places that paths went through, by word. A word may stand as it is, go on at the
    start of any later line where its line ends, or be misread, with up to IN_A_ROW in a row before
    one is read again; a path that ends in a misread word counts without it, unless one letter of
    four or more is wrong or the item ends there.
    """
    text, said, bounds, ends = column.stream, item.stream, item.bounds, column.ends
    last, first = len(bounds) - 1, w
    most = last // MISREAD_IN
    states: dict[int, dict[int, int]] = {w: {p: 0}}
    fewest = [math.inf] * (last - w + 1)
    fewest[0] = 0

    def reach(word: int, place: int, bad: int) -> None:
        if bad <= most:
            at = states.setdefault(word, {})
            at[place] = min(at.get(place, bad), bad)
            fewest[word - first] = min(fewest[word - first], bad)

    while w < last:
        for p, bad in states.get(w, {}).items():
            word = said[bounds[w] : bounds[w + 1]]
            found = text.startswith(word, p)
            if found:
                reach(w + 1, p + len(word), bad)
            line = bisect.bisect_left(ends, p)
            have = ends[line] - p if line < len(ends) else len(word)
            if have < len(word) and text.startswith(word[:have], p):  # on at the start of a later line
                rest = said[bounds[w] + have : bounds[w] + have + max(len(word) - have, 8)]
                if len(rest) >= 4:
                    for q in column.later(line, skip):
                        if text.startswith(rest, q):
                            reach(w + 1, q + len(word) - have, bad)
            if found or bad == most:
                continue
            for k in range(1, min(IN_A_ROW, last - w) + 1):  # misread, until what follows is there again
                if bad + k > most:
                    break
                stop = bounds[w + k]
                ahead, size = said[stop : stop + 6], stop - bounds[w]
                slack = max(size // 2, 3)
                for r in _resumptions(column, ahead, p + max(size - slack, 1), min(p + size + slack, len(text)), skip):
                    wrong = _wrong([said[bounds[w + i] : bounds[w + i + 1]] for i in range(k)], text[p:r])
                    if wrong is not None:
                        reach(w + k, r, bad + wrong)
            if have <= len(word) + 2:
                for q, wrong in _over(column, item, w, p, line, skip):
                    reach(w + 1, q, bad + wrong)
            half = len(word) // 2
            if len(word) >= 4 and (text.startswith(word[:half], p) or text.find(word[half:], p, p + len(word) + 1) >= 0) and min(edits(word, text[p : p + n]) for n in (len(word) - 1, len(word), len(word) + 1)) == 1:
                fewest[w + 1 - first] = min(fewest[w + 1 - first], bad + 1)
        w += 1
    return fewest, states


def _over(column: Column, item: Item, w: int, p: int, line: int, skip: int | None) -> Iterator[tuple[int, int]]:
    """Where the stream may go on after a misread word that is broken by a line's end, or stands behind it, with other lines between."""
    word = item.stream[item.bounds[w] : item.bounds[w + 1]]
    ahead = item.stream[item.bounds[w + 1] : item.bounds[w + 1] + 5]
    if not ahead:
        return
    head = column.stream[p : column.ends[line]] if line < len(column.ends) else b""
    near = max(len(word) // 2, 2)
    sizes = range(max(len(word) - len(head) - near, 0), len(word) - len(head) + near + 1)
    for q in column.later(line, skip):
        at = column.stream.find(ahead, q + sizes[0], q + sizes[-1] + len(ahead)) if len(sizes) else -1
        if at >= 0 and misread(word, head + column.stream[q:at]):
            yield at, 1


def longest_case(ahead: list[float], behind: list[float]) -> tuple[int, int, int] | None:
    """(words behind, words ahead, misread) of the longest stretch around a word's start that makes a case."""
    if len(ahead) + len(behind) - 2 < WORDS:
        return None
    a, b = np.array(ahead), np.array(behind)
    if np.flatnonzero(np.isfinite(a))[-1] + np.flatnonzero(np.isfinite(b))[-1] < WORDS:
        return None
    size = np.arange(len(b))[:, None] + np.arange(len(a))
    bad = b[:, None] + a
    good = (size >= WORDS) & (bad * MISREAD_IN <= size)
    if not good.any():
        return None
    score = np.where(good, size * (WORDS * WORDS) - np.where(good, bad, 0), -1)
    j, i = np.unravel_index(int(score.argmax()), score.shape)
    return int(j), int(i), int(bad[j, i])


class Follower:
    """The case of one item in one column, from any of its pieces; places already passed are not gone over again."""

    def __init__(self, column: Column, item: Item, skip: int | None):
        self.column, self.item, self.skip = column, item, skip
        self.back = _backwards(column, item)
        self.passed: set[tuple[int, int]] = set()

    def case(self, p: int, o: int) -> tuple[int, int, int] | None:
        """(first word, number, misread) of the case around letter ``p``, where the item's letter ``o`` stands."""
        w = bisect.bisect_left(self.item.bounds, o)
        if self.item.bounds[w] > o + LENGTH:
            w -= 1
        start = p + self.item.bounds[w] - o
        if (w, start) in self.passed:
            return None
        ahead, seen = follow(self.column, self.item, start, w, self.skip)
        n, words = len(self.column.stream), len(self.item.bounds) - 1
        behind, before = follow(*self.back, n - start, words - w, self.skip)
        self.passed.update((word, place) for word, places in seen.items() for place in places)
        self.passed.update((words - word, n - place) for word, places in before.items() for place in places)
        found = longest_case(ahead, behind)
        return (w - found[0], found[0] + found[1], found[2]) if found else None


def columns_of(page: np.ndarray, x0: np.ndarray) -> np.ndarray:
    """The column of each line, as the number of a cluster of left ends (unique over all pages)."""
    order = np.lexsort((x0, page))
    new = np.ones(len(page), bool)
    new[1:] = (page[order][1:] != page[order][:-1]) | (x0[order][1:] - x0[order][:-1] > GUTTER)
    out = np.empty(len(page), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def page_columns(texts: list[str | None], boxes: pa.Array, reduce=letters) -> tuple[list[Column], list[int]]:
    """The columns of every page, and whose each is. Where boxes are lost, the page's lines are one column in which those of others may lie between."""
    bounds = boxes.offsets.to_numpy() - boxes.offsets[0].as_py() if len(boxes) else np.zeros(1, int)
    x0 = boxes.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(bounds)
    page = np.repeat(np.arange(len(texts)), sizes)
    cluster = columns_of(page, np.nan_to_num(x0.astype(float)))
    out, owner = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        lines = reduce(text).split(b"\n")
        groups: dict[int, list[bytes]] = {}
        if sizes[i] == len(lines):
            for line, c in zip(lines, cluster[bounds[i] : bounds[i + 1]].tolist()):
                groups.setdefault(c, []).append(line)
        else:
            groups[0] = lines
        for group in groups.values():
            ends = np.cumsum([len(g) for g in group]).tolist()
            if ends[-1] >= LENGTH:
                out.append(Column(b"".join(group), ends))
                owner.append(i)
    return out, owner


def crowded(column: np.ndarray, item: np.ndarray, offset: np.ndarray, patterns: Patterns) -> np.ndarray:
    """Which occurrences belong to a column and an item with enough different test strings in some stretch of WORDS words."""
    pair = column * len(patterns.items) + item
    far = patterns.reach.max(initial=1) * 2 + patterns.offset.max(initial=0) + 1
    key = np.unique(pair * far + offset)
    of = key // far % len(patterns.items)
    there = np.searchsorted(key, key + patterns.reach[of], side="right") - np.arange(len(key))
    good = np.unique((key // far)[there >= patterns.need[patterns.need_at[of] + key % far // EVERY]])
    return np.flatnonzero(np.isin(pair, good))


def _across(column: Column) -> np.ndarray:
    """The pieces of a column that begin at the end of a line and go on at the start of any other."""
    x = np.concatenate([np.full(PIECE, GAP), CODE[np.frombuffer(column.stream, np.uint8)], np.full(PIECE, GAP)])
    ends, starts = np.array(column.ends) + PIECE, np.array(column.starts) + PIECE
    out = []
    for k in range(1, PIECE):
        head, tail = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        for i in range(k):
            head = head * BASE + x[ends - k + i]
        for i in range(PIECE - k):
            tail = tail * BASE + x[starts + i]
        out.append((head[:, None] * BASE ** (PIECE - k) + tail).ravel())
    return np.concatenate(out) & 0xFFFF


def plausible(columns: list[Column], x: np.ndarray, begins: np.ndarray, column: np.ndarray, item: np.ndarray, patterns: Patterns, at_once: int = 512, most_lines: int = 200) -> np.ndarray:
    """Which pairs (column, item) hold, in any order, enough pieces of some stretch of WORDS words.

    First some of the pieces are looked for, then all, then those across the ends of lines, too,
    which count as lost until then (and in columns of more than ``most_lines`` lines for good).
    Pieces are told by 16 bits, so that no pair is lost.
    """
    good = np.zeros(len(column), bool)
    bounds = np.append(begins, len(x) + 1)
    for low in range(0, len(begins), at_once):
        here = np.flatnonzero((column >= low) & (column < low + at_once))
        if not len(here):
            continue
        high = min(low + at_once, len(begins))
        piece = coded(x[bounds[low] : bounds[high] - 1], PIECE) & 0xFFFF
        holds = np.zeros((high - low, 1 << 16), bool)
        holds[np.searchsorted(begins[low:high] - begins[low], np.arange(len(piece)), side="right") - 1, piece] = True
        here = here[np.argsort(item[here], kind="stable")]
        groups = np.split(here, np.flatnonzero(np.diff(item[here])) + 1)
        left = []
        for group in groups:
            p = patterns.pieces[item[group[0]]]
            group = group[_enough(holds, column[group] - low, p.code[::EVERY], p.some_first, p.some_end, p.fewest_some)]
            left.append(group[_enough(holds, column[group] - low, p.code, p.first, p.end, p.fewest - p.at_ends)] if len(group) else group)
        short = np.zeros(high - low, bool)
        for c in np.unique(np.concatenate([column[g] for g in left])).tolist():
            if len(columns[c].ends) <= most_lines:
                short[c - low] = True
                holds[c - low, _across(columns[c])] = True
        for group in left:
            if len(group):
                p = patterns.pieces[item[group[0]]]
                own = column[group] - low
                good[group] = _enough(holds, own, p.code, p.first, p.end, p.fewest - np.where(short[own], 0, 1)[:, None] * p.at_ends)
    return good


def _enough(holds: np.ndarray, column: np.ndarray, code: np.ndarray, first: np.ndarray, end: np.ndarray, fewest: np.ndarray) -> np.ndarray:
    """Which columns hold the fewest pieces of some stretch."""
    total = np.zeros((len(column), len(code) + 1), np.int16 if len(code) < 1 << 15 else np.int64)
    np.cumsum(holds[column[:, None], code], axis=1, out=total[:, 1:])
    return (total[:, np.minimum(end, len(code))] - total[:, np.minimum(first, len(code))] >= np.maximum(fewest, 0)).any(axis=1)


def leaks(texts: list[str | None], boxes: pa.Array, patterns: Patterns, reduce=letters) -> list[tuple[int, int, int, int, int]]:
    """(page, item, first word, words, misread) of every case on some pages."""
    columns, owner = page_columns(texts, boxes, reduce)
    if not columns or not patterns.items:
        return []
    x = CODE[np.frombuffer(b"\n".join(c.stream for c in columns), np.uint8)]
    begins = np.cumsum([0, *[len(c.stream) + 1 for c in columns[:-1]]])
    start, string = patterns.search(x)
    column = np.searchsorted(begins, start, side="right") - 1
    place, item, offset = start - begins[column], patterns.item[string], patterns.offset[string]
    keep = crowded(column, item, offset, patterns)
    column, item, place, offset = column[keep], item[keep], place[keep], offset[keep]
    pair, owned = np.unique(column * len(patterns.items) + item, return_inverse=True)
    keep = np.flatnonzero(plausible(columns, x, begins, pair // len(patterns.items), pair % len(patterns.items), patterns)[owned])
    column, item, place, offset = column[keep], item[keep], place[keep], offset[keep]
    order = np.lexsort((offset, place - offset, item, column))
    column, item, place, offset = column[order], item[order], place[order], offset[order]
    diagonal = place - offset
    first = np.ones(len(column), bool)
    first[1:] = (column[1:] != column[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])
    at = np.flatnonzero(first)
    many = np.diff(np.append(at, len(column)))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    followers: dict[tuple[int, int], Follower] = {}
    for k in at[np.argsort(-many, kind="stable")].tolist():
        c, i = int(column[k]), int(item[k])
        key = (owner[c], i)
        if key not in best:
            follower = followers.setdefault((c, i), Follower(columns[c], patterns.items[i], patterns.search_for.skip))
            found = follower.case(int(place[k]), int(offset[k]))
            if found:
                best[key] = found
    return [(page, i, *found) for (page, i), found in best.items()]


def load_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Item]:
    """The evaluation items with enough words; null texts leak nowhere."""
    rows = items.select(items[item_id].cast("bigint").alias("i"), items[text].alias("t")).where(F.col("t").isNotNull() & F.col("i").isNotNull()).collect()
    made = [Item.of(r.i, r.t) for r in rows]
    return [m for m in made if len(m.bounds) > WORDS]


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: str = "lines", item_block: int = 20_000, search: Search = Search(), most_items: int = 2_000_000) -> DataFrame:
    """Pages and the items they leak: (doc_id, item_id, first_word, n_words, n_misread).

    A case is a page and an item of which WORDS or more consecutive words stand in one column of
    the page, read down, one word in MISREAD_IN at most misread; other words in their place or
    another order end the stretch. The longest stretch is reported. Items of fewer words, and
    null, empty and blank texts, have no cases; repeated pages and items have theirs each. Items
    mostly of another script than Latin are sought among the page's letters of such scripts. The
    items, a held-out set, are sent to the executors in blocks of ``item_block``, one pass over
    the pages for each; more than ``most_items`` of them are an error. ``search`` says how far it
    goes, :data:`EXACT` to the end.
    """
    spark = documents.sparkSession
    if items.count() > most_items:
        raise ValueError(f"more than {most_items} evaluation items")
    every = load_items(items)
    pages = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text"), documents[lines]["x0"].alias("left_ends")).where("length(text) > 0")
    out = spark.createDataFrame([], FOUND)
    for latin in (True, False):
        some = [i for i in every if i.latin is latin]
        for k in range(0, len(some), item_block):
            sent = spark.sparkContext.broadcast(Patterns(some[k : k + item_block], search))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, reduce=letters if latin else beyond) -> Iterator[pa.RecordBatch]:
                patterns = sent.value
                for batch in batches:
                    for at in range(0, batch.num_rows, 512):
                        part = batch.slice(at, 512)
                        found = leaks(part.column(1).to_pylist(), part.column(2), patterns, reduce)
                        ids = part.column(0).to_pylist()
                        rows = [(ids[p], patterns.items[i].item_id, a, n, bad) for p, i, a, n, bad in found]
                        columns = list(zip(*rows)) or [[]] * 5
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "first_word", "n_words", "n_misread"])

            out = out.unionByName(pages.mapInArrow(run, FOUND))
    return out

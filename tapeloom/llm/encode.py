"""Token ids of whole texts by a public byte-level BPE vocabulary, speculated and verified in bulk."""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; TAPELOOM_TOKENIZERS or a parameter says otherwise.
TOKENIZER_DIR = os.environ.get("TAPELOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the public vocabulary splits a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
IDS = "doc_id bigint, ids array<int>"
#: A worker forgets its words when it knows so many, or so many letters of them; this bounds memory and changes no result.
KNOWN_WORDS, KNOWN_LETTERS = 400_000, 1 << 24
NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a vocabulary of ranks, by id."""
    with open(path, "rb") as f:
        ranks = {int(i): base64.b64decode(word) for word, i in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


class Vocabulary:
    """A vocabulary as arrays: a trie for longest matches, merges by pair, and each token's own split."""

    def __init__(self, tokens: list[bytes]):
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.longest_token = max(map(len, tokens))
        nodes, edges, accepts = {b"": 0}, [], [-1]
        for i, t in enumerate(tokens):
            at = 0
            for k in range(1, len(t) + 1):
                node = nodes.get(t[:k])
                if node is None:
                    node = nodes[t[:k]] = len(accepts)
                    edges.append((at * 256 + t[k - 1], node))
                    accepts.append(-1)
                at = node
            accepts[at] = i
        edges.sort()
        self.edge, self.to = (np.array(c, np.int64) for c in zip(*edges))
        self.accepts = np.array(accepts, np.int64)
        self.root = np.full(256, -1, np.int64)
        first = self.edge < 256
        self.root[self.edge[first]] = self.to[first]
        self.left = np.arange(len(tokens))
        self.right = np.arange(len(tokens))
        for i, t in enumerate(tokens):
            if len(t) > 1:
                parts = self.merge(t, i)
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
        made = np.flatnonzero(self.left != np.arange(len(tokens)))
        pair = self.left[made] << 32 | self.right[made]
        order = np.argsort(pair)
        self.pair, self.made = pair[order], made[order]

    def merge(self, word: bytes, below: int = NONE) -> list[int]:
        """Exact merging: the adjacent pair whose union has the least id (under ``below``) is united, the first of equals, until there is none.

        Pairs wait in a heap by id and place, parts are a linked list; so a word of n bytes takes
        n log n steps.
        """
        get, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [get(word[k : k + 2], NONE) for k in range(n - 1)] + [NONE]  # by a part's start: what it and the next one make
        heap = [(r, k) for k, r in enumerate(due) if r < below]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if due[k] != r:
                continue
            gone = after[k]
            due[gone] = NONE
            stop = after[k] = after[gone]
            if stop < n:
                before[stop] = k
            for at, end in ((k, after[stop] if stop < n else n), (before[k], stop)):
                if at < 0:
                    continue
                due[at] = r = get(word[at:end], NONE) if end - at <= self.longest_token and (at != k or stop < n) else NONE
                if r < below:
                    heapq.heappush(heap, (r, at))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[word[k : after[k]]])
            k = after[k]
        return out

    def united(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a pair of tokens merges into, or NONE."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, self.made[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens gives these two tokens.

        The merges that made both are undone, latest first; if at any stage the parts that meet
        at the border would have been united before the merge that was just undone, the border
        would not have survived.
        """
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NONE)
        while len(live):
            broken = self.united(a, b) < limit
            fine[live[broken]] = False
            a, b, live = a[~broken], b[~broken], live[~broken]
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            undo_a = ~whole_a & ((a > b) | whole_b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a | whole_b, b, self.left[b])
            going = ~(whole_a & whole_b)
            a, b, live, limit = a[going], b[going], live[going], limit[going]
        return fine

    def longest(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of the words in ``data``: (ids, number of ids of each word)."""
        n = len(data)
        stop = np.repeat(bounds[1:], np.diff(bounds))
        node, at = self.root[data], np.arange(n)
        token, size = self.accepts[node], np.ones(n, np.int64)
        k = 1
        while len(at):
            inside = at + k < stop[at]
            at, node = at[inside], node[inside]
            key = node * 256 + data[at + k]
            place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            found = self.edge[place] == key
            at, node = at[found], self.to[place[found]]
            k += 1
            good = self.accepts[node] >= 0
            token[at[good]], size[at[good]] = self.accepts[node[good]], k
        starts, border = np.zeros(n, bool), np.zeros(n + 1, bool)
        border[bounds] = True
        front = bounds[:-1][np.diff(bounds) > 0]
        while len(front):
            starts[front] = True
            front = front + size[front]
            front = front[~border[front]]
        where = np.flatnonzero(starts)
        return token[where], np.diff(np.searchsorted(where, bounds))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words: (ids one after another, bounds by word)."""
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        ids, counts = self.longest(np.frombuffer(b"".join(words), np.uint8), bounds)
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(words)), counts)
        same = owner[1:] == owner[:-1]
        left, right = ids[:-1][same], ids[1:][same]
        wrong = np.unique(owner[1:][same][~self.compatible(left, right)])
        if len(wrong):
            parts = np.split(ids, ends[:-1])
            for w in wrong.tolist():
                parts[w] = np.array(self.merge(words[w]))
            counts = np.array([len(p) for p in parts])
            ids, ends = np.concatenate(parts), np.cumsum(counts)
        return ids.astype(np.int32), np.concatenate([[0], ends]).astype(np.int64)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


class Encoder:
    """Encodes batches of texts and remembers the ids of the words it has met."""

    def __init__(self, words: Vocabulary):
        self.vocabulary, self.find = words, regex.compile(WORDS).findall
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.letters = 0
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by text); an empty and a null text have none."""
        if len(self.code) > KNOWN_WORDS or self.letters > KNOWN_LETTERS:
            self.forget()
        found = [self.find(t) if t else [] for t in texts]
        code, new = self.code, []
        for w in set(chain.from_iterable(found)):
            if w not in code:
                code[w] = len(code)
                self.letters += len(w)
                new.append(w.encode())
        if new:
            ids, bounds = self.vocabulary.encode_words(new)
            self.ids = np.concatenate([self.ids, ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        sizes = np.array([len(f) for f in found])
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        start, count = self.bounds[codes], self.bounds[codes + 1] - self.bounds[codes]
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(start - ends[:-1], count) + np.arange(ends[-1])]
        return flat, ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]


def token_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Ids of every text exactly as stored, without special tokens: (doc_id, ids).

    A special token's spelling inside a text is ordinary text. Empty and null texts have an empty
    list, blank ones the ids of their blanks; a row with a null doc_id stays. Repeated rows are
    encoded each. Greedy longest matches are proposed for all new words of a batch at once, every
    adjacent pair is tested for compatibility, and only words that fail are merged exactly. The
    vocabulary is read on the driver and sent out once (its size is fixed).
    """
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, bounds = encoder(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text")).mapInArrow(run, IDS)

"""Queries p7 to p10: against SQL, a public library, brute force and round trips."""

from __future__ import annotations

import base64
import random
import time
from functools import lru_cache

import numpy as np
import oracle
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.llm import encode, garble, leak, nearest
from tapeloom.llm import queries as plans

RANKS = f"{encode.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
MINUTE = 60_000_000


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, small, name):
    assert oracle.compare(spark, duck, name, small) == ""


# --- p7


def paired(spark, lefts, rights, **how):
    schema = "entity string, t bigint, id bigint, shard int, k1 string"
    return rows(nearest.replay(spark.createDataFrame(lefts, schema), spark.createDataFrame(rights, schema), 10 * MINUTE, **how))


def brute(lefts, rights):
    out = []
    for e, t, i, *_ in lefts:
        near = [(abs(t - u), u, j) for f, u, j, *_ in rights if None not in (e, t, u) and e == f and abs(t - u) <= 10 * MINUTE]
        if near:
            gap, _, j = min(near)
            out.append((i, j, gap))
    return sorted(out, key=repr)


@pytest.mark.parametrize("file_rows", [1_000_000, 9])
@pytest.mark.parametrize("heavy", [{}, {"a": 3}])
def test_nearest_against_brute_force(spark, monkeypatch, heavy, file_rows):
    rng = random.Random(2)
    monkeypatch.setattr(nearest, "heavy_entities", lambda right, shards, share=0: heavy)
    times = [600 * MINUTE + k * MINUTE for k in (-11, -10, -5, -1, 0, 1, 5, 10, 11, 25)] + [None, 3, 10 * MINUTE + 3, 10 * MINUTE + 4, -5, nearest.LAST_US + 1]
    make = lambda n, first: [(rng.choice(["a", "b", "c", None]), rng.choice(times), first + i, 0, "clash") for i in range(n)]
    lefts, rights = make(60, 0), make(60, 1000)
    in_range = lambda d: [r for r in d if r[1] is None or r[1] <= nearest.LAST_US]
    assert paired(spark, lefts, rights, file_rows=file_rows, files=1) == brute(in_range(lefts), in_range(rights))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_heavy_entities_are_spread(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 5)
    df = spark.createDataFrame([("a", 1, i) for i in range(30)] + [("b", 1, i) for i in range(60)] + [(f"c{i}", 1, i) for i in range(10)], "entity string, t bigint, id bigint")
    assert nearest.heavy_entities(df, 10, 0.2) == {"a": 6, "b": 10}


def test_nearest_of_nothing(spark):
    one = [("a", 5, 1, 0, "")]
    for a, b in ((one, []), ([], one), ([], [])):
        assert paired(spark, a, b) == []


def test_pairs_of_many_entities_against_brute_force():
    rng = np.random.default_rng(7)
    side = lambda n: np.column_stack([rng.integers(-2, 2, n), rng.integers(0, 2, n), rng.integers(0, 60, n), np.arange(n)])
    lefts, rights = side(80), side(50)
    got = nearest.nearest(lefts, rights, 4)
    want = []
    for a, b, t, i in lefts.tolist():
        near = [(abs(t - u), u, j) for c, d, u, j in rights.tolist() if (a, b) == (c, d) and abs(t - u) <= 4]
        want += [(i, min(near)[2])] if near else []
    assert sorted(zip(got["left_id"], got["right_id"])) == want
    assert not len(nearest.nearest(lefts, rights[:0], 4)) and not len(nearest.nearest(lefts[:0], rights, 4))


def test_state_is_emitted_and_evicted():
    class State:
        exists, now, value, timeout = False, 0, None, None

        def getCurrentWatermarkMs(self):
            return self.now

        def update(self, v):
            self.exists, self.value = True, v

        get = property(lambda self: self.value)

        def setTimeoutTimestamp(self, t):
            self.timeout = t

        def remove(self):
            self.exists, self.value = False, None

    import pandas as pd

    run, state = nearest._pair(10 * MINUTE), State()
    feed = lambda *r: list(run(None, iter([pd.DataFrame([(5, 6, *x) for x in r], columns=["k1", "k2", "t", "id", "is_left"])]), state))
    assert feed((30 * MINUTE, 1, True), (26 * MINUTE, 7, False)) == []
    assert feed((33 * MINUTE, 8, False)) == []
    state.now = 40 * 60_000
    assert list(run(None, iter([]), state)) == [] and state.exists  # the horizon is not passed yet
    state.now += 1
    out = list(run(None, iter([]), state))
    assert out[0].to_dict("records") == [{"left_id": 1, "left_t": 30 * MINUTE, "right_id": 8, "right_t": 33 * MINUTE, "gap": 3 * MINUTE}]
    state.now = 60 * 60_000
    assert list(run(None, iter([]), state)) == [] and not state.exists


# --- p8


@lru_cache
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=encode.WORDS, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    ids, bounds = encode.Encoder(encode.vocabulary(RANKS))(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


AWKWARD = [None, "", " ", "\n\n", "<|endoftext|>", "a" * 20_000, "don't I'll WE'VE", "naïve café — ½", "日本語のテキスト", "​\u0000 \t x", "́́", "👩‍👩‍👧", "aaaa bbbbbb 1234567890" * 50]


def test_ids_equal_the_public_library(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + AWKWARD
    assert ids_of(texts) == [public().encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeinorst hTHE'.,1\n")) | st.text(), max_size=5))
def test_ids_of_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert ids_of(texts) == [public().encode_ordinary(t) for t in texts]


def test_encoding_table(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (2, "", "x"), (None, "a b", "x")], "doc_id bigint, text string, ids string")
    two = public().encode_ordinary("a b")
    assert rows(encode.token_ids(df)) == sorted([(1, two), (2, []), (2, []), (None, two)], key=repr)
    assert rows(encode.token_ids(df.where("false"))) == []


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(encode, "KNOWN_WORDS", 3)
    e = encode.Encoder(encode.vocabulary(RANKS))
    for t in ("one two three four", "five six", "one six ten"):
        assert e([t])[0].tolist() == public().encode_ordinary(t)


def test_a_million_letters_without_a_blank():
    rng = random.Random(0)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    got = ids_of([word])[0]
    took, tokens = time.time() - began, encode.read_ranks(RANKS)
    same = b"".join(tokens[i] for i in got).decode() == word
    assert took < 20 and same
    short = word[:60_000] + "ab" * 20_000
    same = ids_of([short])[0] == public().encode_ordinary(short)
    assert same


# --- p9


WORDS = [a + b + c for a in ("bar", "kel", "mor", "tan", "vis", "dro") for b in ("an", "el", "is", "or", "um") for c in ("ton", "ford", "ley", "gate", "wick")]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def item_of(words):
    return "“" + " ".join(words).upper() + ".”"


def laid(words, width=5, broken=True):
    """Lines of a column, words broken at some ends."""
    lines, k = [], 0
    while k < len(words):
        part = words[k : k + width]
        k += width
        lines.append(" ".join(part))
    if broken:
        for i in range(0, len(lines) - 1, 2):
            first, _, rest = lines[i + 1].partition(" ")
            lines[i], lines[i + 1] = f"{lines[i]} {first[:3]}-", f"{first[3:]} {rest}"
    return lines


def scan(pages, items, search=leak.Search()):
    """pages: lists of (line, x0), or of lines without boxes."""
    texts = [None if p is None else "\n".join(x if isinstance(x, str) else x[0] for x in p) for p in pages]
    boxes = pa.array([None if p is None or any(isinstance(x, str) for x in p) else [x[1] for x in p] for p in pages], pa.list_(pa.int32()))
    patterns = leak.Patterns([i for i in (leak.Item.of(k, t) for k, t in enumerate(items)) if len(i.bounds) > leak.WORDS], search)
    return sorted((p, patterns.items[i].item_id, n) for p, i, _, n, _ in leak.leaks(texts, boxes, patterns))


def column(lines, x0):
    return [(line, x0) for line in lines]


def test_cases_and_what_is_none():
    rng = random.Random(4)
    item, other = passage(rng, 60), passage(rng, 40)
    filler = lambda n: passage(rng, n)
    adverts = ["COALS! COALS! COALS!", "Terms cash.", "apply Kelbarton, Visorwick."]
    full = laid(filler(10) + item[5:35] + filler(10))
    broken = full[:5] + adverts + full[5:]
    wrong = list(item[5:35])
    for k in (3, 14, 25):
        wrong[k] = wrong[k].replace("o", "®").replace("e", "c").replace("a", "o")
    shuffled = [w for k in (3, 1, 2, 0) for w in item[5 + k * 8 : 13 + k * 8]]
    swapped = [w if k % 6 else "qqqqzzzz" for k, w in enumerate(item[5:40])]
    twenty = filler(10) + item[5:28] + filler(10)
    far = column(laid(filler(30)), 900)
    mixed = [x for pair in zip(column(full, 100), far) for x in pair] + column(full, 100)[len(far) :]
    pages = [
        column(full, 100), column(broken, 100), column(laid(wrong + filler(12)), 100), column(laid(filler(9) + shuffled), 100),
        column(laid(filler(9) + swapped), 100), column(laid(twenty), 100), mixed, [x[0] for x in mixed], None, [("", 0)], [(" ", 0)],
        column(laid(item[:20]), 100) + column(laid(filler(4) + item[20:40]), 1200), column([" ".join(filler(3000) + item + filler(3000))], 5),
    ]
    got = scan(pages, [item_of(item), item_of(other), "", "too few words"])
    assert [(p, i) for p, i, _ in got] == [(0, 0), (1, 0), (2, 0), (6, 0), (7, 0), (12, 0)]
    assert all(n == 30 for p, _, n in got if p < 2)


def test_wrong_encoding_and_repeated_items_do_not_matter():
    rng = random.Random(8)
    words = [w.replace("e", "é") for w in passage(rng, 40)]
    garbled = " ".join(words).encode().decode("cp1252", "replace")
    assert [(p, i) for p, i, _ in scan([[(garbled, 0)]], [" ".join(words)] * 2)] == [(0, 0), (0, 1)]


def test_search_finds_every_occurrence():
    rng = random.Random(1)
    items = [leak.Item.of(k, " ".join(passage(rng, 30))) for k in range(6)]
    patterns = leak.Patterns(items)
    stream = b"|".join(leak.letters(" ".join(passage(rng, 200))) + items[k].stream for k in range(6))
    start, string = patterns.search(leak.CODE[np.frombuffer(stream, np.uint8)], lane=17)
    got = sorted(zip(start.tolist(), patterns.item[string].tolist(), patterns.offset[string].tolist()))
    want = []
    for i, o in zip(patterns.item.tolist(), patterns.offset.tolist()):
        text = items[i].stream[o : o + leak.LENGTH]
        k = stream.find(text)
        while k >= 0:
            want.append((k, i, o))
            k = stream.find(text, k + 1)
    assert got == sorted(want)


@pytest.mark.parametrize("copies", [1, 13, 30])
def test_strings_of_many_items_still_find_them(copies):
    rng = random.Random(11)
    item = passage(rng, 40)
    pages = []
    for a in range(2, 20):
        for b in range(a + 2, 22, 3):
            words = item[-24:]
            for k in (a, b):
                words[k] = words[k].replace(words[k][2], "x")
            pages.append(column(laid(passage(rng, 12) + words + passage(rng, 12), broken=False), 100))
    got = {(p, i) for p, i, _ in scan(pages, [item_of(item)] * copies)}
    alone = {p for p, _, _ in scan(pages, [item_of(item)])}
    assert len(alone) >= 0.9 * len(pages) and got == {(p, i) for p in alone for i in range(copies)}


def damaged(rng, word, hard=1):
    """A word with letters misread, or two of them run together."""
    for _ in range(hard):
        k = rng.randrange(len(word))
        word = word[:k] + rng.choice(["x", "q", "", "zz"]) + word[k + 1 :]
    return word


def planted(rng, item, n):
    """A page's lines with ``n`` words of the item, one in eight misread, lines between, broken words."""
    first = rng.randrange(len(item) - n + 1)
    words = item[first : first + n]
    for k in rng.sample(range(n), n // leak.MISREAD_IN):
        words[k] = damaged(rng, words[k])
    lines = laid(passage(rng, 7) + words + passage(rng, 9), width=rng.randrange(3, 7), broken=rng.random() < 0.5)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(lines))
        lines[k:k] = laid(passage(rng, rng.randrange(1, 80)), 4, broken=False)
    return lines


def brute_case(lines, item):
    """Whether a case stands in the lines: every start, every word, letter by letter, with lines in between skipped."""
    column = leak.Column(*_stream(lines))
    text = column.stream.decode()
    made = leak.Item.of(0, " ".join(item))
    for w in range(len(item)):
        at = text.find(item[w])
        while at >= 0:
            if leak.Follower(column, made, None).case(at, made.bounds[w]):
                return True
            at = text.find(item[w], at + 1)
    return False


def _stream(lines):
    parts = [leak.letters(x) for x in lines]
    return b"".join(parts), np.cumsum([len(p) for p in parts]).tolist()


def test_every_planted_case_is_found():
    rng = random.Random(21)
    items = [passage(rng, rng.randrange(30, 70)) for _ in range(12)]
    pages, true = [], set()
    for p in range(260):
        i = rng.randrange(len(items))
        lines = planted(rng, items[i], rng.randrange(26, len(items[i]) + 1))
        pages.append(column([x.replace(" ", "") if rng.random() < 0.05 else x for x in lines], 100))
        true.add((p, i))
    got = {(p, i) for p, i, _ in scan(pages, [item_of(x) for x in items])}
    exact = {(p, i) for p, i, _ in scan(pages, [item_of(x) for x in items], leak.EXACT)}
    assert got == exact and got <= true and len(got) >= 0.98 * len(true), len(got)
    for p, i in sorted(true):  # whatever is not found is none by brute force, either
        lines = [x[0] for x in pages[p]]
        assert ((p, i) in got) == brute_case([x.replace(" ", "") for x in lines], items[i])


def test_a_line_s_end_is_not_taken_for_a_jump():
    words = "notre maison est petite on sait que neuf cavaliers ont trouve la usine reparee chez la veuve malgre le froid on sait aussi que dix eleves ont trouve la porte fermee chez le maire".split()
    lines = ["notre maison est petite on sait", "que neuf cavaliers", "0nt trouve la usine reparee", "chez la veuve malgre le froid on", "sait aussi que dix eleves", "ont trouve la porte fermee chez le maire"]
    assert [(p, i) for p, i, _ in scan([column(lines, 0)], [" ".join(words)])] == [(0, 0)]


def test_other_scripts_are_found(spark):
    rng = random.Random(5)
    greek = ["".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    box = lambda n: [(k, 1, k, 2, k, 0.5) for k in range(n)]
    docs = [(1, " ".join(greek[4:36]).upper(), box(1)), (2, f"see: {cjk[5:40]}\n{cjk[40:50]} (end)", box(2)), (3, " ".join(greek[:20] + greek[25:]), box(1)), (4, "plain words", box(1))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lines array<struct<line_no: int, x0: int, y0: int, x1: int, y1: int, conf: float>>")
    items = spark.createDataFrame([(7, " ".join(greek)), (8, cjk)], "item_id bigint, text string")
    assert rows(leak.leaked(df, items).select("doc_id", "item_id")) == [(1, 7), (2, 8)]


def test_too_many_items_are_refused(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lines array<struct<x0: int>>")
    with pytest.raises(ValueError, match="more than 1"):
        leak.leaked(docs, spark.createDataFrame([(1, "a"), (2, "b")], "item_id bigint, text string"), most_items=1)


def test_leak_table(spark):
    rng = random.Random(6)
    item = passage(rng, 40)
    box = lambda n: [(k, 1, k, 2, k, 0.5) for k in range(n)]
    docs = spark.createDataFrame([(1, " ".join(item), box(1), 5), (1, " ".join(item), None, 5), (2, None, None, 5), (3, "", box(1), 5)], "doc_id bigint, text string, lines array<struct<line_no: int, x0: int, y0: int, x1: int, y1: int, conf: float>>, item_id int")
    items = spark.createDataFrame([(7, item_of(item), 1), (8, None, 1), (9, "", 1)], "item_id bigint, text string, doc_id int")
    assert rows(leak.leaked(docs, items).select("doc_id", "item_id", "n_words")) == [(1, 7, 40)] * 2
    assert rows(leak.leaked(docs.where("false"), items)) == rows(leak.leaked(docs, items.where("false"))) == []


# --- p10


@pytest.fixture(scope="module")
def corpus(spark):
    found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text", "lang")
    return found, garble.learn(found)


@pytest.fixture(scope="module")
def clean(corpus):
    found, model = corpus
    return [r for r in found.collect() if sum(c > "\x7f" for c in r.text) >= 4 and not [x for x in garble.label(r.text, model) if x[2]]]


def spoil(text, true, wrong, times):
    for _ in range(times):
        raw = b"".join(c.encode(true, "replace") for c in text)
        text = "".join(garble._decode(b, wrong) if b > 127 else chr(b) for b in raw)
    return text


@pytest.mark.parametrize("pair", [p for p in garble.PAIRS if p[0] != "utf-8 as latin-1"], ids=lambda p: p[0])
def test_whole_texts_are_found_and_restored(corpus, clean, pair):
    _, true, wrong, times = pair
    texts = [r.text for r in clean[:150] if true == "utf-8" or r.text.encode(true, "replace").decode(true) == r.text]
    bad = [spoil(t, true, wrong, times) for t in texts]
    labels = [[x for x in garble.label(b, corpus[1]) if x[2]] for b in bad]
    found = sum(map(bool, labels))
    same = sum(garble.restored(b, x) == t for b, x, t in zip(bad, labels, texts))
    assert found >= 0.98 * len(texts) and same >= 0.9 * len(texts), (found, same, len(texts))


def test_single_lines_are_found_and_others_left_alone(corpus, clean):
    rng, hits, whole = random.Random(3), 0, 0
    for r in clean[:120]:
        lines = r.text.split("\n")
        some = [i for i, x in enumerate(lines) if sum(c > "\x7f" for c in x) >= 2]
        if len(some) < 3:
            continue
        for i in some[:3]:
            lines[i] = spoil(lines[i], "utf-8", rng.choice(["cp1252", "mac-roman", "cp437", "cp850"]), 1)
        bad = "\n".join(lines)
        labels = [x for x in garble.label(bad, corpus[1]) if x[2]]
        hits += bool(labels)
        whole += garble.restored(bad, labels) == r.text
        assert all("\n" not in bad[a:b] for a, b, _ in labels)
    assert hits >= 20 and whole >= 0.8 * hits


def test_the_quick_look_misses_nothing(corpus):
    found, model = corpus
    texts = [r.text for r in found.collect()]
    quick = set(garble.suspects(garble.beyond_ascii(*garble._buffers(pa.array(texts))), model).tolist())
    assert all(i in quick for i, t in enumerate(texts) if any(x[2] for x in garble.label(t, model)))


def test_the_greatest_stretch_against_brute_force():
    rng = np.random.default_rng(4)
    owner = np.sort(rng.integers(0, 9, 200))
    gain = rng.normal(-0.3, 2, 200)
    best, of = garble._best_stretch(gain, owner)
    for o, b in zip(of, best):
        own = gain[owner == o]
        want = max([0, *(own[i:j].sum() for i in range(len(own)) for j in range(i + 1, len(own) + 1))])
        assert np.isclose(b, want)


def test_many_small_gains_are_not_passed_over(corpus):
    _, model = corpus
    texts = [spoil(t, "cp1252", w, 1) for t in ("à la fête, ça et là où l’été a été très gênant", "é è ê à ç ù ô î", "¿Qué? ¡Sí! año niño mañana") for w in ("cp437", "cp850", "mac-roman")]
    quick = set(garble.suspects(garble.beyond_ascii(*garble._buffers(pa.array(texts))), model).tolist())
    assert all(i in quick for i, t in enumerate(texts) if any(x[2] for x in garble.label(t, model)))


def test_long_runs_are_undone_alike():
    run = tuple(map(ord, "é".encode().decode("cp1252") * 40))
    assert garble._undone(run, 1) == garble._undo_run(run, 1) == garble._undone_known(run, 1) and len(garble._undone(run, 1)) == 40


def test_garbled_table(spark, corpus):
    _, model = corpus
    good = "La façade était fermée ; l’école aussi, à grands frais."
    data = [(1, spoil(good, "utf-8", "cp1252", 1)), (1, good), (2, None), (3, ""), (4, "plain"), (5, "The caf� was closed; �3 lost."), (6, "dr®inage w©s ¬estored"), (None, spoil(good, "utf-8", "mac-roman", 1)), (7, "x" * 100_000 + "é")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("states", F.lit("clash")).withColumn("n_runs", F.lit(1))
    got = {r.doc_id: r for r in garble.garbled(df, model=model).collect()}
    assert set(got) == {1, 5, None}
    assert got[1].text == got[None].text == good and not got[1].lost and got[5].lost
    assert rows(garble.garbled(df.where("false"))) == rows(garble.garbled(df.where("doc_id = 4"))) == []

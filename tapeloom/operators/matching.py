"""Names matched by their tokens: exact above a threshold, refusing to choose between near equals."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Small letters without accents."""
    split = pc.utf8_normalize(pa.array(text, pa.string(), from_pandas=True), "NFKD")
    return pd.Series(pc.utf8_lower(pc.replace_substring_regex(split, r"\p{Mn}", "")).to_pandas().to_numpy(), text.index)


def tokens(name: Column, stop: tuple[str, ...] = ()) -> Column:
    """The distinct words of a name, without ``stop`` words unless nothing else is left."""
    words = F.array_distinct(F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    kept = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def scored_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """All pairs of (id, words) whose words overlap by the Jaccard share ``least`` or more: (left_id, right_id, score).

    Exact by prefixes: words are ordered from rare to common, and two sets that overlap so much
    share one of the first ``n - ceil(least * n) + 1`` words of each. Frequent words thus meet
    nobody unless a name has nothing rarer; rows without words match nothing.
    """
    words = left.select(F.explode("words").alias("w")).unionByName(right.select(F.explode("words").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        placed = side.select("id", F.size("words").alias("n"), F.explode("words").alias("w")).join(words, "w")
        ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "w")))  # a name's own words
        return ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(F.col("id").alias(name), "w")

    pairs = prefixes(left, "left_id").join(prefixes(right, "right_id"), "w").select("left_id", "right_id").distinct()
    scored = pairs.join(left.select(F.col("id").alias("left_id"), F.col("words").alias("lw")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("words").alias("rw")), "right_id")
    both = F.size(F.array_intersect("lw", "rw"))
    score = both / (F.size("lw") + F.size("rw") - both)
    return scored.select("left_id", "right_id", score.alias("score")).where(F.col("score") >= least)


def best_match(left: DataFrame, right: DataFrame, least: float, margin: float) -> DataFrame:
    """(left_id, right_id, score, status): matched if the best score leads the next by ``margin``, else ambiguous or no_match; every left row is kept."""
    pairs = scored_pairs(left, right, least)
    top = pairs.groupBy("left_id").agg(F.max(F.struct("score", (-F.col("right_id")).alias("r"))).alias("b"))
    rest = pairs.join(top, "left_id").where(F.col("right_id") != -F.col("b.r")).groupBy("left_id").agg(F.max("score").alias("second"))
    out = left.select(F.col("id").alias("left_id")).join(top, "left_id", "left").join(rest, "left_id", "left")
    clear = F.col("b.score") - F.coalesce("second", F.lit(0.0)) >= margin
    status = F.when(F.col("b").isNull(), "no_match").when(clear, "matched").otherwise("ambiguous")
    return out.select("left_id", F.when(clear, -F.col("b.r")).alias("right_id"), F.col("b.score").alias("score"), status.alias("status"))


def by_preference(df: DataFrame, keys: list[str], column: str, preferred: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the first of ``preferred`` that it has, else the first by name; nulls last."""
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(column))
    order = F.struct(F.when(place > 0, place).otherwise(len(preferred) + 1).alias("p"), F.col(column).isNull().alias("n"), F.col(column).alias("c"), F.struct(*columns).alias("v"))
    return df.groupBy(*keys).agg(F.min(order).alias("x")).select(*keys, F.col("x.c").alias(column), *[F.col(f"x.v.{c}").alias(c) for c in columns])


def initials_of(short: Column, words: Column) -> Column:
    """Whether ``short`` is spelled by the first letters of ``words``, in order and all of them."""
    return F.lower(short) == F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


#: Words that say nothing about a team, and names of a draw.
NOISE = ("fc", "cf", "sc", "afc", "cd", "ac", "fk", "bk", "if", "club", "de", "do", "da", "the")
DRAWS = ("draw", "tie")
#: What each side, both together and the lead over the next must reach; the time gate; the longest abbreviation.
LEAST_SIDE, LEAST_TOTAL, MARGIN, WITHIN_US, SHORT = 0.3, 1.2, 0.25, 3 * 3_600_000_000, 4


def team_words(name: Column) -> Column:
    """A team's words in order: accents folded, ASCII letters and digits, without noise words unless nothing else is left; null stays null."""
    words = F.filter(F.split(F.regexp_replace(folded(name), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*NOISE))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def _runs(words: Column) -> Column:
    """The initials of every run of two to SHORT words."""
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    places = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    return F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(SHORT)), lambda n: F.substr(initials, i, F.least(n, F.size(words) - i + 1)))))


def team_score(a: Column, b: Column) -> Column:
    """How alike two teams' words are: 1 for the same, 0.85 where one holds the other, else up to 0.8 for shared words and abbreviations.

    A word of up to SHORT letters stands for a run of initials or for the start of a word of the other name. ``a`` and ``b``
    must be columns of a table, as :func:`team_words` gives them, for Python functions may not stand inside of lambdas.
    """
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(sa, sb))
    short = lambda own, other: F.size(F.filter(F.array_except(own, other), lambda t: (F.length(t) <= SHORT) & (F.array_contains(_runs(other), t) | F.exists(other, lambda w: F.startswith(w, t)))))
    credit = (shared + short(sa, b) + short(sb, a)) / F.least(F.size(sa), F.size(sb))
    score = F.when((shared == F.size(sa)) & (shared == F.size(sb)), 1.0).when((shared == F.size(sa)) | (shared == F.size(sb)), 0.85).otherwise(F.least(F.lit(0.8), 0.8 * credit))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), score).otherwise(0.0)


def _blocks(words: Column) -> Column:
    """Everything by which another name could refer to one of these words: the words, their starts, and runs of initials."""
    starts = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.lit(SHORT)), lambda n: F.substr(w, F.lit(1), n))))
    return F.array_distinct(F.filter(F.concat(words, starts, _runs(words)), lambda x: F.length(x) > 0))


def match_events(left: DataFrame, right: DataFrame, within_us: int = WITHIN_US) -> DataFrame:
    """Each event of ``left`` with the one of ``right`` of the same time and teams: (left_id, right_id, score, status).

    Both are (id, one, two, t), teams as :func:`team_words`, ids unique. Of the events within
    ``within_us``, the score is the better sum over both orientations in which each side reaches
    LEAST_SIDE; below LEAST_TOTAL there is no match, and one that leads the next by less than
    MARGIN is ambiguous. Nothing is crossed: events of the same teams and time are one, with their
    number; names are scored once a time bucket, if they share a word, its start or a run of
    initials; events meet by both names. Ties are ambiguous by the margin; rows without time match
    nothing but stay.
    """
    from tapeloom.session import written

    cell = F.floor(F.col("t") / within_us)
    event = ["one", "two", "t"]
    whole = " and ".join(f"{c} is not null" for c in event)
    lefts = left.where(whole).select(*event).distinct().withColumn("cell", F.explode(F.array(*[cell + k for k in (-1, 0, 1)])))
    rights = right.where(whole).groupBy(*event).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("right_id")).withColumn("cell", cell)

    def spread(side: DataFrame, name: str) -> DataFrame:
        names = side.select(F.explode(F.array("one", "two")).alias(name), "cell").distinct()
        return names.select(name, "cell", F.inline(F.transform(_blocks(F.col(name)), lambda x: F.struct(x.alias("block"), F.array_contains(name, x).alias("is_word")))))

    # A word meets words and what stands for them; two starts or runs of initials say nothing.
    a, b = spread(lefts, "a"), spread(rights, "b")
    by_left = a.where("is_word").drop("is_word").join(b.drop("is_word"), ["block", "cell"])
    by_right = a.where("not is_word").drop("is_word").join(b.where("is_word").drop("is_word"), ["block", "cell"])
    pairs = by_left.select("a", "b", "cell").unionByName(by_right.select("a", "b", "cell")).distinct()
    alike = written(pairs.withColumn("s", team_score(F.col("a"), F.col("b"))).where(F.col("s") >= LEAST_SIDE), "names")

    # An event of the left knows what its second name may be called, one of the right what either of its names may be called.
    asks = lefts.join(alike.select(F.col("a").alias("two"), F.col("b").alias("r_two"), "cell", F.col("s").alias("s_two")), ["two", "cell"])
    turned = [rights.select(F.col(x).alias("b"), F.col(y).alias("r_two"), "cell", F.col("t").alias("r_t"), "n", "right_id") for x, y in (("one", "two"), ("two", "one"))]
    has = turned[0].unionByName(turned[1]).join(alike.select(F.col("a").alias("one"), "b", "cell", F.col("s").alias("s_one")), ["b", "cell"]).drop("b")
    both = asks.join(has, ["one", "r_two", "cell"]).where(F.abs(F.col("t") - F.col("r_t")) <= within_us).withColumn("score", F.col("s_one") + F.col("s_two")).where(F.col("score") >= LEAST_TOTAL)

    scored = both.repartition(*event).groupBy(*event, "right_id").agg(F.max("score").alias("score"), F.max("n").alias("n"))
    level = scored.groupBy(*event, "score").agg(F.sum("n").alias("n"), F.min("right_id").alias("right_id"))
    top = level.groupBy(*event).agg(F.max(F.struct("score", "n", "right_id")).alias("b"), F.get(F.sort_array(F.collect_list("score"), False), F.lit(1)).alias("second"))
    out = left.select(F.col("id").alias("left_id"), *event).join(top, event, "left")
    clear = (F.col("b.n") == 1) & (F.col("second").isNull() | (F.col("b.score") - F.col("second") >= MARGIN))
    status = F.when(F.col("b").isNull(), "no_match").when(clear, "matched").otherwise("ambiguous")
    return out.select("left_id", F.when(status == "matched", F.col("b.right_id")).alias("right_id"), F.col("b.score").alias("score"), status.alias("status"))


def best_name(name: Column, words: Column, names: Column, name_words: Column) -> Column:
    """The place (from 1) of the one of ``names`` that ``name`` means, null if none or two equally; a draw means a draw only.

    ``words`` are the name's, ``name_words`` those of each of ``names``, as :func:`team_words`.
    """
    is_draw = lambda x: F.lower(F.trim(x)).isin(*DRAWS)
    places = F.transform(F.filter(F.transform(names, lambda n, i: F.struct((i + 1).alias("i"), n.alias("n"))), lambda x: is_draw(x["n"])), lambda x: x["i"])
    scores = F.transform(names, lambda n, i: F.when(is_draw(n), 0.0).otherwise(team_score(words, F.get(name_words, i))))
    top = F.array_max(scores)
    once = F.size(F.filter(scores, lambda s: F.abs(s - top) < 1e-9)) == 1
    return F.when(is_draw(name), F.get(places, F.lit(0))).when((top >= LEAST_SIDE) & once, F.array_position(scores, top)).cast("int")


def holders(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each (id, words) of ``left`` with the only row of ``right`` that has all of its words: (left_id, right_id, status).

    Several are ambiguous, none is unmatched; without words nothing matches. A left row meets
    right rows by the rarest of its words only.
    """
    said = right.select(F.col("id").alias("right_id"), F.col("words").alias("has"), F.explode("words").alias("w"))
    rare = said.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    asked = left.select(F.col("id").alias("left_id"), F.col("words").alias("asks"), F.explode("words").alias("w")).join(rare, "w", "left")
    first = asked.groupBy("left_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w", "asks")).alias("x")).select("left_id", F.col("x.w").alias("w"), F.col("x.asks").alias("asks"))
    found = first.join(said, "w").where(F.size(F.array_except("asks", "has")) == 0).groupBy("left_id").agg(F.count_distinct("right_id").alias("n"), F.min("right_id").alias("only"))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return left.select(F.col("id").alias("left_id")).join(found, "left_id", "left").select("left_id", F.when(F.col("n") == 1, F.col("only")).alias("right_id"), status.alias("status"))


def classes(pairs: DataFrame, ids: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected classes of a table of pairs (left_id, right_id) over ``ids`` (id): (id, class_id, n_links), the class by its smallest id.

    Labels are passed along the links and over the labels themselves until nothing changes; every
    round is written to the shared folder. More than ``rounds`` rounds are an error.
    """
    from tapeloom.session import written

    links = written(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).union(pairs.select("right_id", "left_id")).where("a != b").distinct(), "links")
    labels = written(ids.select("id", F.col("id").alias("label")).distinct(), "labels")
    for _ in range(rounds):
        near = links.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("id") == F.col("a"), "left").select("id", "label", F.least("label", "near").alias("new"))
        jump = lower.select(F.col("id").alias("to"), F.col("new").alias("further"))
        after = written(lower.join(jump, F.col("new") == F.col("to"), "left").select("id", "label", F.least("new", "further").alias("new")), "labels")
        labels = after.select("id", F.col("new").alias("label"))
        if after.where("label != new").isEmpty():
            degree = links.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_links"))
            return labels.join(degree, "id", "left").select("id", F.col("label").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    raise RuntimeError(f"classes still change after {rounds} rounds")

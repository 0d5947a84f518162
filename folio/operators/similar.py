"""Similarity of short texts by their longest common blocks, as columns; joins and matching by it.

The similarity of a and b is twice the number of characters in common blocks over
both lengths: the longest common block (the leftmost in a, then in b), then the
same on what lies left and right of it. In texts b of 200 characters and more,
those that make up over a hundredth of it begin no block, they only widen one.
"""

from __future__ import annotations

from itertools import combinations, pairwise, product
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.functions.text import bound

#: From this length on a text's frequent characters begin no block.
LONG = 200
_RANGE = "struct<alo:int,ahi:int,blo:int,bhi:int>"


def _part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def _frequent(b: Column) -> Column:
    """The characters of which a long text has more than its length over 100, plus one."""
    chars = F.split(b, "")
    many = F.filter(F.array_distinct(chars), lambda c: (F.length(b) - F.length(F.replace(b, c, F.lit("")))) > F.floor(F.length(b) / 100) + 1)
    return F.when(F.length(b) >= LONG, F.array_join(many, "")).otherwise(F.lit(""))


def _longest(a: Column, b: Column, r: Column) -> Column:
    """(i, j, n) of the longest block of two texts within a range, n 0 if there is none. Each start is only tried for more than the best before it."""
    given = F.struct(_part(a, r["alo"], r["ahi"]).alias("a"), _part(b, r["blo"], r["bhi"]).alias("b"), (r["ahi"] - r["alo"]).alias("m"))

    def found(x: Column) -> Column:
        has = lambda i, n: F.contains(x["b"], F.substring(x["a"], i + 1, n))

        def step(best: Column, i: Column) -> Column:
            n = best["n"] + 1
            more = F.when(n < x["m"] - i, F.size(F.filter(F.sequence(n + 1, x["m"] - i), lambda k: has(i, k)))).otherwise(0)
            return F.when((i + n <= x["m"]) & has(i, n), F.struct((n + more).alias("n"), i.alias("i"))).otherwise(best)

        best = F.aggregate(F.sequence(F.lit(0), x["m"] - 1), F.struct(F.lit(0).alias("n"), F.lit(0).alias("i")), step)
        at = lambda t: F.position(F.substring(x["a"], t["i"] + 1, t["n"]), x["b"]) - 1
        return bound(best, lambda t: F.struct((r["alo"] + t["i"]).alias("i"), (r["blo"] + F.when(t["n"] == 0, 0).otherwise(at(t))).alias("j"), t["n"].alias("n")))

    return bound(given, found)


def _widened(a: Column, b: Column, r: Column, m: Column) -> Column:
    """The block with the equal characters that stand right before and behind it in the whole texts."""
    run = lambda most, same: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda k: (k >= most) | ~same(k))), F.lit(0))
    at = lambda text, k: F.substring(text, k + 1, F.lit(1))

    def left(m: Column) -> Column:
        n = run(F.least(m["i"] - r["alo"], m["j"] - r["blo"]), lambda k: at(a, m["i"] - 1 - k) == at(b, m["j"] - 1 - k))
        return bound(n, lambda n: F.struct((m["i"] - n).alias("i"), (m["j"] - n).alias("j"), (m["n"] + n).alias("n")))

    def right(m: Column) -> Column:
        n = run(F.least(r["ahi"] - m["i"] - m["n"], r["bhi"] - m["j"] - m["n"]), lambda k: at(a, m["i"] + m["n"] + k) == at(b, m["j"] + m["n"] + k))
        return F.struct(m["i"].alias("i"), m["j"].alias("j"), (m["n"] + n).alias("n"))

    return bound(bound(m, left), right)


def matched(a: Column, b: Column) -> Column:
    """Characters in common blocks."""
    given = F.struct(a.alias("a"), b.alias("b"), F.length(a).alias("n"), F.length(b).alias("m"), _frequent(b).alias("frequent"))

    def count(x: Column) -> Column:
        mask = lambda text, sign: F.when(x["frequent"] == "", text).otherwise(F.call_function("translate", text, x["frequent"], F.repeat(F.lit(sign), F.length(x["frequent"]))))
        masked = F.struct(x["a"].alias("a"), x["b"].alias("b"), mask(x["a"], "\ue000").alias("ma"), mask(x["b"], "\ue001").alias("mb"), x["n"].alias("n"), x["m"].alias("m"), x["frequent"].alias("frequent"))
        return bound(masked, blocks)

    def blocks(x: Column) -> Column:
        whole = F.struct(F.lit(0).alias("alo"), x["n"].alias("ahi"), F.lit(0).alias("blo"), x["m"].alias("bhi"))
        begin = F.struct(F.array(whole).cast(f"array<{_RANGE}>").alias("open"), F.lit(0).alias("total"))

        def step(s: Column, _: Column) -> Column:
            return F.when(F.size(s["open"]) == 0, s).otherwise(bound(F.element_at(s["open"], -1), lambda r: taken(s, r)))

        def taken(s: Column, r: Column) -> Column:
            rest = F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)
            block = bound(_longest(x["ma"], x["mb"], r), lambda m: F.when(x["frequent"] == "", m).otherwise(_widened(x["a"], x["b"], r, m)))
            return bound(block, lambda m: F.struct(F.concat(rest, F.when(m["n"] > 0, sides(r, m)).otherwise(F.array().cast(f"array<{_RANGE}>"))).alias("open"), (s["total"] + m["n"]).alias("total")))

        def sides(r: Column, m: Column) -> Column:
            part = lambda alo, ahi, blo, bhi: F.struct(alo.alias("alo"), ahi.alias("ahi"), blo.alias("blo"), bhi.alias("bhi"))
            both = F.array(part(r["alo"], m["i"], r["blo"], m["j"]), part(m["i"] + m["n"], r["ahi"], m["j"] + m["n"], r["bhi"]))
            return F.filter(both, lambda y: (y["alo"] < y["ahi"]) & (y["blo"] < y["bhi"]))

        # each step takes a range, and a range gives two more only with a block of at least one character
        steps = F.sequence(F.lit(1), 2 * F.least(x["n"], x["m"]) + 1)
        return F.aggregate(steps, begin, step, lambda s: s["total"])

    return bound(given, lambda x: F.when((x["n"] == 0) | (x["m"] == 0), 0).otherwise(count(x)))


def ratio(a: Column, b: Column) -> Column:
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).when(a == b, 1.0).otherwise(2.0 * matched(a, b) / both)


def _letters(text: Column) -> Column:
    """A text's characters, each with the number of equal ones up to it: as a set they are its multiset."""
    numbered = lambda chars: F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c)).cast("string")))
    return bound(F.sort_array(F.split(text, "")), numbered)


def alike(a: Column, b: Column, least: float = L.SIMILAR) -> Column:
    """Whether the similarity is at least ``least``; what lengths, edits or letters rule out is not looked at further.

    What stands outside of the common blocks can be deleted and inserted, so no more edits than it has characters part two similar texts.
    """
    both = F.length(a) + F.length(b)
    possible = 2.0 * F.least(F.length(a), F.length(b)) >= least * both
    edits = F.call_function("levenshtein", a, b, F.floor((1 - least) * both + 1e-9).cast("int")) >= 0  # -1: more edits than these
    letters = 2.0 * F.size(F.array_intersect(_letters(a), _letters(b))) >= least * both
    return (a == b) | (possible & edits & letters & (ratio(a, b) >= least))


def _cuts(least: float, most: int = 500) -> tuple[int, list[tuple]]:
    """(short, cuts): (n, m, kept): the ways to leave of n characters as many as a text of m characters has in common with them at least.

    kept are the runs that stay, as (start, length). short: up to this length the cuts of each n are ``most`` at most.
    """

    def need(n: int, m: int) -> int | None:
        return next((k for k in range(min(n, m) + 1) if 2.0 * k / (n + m) >= least), None)

    short = 0
    while sum(comb(short + 1, k) for m in range(1, short + 2) if (k := need(short + 1, m)) is not None) <= most:
        short += 1
    cuts = []
    for n, m in product(range(1, short + 1), repeat=2):
        if (k := need(n, m)) is not None:
            for left_out in combinations(range(n), n - k):
                ends = [-1, *left_out, n]
                cuts.append((n, m, [(x + 1, y - x - 1) for x, y in pairwise(ends) if y > x + 1]))
    return short, cuts


def _common(a: DataFrame, b: DataFrame, least: float) -> tuple[int, DataFrame]:
    """(short, pairs): of the texts a and b of at most ``short`` characters, the pairs with so many characters in common, in order, as the similarity needs; repeated.

    Characters in common blocks are a common subsequence. Each text gives what is left when it loses as many characters
    as a partner of a given length allows; partners have such a rest in common, so pairs are found by equality.
    """
    short, cuts = _cuts(least)
    runs = max((len(c[2]) for c in cuts), default=0)
    flat = [(n, m, *[x for run in [*kept, *[(0, 0)] * (runs - len(kept))] for x in run]) for n, m, kept in cuts]
    fields = ", ".join(["n int, m int", *[f"s{k} int, l{k} int" for k in range(runs)]])
    table = F.broadcast(a.sparkSession.createDataFrame(flat, fields))  # some thousand rows, the same for all inputs

    def rests(df: DataFrame, c: str, lengths: tuple[str, str]) -> DataFrame:
        rows = df.select(c, F.length(c).alias("n")).where(F.col("n") <= short).join(table, "n")
        rest = F.concat(*[F.substring(F.col(c), F.col(f"s{k}") + 1, F.col(f"l{k}")) for k in range(runs)])
        return rows.select(c, F.xxhash64(*lengths, rest).alias("rest"))  # equal hashes only propose a pair

    return short, rests(a, "a", ("n", "m")).join(rests(b, "b", ("m", "n")), "rest").select("a", "b")


def similar_pairs(left: DataFrame, right: DataFrame, least: float = L.SIMILAR) -> DataFrame:
    """left (a) and right (b), distinct texts of at least one character: the pairs (a, b, score) with score at least ``least``.

    Short texts (12 characters for 0.84) meet by what is left of them without some characters. With a longer one, two
    texts are as similar at most as their multisets of letters, so these are joined as sets by the usual prefix
    filter: of a text with n letters all but ``least / (2 - least)`` * n, the rarest first, hold one of any partner's.
    Each pair is compared once, whatever it shares.
    """
    share = least / (2 - least)
    told = lambda df, c: df.select(F.col(c)).where(F.length(c) > 0).distinct()
    a, b = told(left, "a"), told(right, "b")
    short, tried = _common(a, b, least)
    lettered = lambda df, c: df.where(F.length(c) >= share * (short + 1) - 1e-9).withColumn("letters", _letters(F.col(c)))
    a, b = lettered(a, "a"), lettered(b, "b")
    letters = a.select(F.explode("letters").alias("letter")).unionAll(b.select(F.explode("letters").alias("letter")))
    often = letters.groupBy("letter").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, c: str) -> DataFrame:
        rows = df.select(c, F.length(c).alias(f"n{c}"), F.explode("letters").alias("letter")).join(often, "letter")
        place = F.row_number().over(W.partitionBy(c).orderBy("n", "letter"))  # within one text
        return rows.withColumn("place", place).where(F.col("place") <= F.col(f"n{c}") - F.ceil(F.lit(share) * F.col(f"n{c}") - 1e-9) + 1).select(c, f"n{c}", "letter")

    close = (F.least("na", "nb") >= share * F.greatest("na", "nb") - 1e-9) & (F.greatest("na", "nb") > short)
    longer = prefixes(a, "a").join(prefixes(b, "b"), "letter").where(close).select("a", "b")
    # a fixed number of partitions, as few bytes are much work; generated, the score is no condition that moves into the joins
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = tried.unionByName(longer).repartition(tasks, "a", "b").distinct()
    shares = 2.0 * F.size(F.array_intersect(_letters(F.col("a")), _letters(F.col("b")))) >= least * (F.length("a") + F.length("b"))
    score = F.when((F.greatest(F.length("a"), F.length("b")) <= short) | shares, ratio(F.col("a"), F.col("b")))
    return pairs.select("a", "b", F.explode(F.array(score)).alias("score")).where(F.col("score") >= least)


def one_to_one(edges: DataFrame, group: str, kept, rounds: int = 4) -> DataFrame:
    """edges (group, pred, gold, score). Each pred in order takes its best gold that none before it has: rounds of mutual best pairs.

    A pair is taken when the gold is the pred's best left and the pred the gold's first left; the first pred of a group
    always has such a pair, and pairs that are taken at once don't touch each other. What is taken stays as the only
    edge of both, so some rounds go in one plan; ``kept`` cuts the lineage behind them.
    """
    by_pred, by_gold = W.partitionBy(group, "pred"), W.partitionBy(group, "gold")
    left, out = kept(edges.select(group, "pred", "gold", "score")), None
    while not left.isEmpty():
        for _ in range(rounds):
            top = F.row_number().over(by_pred.orderBy(F.desc("score"), "gold")) == 1
            pair = F.col("top") & (F.col("pred") == F.min("pred").over(by_gold))
            left = left.withColumn("top", top).withColumn("pair", pair).withColumn("gone", F.max("pair").over(by_gold))
            left = left.withColumn("gone", F.col("gone") | F.max("pair").over(by_pred)).where(F.col("pair") | ~F.col("gone"))
        left = kept(left.select(group, "pred", "gold", "score", "pair"))
        pairs = left.where("pair").select(group, "pred", "gold")
        out, left = pairs if out is None else out.unionByName(pairs), left.where("not pair").drop("pair")
    return left.select(group, "pred", "gold") if out is None else out

"""N-gram Jaccard join: a size-aware heavy-light join that returns the components of all links.

Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of
distinct word n-grams; with ``D`` the symmetric difference that is
``(den + num) * |D| <= (den - num) * (|A| + |B|)``.

Equal sets are one node from the start. Then, by set size:

* Light sets: for each size a partner can have, all subsets of the one size that
  a link needs in common are enumerated as keys. Sets of the two sizes under one
  key are linked; no pair is formed, each is tied to the smallest of the others.
* Heavy sets: the inverted lists of the set's prefix are scanned. A prefix of
  twice the usual length is taken by hash order, of which linked sets share as
  many n-grams as the usual one has. So a set with fewer repeated n-grams there
  has no link and goes. Of the others the whole sets are listed, and those go of
  which fewer n-grams repeat than a link needs. What is left has prefixes by
  frequency: their inverted lists are scanned.
  A list is not paired with itself: it has one leader, the set most connected
  over all lists, and every member keeps only its difference to the leader. Two
  members' difference follows from theirs, and two members that share nothing of
  theirs link only if both link with the leader. So the members of a list are
  joined again on the prefixes of their differences, with length and position
  filters, and each candidate is verified exactly. A group of near copies costs
  its differences, not its pairs.
* The boundary between the two is the size with the least total cost: keys to
  enumerate below, prefixes to list and sets to fetch above.

Defined results: null and empty texts have no n-gram, n_shingles 0 and no link;
texts with fewer than n words have one, the whole sequence. Rows with equal ids
are one document of a component; a row with a null id has component null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import LOWER, Spans, components, keyed, mixed, runs, signed, written

#: Largest set size for which subsets may be enumerated.
_LIGHTEST = 64


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct n-gram hashes of each text."""
    for i, j, w in runs(column, LOWER):
        spans = Spans(w.hash)
        grams = spans.every(n)
        for k in range(j - i):
            lo, hi = int(w.at[k]), int(w.at[k + 1])
            if hi - lo >= n:
                yield i + k, np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                # of fewer words the length goes into the hash, so that it equals no n-gram's
                yield i + k, spans.of(np.array([lo]), np.array([hi])) ^ mixed(np.array([hi - lo], np.uint64))
            else:
                yield i + k, np.zeros(0, np.uint64)


class Rule:
    """Integer arithmetic of the threshold."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, a: int) -> list[int]:
        return [b for b in range(-(-self.num * a // self.den), self.den * a // self.num + 1) if b and self.overlap(a, b) <= min(a, b)]

    def prefix(self, a: int) -> int:
        return a - -(-self.num * a // self.den) + 1 if a else 0

    def subsets(self, a: int) -> int:
        return sum(comb(a, self.overlap(a, b)) for b in self.partners(a))

    def boundary(self, sizes: dict[int, int]) -> int:
        """Sets below it are light. sizes: number of sets by size, up to _LIGHTEST."""

        def cost(x: int) -> int:
            light = sum(c * self.subsets(a) for a, c in sizes.items() if a < x)
            heavy = sum(c * (a + 4 * self.prefix(a)) for a, c in sizes.items() if a >= self.num * x // self.den)
            return light + heavy

        return min(range(1, _LIGHTEST + 2), key=cost)


def _rank(grams: np.ndarray) -> np.ndarray:
    """Place in the global order."""
    return mixed(grams)


def _signatures(n: int, rule: Rule):
    """Size, 128-bit hash and prefix of each text's set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, prefix = [], [], [], []
            for _, s in _sets(batch.column("_text"), n):
                size.append(len(s))
                one.append(int(mixed(s).sum(dtype=np.uint64)))
                two.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                p = 2 * rule.prefix(len(s)) - 1
                prefix.append(s[np.argpartition(_rank(s), p - 1)[:p]] if 0 < p < len(s) else s)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(signed(np.concatenate(prefix))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(size, pa.int64()), pa.array(signed(np.array(one, np.uint64))), pa.array(signed(np.array(two, np.uint64))), lists],
                ["_id", "_key", "size", "s1", "s2", "prefix"],
            )

    return of


def _subsets(n: int, rule: Rule):
    """Keys of light sets: hash of each subset of a size that a link with a partner of another size needs, with both sizes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, k1, k2, other = [], [], [], []
            for i, s in _sets(batch.column("_text"), n):
                a, one, two = len(s), mixed(s), mixed(s ^ np.uint64(0xD1342543DE82EF95))
                for b in rule.partners(a):
                    left_out = list(combinations(range(a), a - rule.overlap(a, b)))
                    index = np.array(left_out, np.int64).reshape(len(left_out), -1)
                    salt = np.uint64(min(a, b) << 32 | max(a, b))
                    k1.append(mixed((one.sum(dtype=np.uint64) - one[index].sum(axis=1, dtype=np.uint64)) + salt))
                    k2.append(two.sum(dtype=np.uint64) - two[index].sum(axis=1, dtype=np.uint64) + salt)
                    rows += [i] * len(left_out)
                    other += [(b > a) - (b < a)] * len(left_out)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(k1))), pa.array(signed(np.concatenate(k2))), pa.array(other, pa.int32()), batch.column("node").take(pa.array(rows))],
                    ["k1", "k2", "other", "node"],
                )

    return of


def _whole(n: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in _sets(batch.column("_text"), n)]
            size = list(map(len, sets))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(signed(np.concatenate(sets))))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size, pa.int64()), lists], ["node", "size", "grams"])

    return of


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a column of lists, still sorted as unsigned numbers."""
    values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(at[:-1], at[1:]))


def _differences(rule: Rule):
    """Each member against its leader: sizes of what it has more and of all differences, linked or not, and the prefix of them that a join needs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = rule.den + rule.num, rule.den - rule.num
        for batch in batches:
            out = {k: [] for k in ("size", "more", "d", "linked", "grams")}
            for lead, own in zip(_arrays(batch.column("lead_grams")), _arrays(batch.column("grams"))):
                at = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
                common = lead[at] == own
                more = own[~common]
                less = np.delete(lead, at[common])
                d = len(more) + len(less)
                most = down * (len(own) + len(own) * rule.den // rule.num + 1) // up
                out["size"].append(len(own))
                out["more"].append(len(more))
                out["d"].append(d)
                out["linked"].append(up * d <= down * (len(own) + len(lead)))
                ordered = np.concatenate([more[np.argsort(_rank(more))], less[np.argsort(_rank(less))]])
                out["grams"].append(signed(ordered[: most + 1]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out["grams"])]), pa.int32()), pa.array(np.concatenate(out["grams"])))
            yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("node"), *(pa.array(out[k], pa.int64()) for k in ("size", "more", "d")), pa.array(out["linked"]), lists], ["lead", "node", "size", "more", "d", "linked", "grams"])

    return of


def _linked(rule: Rule):
    """Of candidates those that link, by their whole sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_arrays(batch.column("a_grams")), _arrays(batch.column("b_grams"))):
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(rule.den * common >= rule.num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return of


def ngram_jaccard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    spark, rule = df.sparkSession, Rule(num, den)
    docs = keyed(df, id_col, text_col)
    kind = docs.schema["_id"].dataType.simpleString()
    sets = written(docs.mapInArrow(_signatures(n, rule), f"_id {kind}, _key long, size long, s1 long, s2 long, prefix array<long>"), "sets")
    nodes = sets.where("size > 0 and _id is not null").groupBy("s1", "s2", "size").agg(F.min(F.struct("_id", "_key")).alias("r"))
    nodes = written(nodes.select(F.col("r._id").alias("node"), F.col("r._key").alias("_key"), "size", "s1", "s2"), "nodes")
    sizes = {int(r["size"]): int(r["count"]) for r in nodes.where(F.col("size") <= _LIGHTEST).groupBy("size").count().collect()}
    edge = rule.boundary(sizes)
    links = _light(docs, nodes.where(F.col("size") < edge), n, rule, kind).unionAll(_heavy(docs, sets, nodes.where(F.col("size") >= num * edge // den), n, rule, kind))
    found = components(links, "a", "b")
    named = nodes.join(found, "node", "left").select("s1", "s2", "size", F.coalesce("component", "node").alias("c"))
    out = sets.join(named, ["s1", "s2", "size"], "left").select("_id", F.col("size").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("c", "_id")).alias("component_id"))
    return out.withColumnRenamed("_id", id_col)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The text of each node, once."""
    named = nodes.select(F.col("node").alias("_id"), "_key")
    return docs.join(named, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select(F.col("_id").alias("node"), "_text")


def _light(docs: DataFrame, nodes: DataFrame, n: int, rule: Rule, kind: str) -> DataFrame:
    keys = written(_texts(docs, nodes).mapInArrow(_subsets(n, rule), f"k1 long, k2 long, other int, node {kind}"), "subsets")
    # other: whether the partner's set is larger (1), smaller (-1) or of the same size
    first = [F.min(F.when(F.col("other") == x, F.col("node"))).alias(name) for x, name in ((1, "small"), (-1, "large"), (0, "same"))]
    lists = keys.groupBy("k1", "k2").agg(*first, F.count("*").alias("m")).where("m > 1 and (same is not null or (small is not null and large is not null))").drop("m")
    partner = F.when(F.col("other") == 0, F.col("same")).when(F.col("other") == 1, F.col("large")).otherwise(F.col("small"))
    return keys.join(lists, ["k1", "k2"]).select(F.col("node").alias("a"), partner.alias("b")).where("a <> b").distinct()


def _lists(sets: DataFrame, common: Column) -> DataFrame:
    """sets: (node, size, grams). The inverted lists (gram, node, size, m, c) of sets with ``common`` repeated n-grams or more.

    m is the list's length, c the set's number of n-grams in lists of two or more; sets that go make others' n-grams unrepeated, so twice.
    """
    lists = sets.select("node", "size", F.explode("grams").alias("gram"))
    for _ in range(2):
        repeated = written(lists.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "repeated")
        lists = written(lists.select("node", "size", "gram").join(repeated, "gram"), "lists")
        enough = lists.groupBy("node", "size").agg(F.count("*").alias("c")).where(F.col("c") >= common).select("node", "c")
        lists = lists.join(enough, "node")
    return lists


def _heavy(docs: DataFrame, sets: DataFrame, nodes: DataFrame, n: int, rule: Rule, kind: str) -> DataFrame:
    num, den = rule.num, rule.den
    up, down = den + num, den - num
    own = sets.join(nodes.select(F.col("node").alias("_id"), "_key"), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    least = f"(({num} * size + {den - 1}) div {den})"
    # prefixes of linked sets share as many n-grams as the usual prefix of the smallest partner is long
    common = F.expr(f"{least} - ({num} * {least} + {den - 1}) div {den} + 1")
    near = _lists(own.select(F.col("_id").alias("node"), "size", F.col("prefix").alias("grams")), common).select("node").distinct()
    grams = written(_texts(docs, nodes.join(near, "node", "left_semi")).mapInArrow(_whole(n), f"node {kind}, size long, grams array<long>"), "grams")
    # the same with whole sets, of which linked ones share this many; then the prefix by frequency
    lists = _lists(grams, F.expr(least))
    place = F.row_number().over(W.partitionBy("node").orderBy("m", "gram"))  # within one set
    lists = written(lists.withColumn("place", place).where(F.col("place") <= F.col("c") - F.expr(least) + 1).select("gram", "node", "size", "m", "c"), "lists")
    score = lists.groupBy("node").agg(F.sum("m").alias("score"))
    lists = lists.join(score, "node")
    leaders = lists.groupBy("gram").agg(F.max(F.struct("score", "node", "size")).alias("lead"), F.count("*").alias("k")).where("k > 1").select("gram", "k", F.col("lead.node").alias("lead"), F.col("lead.size").alias("lead_size"))
    # a list of two has no other pair: there the sizes decide at once
    fit = (F.col("k") > 2) | ((F.col("size") * den >= F.col("lead_size") * num) & (F.col("lead_size") * den >= F.col("size") * num))
    pairs = written(lists.join(leaders, "gram").where(F.col("node") != F.col("lead")).where(fit).select("lead", "node").distinct(), "pairs")
    side = lambda c: grams.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams"))
    both = pairs.join(grams.drop("size"), "node").join(side("lead"), "lead")
    diff = written(both.mapInArrow(_differences(rule), f"lead {kind}, node {kind}, size long, more long, d long, linked boolean, grams array<long>"), "differences")
    direct = diff.where("linked").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    # members that may link though they don't both link with their leader
    open_ = diff.groupBy("lead").agg(F.count("*").alias("k"), F.min("linked").alias("all")).where("k > 1 and not all").select("lead")
    posts = diff.join(open_, "lead", "left_semi").select("lead", "node", "size", "more", "linked", "d", F.posexplode("grams").alias("pos", "gram"))
    x = posts.where("not linked").alias("x")
    y = posts.alias("y")
    gap = F.expr(f"({down} * (x.size + y.size)) div {up}")  # largest difference of a link
    more, less = F.col("x.more") + F.col("y.more"), F.abs((F.col("x.d") - F.col("x.more")) - (F.col("y.d") - F.col("y.more")))
    rest = F.least(F.col("x.d") - F.col("x.pos"), F.col("y.d") - F.col("y.pos"))
    first = (
        (F.col("x.lead") == F.col("y.lead"))
        & (F.col("x.gram") == F.col("y.gram"))
        & (F.col("y.linked") | (F.col("x.node") < F.col("y.node")))
        & (F.col("x.node") != F.col("y.node"))
        & (F.col("x.size") * den >= F.col("y.size") * num)
        & (F.col("y.size") * den >= F.col("x.size") * num)
        & (2 * rest >= F.col("x.d") + F.col("y.d") - gap)
        # if the first n-gram in common is one that both lack, they have nothing more in common
        & ((F.col("x.pos") < F.col("x.more")) | (more + less <= gap))
    )
    tried = written(x.join(y, first).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "candidates")
    linked = tried.join(side("a"), "a").join(side("b"), "b").mapInArrow(_linked(rule), f"a {kind}, b {kind}")
    return direct.unionAll(linked)

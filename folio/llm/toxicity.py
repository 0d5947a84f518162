"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled texts, have discounted counts of
their own of words and of pairs of neighbours (modified Kneser-Ney: a discount
each for what is seen once, twice and more often, from the counts of counts). What
is taken from pairs goes to the class's words, and what is taken from words to
words by the number of distinct words that precede them anywhere in the labelled
texts, which the classes share. So a rare expression, or an unknown one, is about
as likely in either model and says little. A pair seen once in all labelled texts
is not kept; its whole count is taken.

A document is compared by log-likelihood ratios, all normalised by length: of all
its words, of those that speak for the toxic model beyond an unknown word, and of
its most toxic fiftieth; each by words alone and by pairs. A logistic function of
the six, fitted on labelled texts that the counts have not seen, turns them into a
score of 0 to 1.

The models count all labelled texts and are tables like the counts. Their most
frequent words and pairs, at most ``head`` rows of either (16 and 12 bytes a row),
go to every task. All others are found by a join: a task leaves open the words and
pairs that a bitmap of 16 MB, of all keys of the rest, does not exclude, and their
ratios are joined by key and given back to their document. What is in the head
decides about the way of a ratio and never about its value. A key that more than
one in 4096 of the look-ups ask for, of which there are at most 4096, is broadcast
with its ratio and not joined. The logistic function is fitted on at most
``max_words`` words, of texts chosen by a hash when there are more. Every document
is scored, over its whole text.

Defined results: null and empty texts have ratios 0 and so the score of no
evidence; labels without a document, and null labels, are not used; of several
labels of a document the largest counts; without both classes all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ALNUM, forget, mixed, runs, signed, small_batches, written


def _before(hashes: np.ndarray) -> np.ndarray:
    """A word's hash as the first of a pair; 0 stands for no pair."""
    return np.maximum(hashes, np.uint64(1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: counts by class of words (before 0) and of pairs of neighbours."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        for i, j, w in runs(batch.column("_text"), ALNUM, 1 << 23):
            text = np.repeat(np.arange(j - i), np.diff(w.at))
            yield _rows(w.hash, np.zeros(len(w.hash), np.uint64), label[i:j][text], w.hash)
            near = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
            before, after = _before(w.hash[:-1][near]), w.hash[1:][near]
            yield _rows(after, before, label[i:j][text[1:][near]], mixed(before) + after)


def _rows(word, before, label, key) -> pa.RecordBatch:
    """Counts by class of what has the same key."""
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    toxic = np.bincount(at, label, len(first)).astype(np.int64)
    every = np.bincount(at, minlength=len(first))
    return pa.RecordBatch.from_arrays([pa.array(signed(word[first])), pa.array(signed(before[first])), pa.array(toxic), pa.array(every - toxic)], ["word", "before", "toxic", "ordinary"])


def _discounts(n: list[int]) -> np.ndarray:
    """Of what was seen 0, 1, 2 and more often, from the counts of counts 1 to 4."""
    y = n[0] / max(1, n[0] + 2 * n[1])
    return np.array([0.0] + [min(float(k), max(0.1, k - (k + 1) * y * n[k] / max(1, n[k - 1]))) for k in (1, 2, 3)])


class Seen(NamedTuple):
    """Of a class: all its words, and the discounts."""

    total: int
    discount: np.ndarray


def _seen(rows: DataFrame, of: tuple[str, ...] = ("toxic", "ordinary")) -> list[Seen]:
    """Of each class's counts, over all rows."""
    n = rows.agg(*[F.sum(c).alias(c) for c in of], *[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in of for k in range(1, 5)]).first()
    return [Seen(n[c] or 0, _discounts([n[f"{c}{k}"] for k in range(1, 5)])) for c in of]


def _find(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether they hold what is looked for."""
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


class Model:
    """Log-likelihood ratios of the most frequent words and pairs, and of any word that no model knows.

    rest: (key, ratio, back) of all other words and pairs; bits: of their keys' first 27 bits, None where there are none.
    """

    def __init__(self, words: pa.Table, pairs: pa.Table, unknown: float, rest: DataFrame, bits: np.ndarray | None):
        column = lambda t, c: t.column(c).to_numpy()
        self.word, self.pair = (column(t, "key").view(np.uint64) for t in (words, pairs))
        by, by_pair = np.argsort(self.word), np.argsort(self.pair)
        self.word, self.ratio, self.back = self.word[by], column(words, "ratio")[by], column(words, "back")[by]
        self.pair, self.pair_ratio = self.pair[by_pair], column(pairs, "ratio")[by_pair]
        self.unknown, self.rest, self.bits = unknown, rest, bits

    def __getstate__(self):
        return {**self.__dict__, "rest": None}

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at, known = _find(self.word, hashes)
        return np.append(self.ratio, np.float32(self.unknown))[np.where(known, at, -1)]

    def of_pairs(self, hashes: np.ndarray, first: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """Of each word after the one before it; ratio: of the words alone, kept where a text begins."""
        return self._pairs(hashes, first, ratio)[0]

    def _pairs(self, hashes: np.ndarray, first: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """With the keys of the pairs (0 where a text begins), and whether they are known."""
        at, known = _find(self.word, hashes[:-1])
        out, key, found = ratio.copy(), np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
        out[1:] += np.append(self.back, np.float32(0))[np.where(known, at, -1)]
        key[1:] = mixed(_before(hashes[:-1])) + hashes[1:]
        at, found[1:] = _find(self.pair, key[1:])
        out[1:][found[1:]] = self.pair_ratio[at[found[1:]]]
        out[first], key[first], found[first] = ratio[first], 0, False
        return out, key, found

    def open(self, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which keys the rest may hold, of those that are not known."""
        if self.bits is None:
            return np.zeros(len(keys), bool)
        at = (keys >> np.uint64(64 - _BITS)).astype(np.int64)
        return ~known & ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)


#: The bitmap has 2**27 bits, in 4096 parts of 4 KB.
_BITS = 27


def _bits(rest: DataFrame) -> np.ndarray | None:
    place = F.expr(f"shiftrightunsigned(key, {64 - _BITS}) + 1")
    parts = rest.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b")).toArrow()
    out = np.zeros((1 << (_BITS - 15), 4096), np.uint8)
    for k, b in zip(parts.column("k").to_pylist(), parts.column("b").to_pylist()):
        out[k - 1] = np.frombuffer(b, np.uint8)
    return out.reshape(-1) if parts.num_rows else None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, before = (batch.column(c).to_numpy().view(np.uint64) for c in ("word", "before"))
        yield pa.RecordBatch.from_arrays([pa.array(signed(mixed(before) + word)), batch.column("total"), batch.column("ratio")], ["key", "total", "ratio"])


_CLASSES = ("toxic", "ordinary")


def _off(c: str, seen: Seen):
    return F.element_at(F.array(*map(F.lit, seen.discount.tolist())), F.least(F.col(c), F.lit(3)).cast("int") + 1)


def model_of(counts: DataFrame, least: int, head: int) -> Model | None:
    """The models' ratios, of words and pairs with a sum of counts of ``least`` or more; any other's count goes to the backoff. None without both classes."""
    single, total = F.col("before") == 0, F.col("toxic") + F.col("ordinary")
    words = written(counts.groupBy("word").agg(*[F.sum(F.when(single, F.col(c)).otherwise(0)).alias(c) for c in _CLASSES], F.count_if(~single).alias("preceded")), "words")
    pairs = counts.where(~single)
    seen, seen_pairs = _seen(words), _seen(pairs)
    if not all(s.total for s in seen):
        return None
    kept = words.where(total >= least)
    sums = kept.agg(*[F.sum(F.col(c) - _off(c, s)).alias(c) for c, s in zip(_CLASSES, seen)]).first()
    preceded = max(1, words.agg(F.sum("preceded")).first()[0] or 0)
    taken = [s.total - (sums[c] or 0.0) for c, s in zip(_CLASSES, seen)]  # the discounts of the words kept, and the others' whole counts
    unknown = float(np.log(taken[0] / seen[0].total) - np.log(taken[1] / seen[1].total))
    share = [((F.col(c) - _off(c, s) + F.lit(t) * F.greatest("preceded", F.lit(0.5)) / preceded) / s.total).alias(f"p_{c}") for c, s, t in zip(_CLASSES, seen, taken)]
    kept = kept.select("word", total.alias("total"), *share)
    some = total >= least
    # words that begin no kept pair give all they have: they need no row
    firsts = pairs.groupBy("before").agg(F.bool_or(some).alias("some"), *[F.sum(c).alias(f"n_{c}") for c in _CLASSES], *[F.sum(F.when(some, _off(c, s)).otherwise(F.col(c))).alias(f"off_{c}") for c, s in zip(_CLASSES, seen_pairs)])
    back = [F.when(F.col(f"n_{c}") > 0, F.greatest(f"off_{c}", F.lit(1e-3)) / F.col(f"n_{c}")).otherwise(1.0).alias(f"back_{c}") for c in _CLASSES]
    firsts = written(firsts.where("some").select("before", *[f"n_{c}" for c in _CLASSES], *back), "firsts")
    log = lambda c: F.ln(c.format("toxic")) - F.ln(c.format("ordinary"))
    of_words = kept.join(firsts, F.when(F.col("word") == 0, 1).otherwise(F.col("word")) == F.col("before"), "left")
    of_words = of_words.select(F.col("word").alias("key"), "total", log("p_{}").cast("float").alias("ratio"), F.coalesce(log("back_{}"), F.lit(0)).cast("float").alias("back"), F.lit(False).alias("pair"))
    after = [F.ln((F.col(c) - _off(c, s)) / F.greatest(f"n_{c}", F.lit(1)) + F.col(f"back_{c}") * F.col(f"p_{c}")) for c, s in zip(_CLASSES, seen_pairs)]
    of_pairs = pairs.where(some).join(kept.drop("total"), "word").join(firsts, "before").select("word", "before", total.alias("total"), (after[0] - after[1]).cast("float").alias("ratio"))
    of_pairs = of_pairs.mapInArrow(_keys, "key long, total long, ratio float").select("key", "total", "ratio", F.lit(0).cast("float").alias("back"), F.lit(True).alias("pair"))
    table = written(of_words.unionAll(of_pairs), "ratios")
    forget(words, firsts)
    level = F.floor(8 * F.log2("total"))  # at most 512 levels
    first = {True: 512, False: 512}
    left = {True: head, False: head}
    for r in table.groupBy("pair", level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        left[r.pair] -= r.n
        if left[r.pair] >= 0:
            first[r.pair] = r.level
    in_head = level >= F.when(F.col("pair"), first[True]).otherwise(first[False])
    frequent = table.where(in_head)
    rest = table.where(~in_head).select("key", "ratio", "back")
    return Model(frequent.where("not pair").select("key", "ratio", "back").toArrow(), frequent.where("pair").select("key", "ratio").toArrow(), unknown, rest, _bits(rest))


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values).astype(kind)))


_SURE = "n long, s0 double, e0 double, t0 array<float>, s1 double, e1 double, t1 array<float>"
_OPEN = "w array<long>, pair array<long>, word array<long>, before array<long>, base array<float>, need array<long>"


def _sums(ratio: np.ndarray, unknown: float, most: int) -> tuple[float, float, np.ndarray]:
    """Of some ratios of a text: their sum, what they exceed an unknown word by, and the ``most`` largest."""
    ratio = ratio.astype(np.float64)
    return ratio.sum(), np.maximum(ratio - unknown, 0).sum(), np.partition(ratio, len(ratio) - most)[len(ratio) - most :] if len(ratio) > most else ratio


def _sure(shared):
    """Of each text what the head tells, and the keys of what it leaves open."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, w in runs(batch.column("_text"), ALNUM):
                h, at = w.hash, w.at
                first = np.zeros(len(h), bool)
                first[at[:-1][at[:-1] < at[1:]]] = True
                words = model.of(h)
                pairs, key, found = model._pairs(h, first, words)
                open_word = model.open(h, _find(model.word, h)[1])
                open_before = np.append(False, open_word[:-1])[: len(h)] & ~first
                open_pair = model.open(key, found | first)
                some = ~found & (open_pair | open_word | open_before)
                before = np.append(np.uint64(0), h[:-1])[: len(h)]
                asked = [signed(np.where(o, k, np.uint64(0))) for o, k in ((open_pair, key), (open_word, h), (open_before, before))]
                sums, lists = [], []
                for a, b in zip(at[:-1], at[1:]):
                    most = max(1, (b - a) // 50)
                    sums.append((*_sums(words[a:b][~open_word[a:b]], model.unknown, most), *_sums(pairs[a:b][~some[a:b]], model.unknown, most)))
                    p = a + np.flatnonzero(some[a:b])
                    triple = [x[p] for x in asked]
                    lists.append((asked[1][a:b][open_word[a:b]], *triple, pairs[p], np.setdiff1d(np.concatenate(triple), [0])))
                s0, e0, t0, s1, e1, t1 = zip(*sums)
                kinds = [np.int64] * 4 + [np.float32, np.int64]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, j - i), batch.column("_row").slice(i, j - i), pa.array(np.diff(at)), pa.array(s0), pa.array(e0), _lists(t0, np.float32), pa.array(s1), pa.array(e1), _lists(t1, np.float32)]
                    + [_lists(x, k) for x, k in zip(zip(*lists), kinds)],
                    ["_id", "_row", "n", "s0", "e0", "t0", "s1", "e1", "t1", "w", "pair", "word", "before", "base", "need"],
                )

    return of


def _at(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and where each row's begin; null is empty."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])


def _whole(unknown: float, heavy: pa.Table):
    """Three length-normalised ratios of each text by its words, and three by its pairs, with what was open."""
    heavy = [heavy.column(c).to_numpy() for c in ("key", "ratio", "back")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, *sums = (batch.column(c).to_numpy() for c in ("n", "s0", "e0", "s1", "e1"))
            lists = {c: _at(batch.column(c)) for c in ("t0", "t1", "w", "pair", "word", "before", "base", "h_key", "h_ratio", "h_back")}
            out = np.zeros((len(n), 6))
            for k in np.flatnonzero(n):
                row = {c: v[at[k] : at[k + 1]] for c, (v, at) in lists.items()}
                key, ratio, back = (np.concatenate(x) for x in zip((row["h_key"], row["h_ratio"], row["h_back"]), heavy))
                by = np.argsort(key)
                key, ratio, back = key[by], ratio[by], back[by]
                of = lambda c: _find(key, row[c])
                at, hit = of("w")
                words = np.where(hit, ratio[at] if len(key) else 0, unknown)
                pairs = row["base"].astype(np.float64)
                if len(key) and len(pairs):
                    at, hit = of("word")
                    pairs = pairs + np.where(hit, ratio[at] - unknown, 0)
                    at, hit = of("before")
                    pairs = pairs + np.where(hit, back[at], 0)
                    at, hit = of("pair")
                    pairs = np.where(hit, ratio[at], pairs)
                most = max(1, n[k] // 50)
                for c, more, s, e, top in ((0, words, sums[0], sums[1], row["t0"]), (3, pairs, sums[2], sums[3], row["t1"])):
                    s1, e1, t1 = _sums(more, unknown, most)
                    _, _, t = _sums(np.concatenate([top, t1]), unknown, most)
                    out[k, c : c + 3] = (s[k] + s1) / n[k], np.sqrt(max(0.0, e[k] + e1) / n[k]), t.mean()
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *map(pa.array, out.T)], ["_id", *"abcdef"])

    return of


#: A key with more look-ups than this, and more than one in 4096 of all, is broadcast.
_OFTEN = 4096
_NOT_FOUND = pa.table({"key": pa.array([], pa.int64()), "ratio": pa.array([], pa.float32()), "back": pa.array([], pa.float32())})


def features(docs: DataFrame, model: Model) -> DataFrame:
    """Of each row (_id, _text) its _id and six length-normalised ratios, a to f. A key of 0 stands for none."""
    spark, kind = docs.sparkSession, docs.schema["_id"].dataType.simpleString()
    rows = docs.select("_id", "_text", F.monotonically_increasing_id().alias("_row"))
    shared = spark.sparkContext.broadcast(model)
    sure = written(rows.mapInArrow(_sure(shared), f"_id {kind}, _row long, {_SURE}, {_OPEN}"), "sure")
    shared.unpersist()
    heavy, found = _NOT_FOUND, sure.withColumn("h", F.lit(None).cast("array<struct<key:long,ratio:float,back:float>>"))
    if model.bits is not None:
        asked = sure.select("_row", F.explode("need").alias("key"))
        total = sure.agg(F.sum(F.size("need"))).first()[0] or 0
        often = asked.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * 4096 > F.lit(total)).where(F.col("n") > _OFTEN)
        heavy = model.rest.join(often.select("key"), "key").select("key", "ratio", "back").toArrow()
        if heavy.num_rows:  # at most 4096
            asked = asked.join(F.broadcast(spark.createDataFrame(heavy.select(["key"]))), "key", "left_anti")
        hits = asked.join(model.rest, "key").groupBy("_row").agg(F.collect_list(F.struct("key", "ratio", "back")).alias("h"))
        found = sure.join(hits, "_row", "left")
    columns = ["n", "s0", "e0", "t0", "s1", "e1", "t1", "w", "pair", "word", "before", "base"]
    given = found.select("_id", *columns, *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("key", "ratio", "back")])
    return given.mapInArrow(_whole(model.unknown, heavy), f"_id {kind}, a double, b double, c double, d double, e double, f double")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of the features, and the weights with the constant last, by Newton steps."""
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, deviation, w


def _at_most(rows: DataFrame, most: int) -> DataFrame:
    """All rows, or as many as hold about ``most`` words (of six bytes), chosen by a hash of the text."""
    total = (rows.agg(F.sum(F.octet_length("_text") + 6)).first()[0] or 0) // 6
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("_text", F.lit("sample")), F.lit(1 << 32)) < int((1 << 32) * most / total))


def bounded_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", max_rows: int | None = None) -> DataFrame:
    """A label for each document, the largest; all of them, or where ``max_rows`` is given about so many (chosen by a hash of the id)."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    n = rows.count() if max_rows is not None else 0
    if max_rows is not None and n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(id_col, F.lit("labels")), F.lit(1 << 32)) < int((1 << 32) * max_rows / n))
    return rows


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", calibrate=None, max_words: int = 40_000_000, head: int = 1 << 22, least: int = 2):
    """labelled: texts with labels 0 or 1; calibrate: a condition on its rows, those for the logistic function, of which ``max_words`` words or so are taken; head: of words, and of pairs, that go to every task; least: of counts that are modelled. Returns (Model, logistic) or None."""
    small_batches(labelled.sparkSession)
    own = calibrate if calibrate is not None else F.pmod(F.xxhash64(F.col(text_col)), F.lit(3)) == 0
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("_text"), F.col(label_col).cast("double").alias("label"), own.alias("own"))
    counted = rows.where("not own").select("_text", "label")
    counts = written(counted.mapInArrow(_counts, "word long, before long, toxic long, ordinary long").groupBy("word", "before").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "counts")
    model = model_of(counts, least, head)
    forget(counts)
    if model is None:
        return None
    sample = _at_most(rows.where("own"), max_words).select(F.col("label").alias("_id"), "_text")
    f = features(sample, model).toArrow()
    x = np.column_stack([f.column(c).to_numpy() for c in "abcdef"])
    if not len(x):
        return None
    return model, fit_logistic(x, f.column("_id").to_numpy())


def score(df: DataFrame, trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if trained is None:
        return docs.select(F.col("_id").alias(id_col), F.lit(0.0).alias("score"))
    model, (mean, deviation, weight) = trained
    z = F.lit(float(weight[-1]))
    for c, m, d, w in zip("abcdef", mean, deviation, weight):
        z = z + (F.col(c) - float(m)) / float(d) * float(w)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return features(docs, model).select(F.col("_id").alias(id_col), (1 / (1 + F.exp(-z))).alias("score"))

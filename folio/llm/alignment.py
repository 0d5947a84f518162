"""Alignment of two tokenizers over the same bytes: groups between shared cuts, and links of tokens that overlap.

The ends of both tokenizers' tokens are marked in packed bitsets over the bytes of
many texts. Their AND are the cuts that both share; the number of marks up to a cut
(popcounts of whole words, summed, and of one masked word) is the number of tokens
before it, so cuts give token ranges. Their OR are the ends of the pieces in which
one token of each side overlaps: a link each, and its two tokens are those with as
many marks before the piece's end.

How often a pair of ids is linked in the whole corpus needs all texts. The first
pass, over texts alone, writes for each run of texts its distinct pairs with their
counts and for each text its links as numbers of those pairs; runs hold about
``run_bytes`` of text, one text at least. Pairs are summed over the corpus, each
run is sent the sums of its own pairs, and meets its texts again in a cogroup by run.
A pair that is linked everywhere is one row of each run, so none is hot.

Defined results: texts that are null, empty, or not spelt by one of the tokenizers
have no tokens: zeros and ''. Rows with equal or null ids are rows of their own.
Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import forget, small_batches, written
from folio.llm.pieces import ByteLevel, Pieces, bytes_and_offsets, held, led_by_space
from folio.llm.token_ids import _runs


class Marks:
    """A packed bitset over byte offsets, with the number of marks before any of them."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:], dtype=np.int64)

    @classmethod
    def of(cls, offsets: np.ndarray, size: int) -> Marks:
        flags = np.zeros(-(-(size + 1) // 64) * 64, bool)
        flags[offsets] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Marks) -> Marks:
        return Marks(self.words & other.words)

    def __or__(self, other: Marks) -> Marks:
        return Marks(self.words | other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each offset, itself not counted."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self) -> np.ndarray:
        """All marked offsets."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Alignment:
    """Tokens a and b over the same bytes, given by the lengths of each.

    groups: token ranges between shared cuts, ``a_at`` and ``b_at`` with one entry more than groups;
    links: ``a_of`` and ``b_of``, the two tokens of each, in order; ``ends``, where each link ends.
    """

    def __init__(self, a_bytes: np.ndarray, b_bytes: np.ndarray):
        size = int(a_bytes.sum())
        a, b = Marks.of(np.cumsum(a_bytes), size), Marks.of(np.cumsum(b_bytes), size)
        self.cuts = (a & b).select()
        self.a_at = np.concatenate([[0], a.rank(self.cuts) + 1])
        self.b_at = np.concatenate([[0], b.rank(self.cuts) + 1])
        self.ends = (a | b).select()
        self.a_of, self.b_of = a.rank(self.ends), b.rank(self.ends)


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal spelling of the numbers below ``most``, a row each, and its length."""
    text = np.arange(most).astype("S")
    return text.view(np.uint8).reshape(most, -1), np.char.str_len(text)


def spelled_groups(a: np.ndarray, b: np.ndarray, found: Alignment, digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups, and where each group ends in it."""
    rows, sizes = digits
    na, nb = np.diff(found.a_at), np.diff(found.b_at)
    where = np.cumsum(na + nb)
    ids = np.empty(len(a) + len(b), np.int64)
    sign = np.full(len(ids), ord(","), np.uint8)
    a_place = np.arange(len(a)) + np.repeat(found.b_at[:-1], na)  # behind as many b as stand before the group
    b_place = np.arange(len(b)) + np.repeat(found.a_at[1:], nb)
    ids[a_place], ids[b_place] = a, b
    sign[where - 1], sign[where - nb - 1] = ord(";"), ord("|")
    wide = np.empty((len(ids), rows.shape[1] + 1), np.uint8)
    wide[:, :-1] = rows[ids]
    n = sizes[ids]
    wide[np.arange(len(ids)), n] = sign
    kept = np.arange(wide.shape[1]) <= n[:, None]
    return wide[kept], np.cumsum(n + 1)[where - 1]


_DIGITS: dict[int, tuple] = {}


def _align(a_path: str, b_path: str, run_bytes: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = held(ByteLevel, a_path), held(Pieces, b_path)
        width = len(right.spelled)
        most = max(len(left.spelled), width)
        if most not in _DIGITS:
            _DIGITS[most] = _digits(most)
        part, runs = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j in _runs(batch.column("_text"), run_bytes):
                some = batch.slice(i, j - i)
                texts = led_by_space(some.column("_text"))
                data, offsets = bytes_and_offsets(texts)
                a, a_bounds = left.flat(data, offsets)
                b, b_bounds = right.flat(data, offsets)
                whole = left.whole(data, offsets, a, a_bounds) & right.whole(data, offsets, b, b_bounds)
                if not whole.all():
                    of_a, of_b = np.repeat(whole, np.diff(a_bounds)), np.repeat(whole, np.diff(b_bounds))
                    a, b = a[of_a], b[of_b]
                    a_bounds = np.concatenate([[0], np.cumsum(np.diff(a_bounds) * whole)])
                    b_bounds = np.concatenate([[0], np.cumsum(np.diff(b_bounds) * whole)])
                    offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) * whole)])
                found = Alignment(left.bytes_of[a], right.bytes_of[b])
                links, groups = np.searchsorted(found.ends, offsets, side="right"), np.searchsorted(found.cuts, offsets, side="right")
                pairs, numbers, counts = np.unique(a[found.a_of].astype(np.int64) * width + b[found.b_of], return_inverse=True, return_counts=True)
                numbers = numbers.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
                spelled, ends = spelled_groups(a, b, found, _DIGITS[most])
                ends = np.concatenate([[0], ends])
                digests = [hashlib.sha256(spelled[ends[g] : ends[h] - 1]).hexdigest() if h > g else "" for g, h in zip(groups, groups[1:])]
                n = j - i
                first = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(n, len(pairs))]).astype(np.int32)), values)  # noqa: B023, E731
                long = lambda x: pa.array(x, pa.int64())
                pair = pa.StructArray.from_arrays([pa.array(np.arange(len(pairs)), pa.int32()), pa.array(pairs // width, pa.int32()), pa.array(pairs % width, pa.int32()), long(counts)], ["k", "a", "b", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        long(np.full(n, part << 32 | runs)), some.column("_id"), long(np.diff(a_bounds)), long(np.diff(b_bounds)), long(np.diff(groups)), long(np.diff(links)),
                        pa.array(digests, pa.string()), pa.array([numbers[s:e].tobytes() for s, e in zip(links, links[1:])], pa.binary()), first(pair),
                    ],
                    ["run", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs"],
                )
                runs += 1

    return of


def _scored(texts: pa.Table, sums: pa.Table) -> pa.Table:
    """The texts of a run with the sums of its pairs."""
    total, best = np.zeros(sums.num_rows, np.int64), np.zeros(sums.num_rows, np.int64)
    k = sums.column("k").to_numpy()
    total[k], best[k] = sums.column("total").to_numpy(), sums.column("best").to_numpy(zero_copy_only=False)
    kind = "<u2" if len(k) <= 1 << 16 else "<u4"
    count_sum, n_best = [], []
    for links in texts.column("links").to_pylist():
        own = np.frombuffer(links, kind)
        count_sum.append(int(total[own].sum()))
        n_best.append(int(best[own].sum()))
    out = texts.select(["_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", texts.column("groups_sha256"))


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = 1 << 21) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row's whole text, led by a space.

    n_best: links whose pair is linked as often as any pair of its b id; count_sum: sum of the links' pairs' counts.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    numbers = "n_a long, n_b long, n_groups long, n_links long"
    schema = f"run long, _id {kind}, {numbers}, groups_sha256 string, links binary, pairs array<struct<k:int,a:int,b:int,n:long>>"
    texts = written(rows.mapInArrow(_align(a_path, b_path, run_bytes), schema), "alignment")
    pairs = texts.where(F.size("pairs") > 0).select("run", F.explode("pairs").alias("p")).select("run", "p.*")
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    # at most as many rows as a has ids stand beside each b
    total = total.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("b")))
    sums = pairs.drop("n").join(total, ["a", "b"]).select(F.col("run").alias("of_run"), "k", "total", "best")
    own = texts.drop("pairs").groupBy("run").cogroup(sums.groupBy("of_run"))
    out = written(own.applyInArrow(_scored, f"_id {kind}, {numbers}, n_best long, count_sum long, groups_sha256 string"), "aligned")
    forget(texts)
    return out.withColumnRenamed("_id", id_col)

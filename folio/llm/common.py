"""Pieces that several operators of this subpackage share.

Words are found in the UTF-8 bytes of whole Arrow columns with numpy: no Python
object is made for a word or a text. A word is known by a 64-bit hash of its
bytes, eight at a time; where equality must be certain at any scale, a second hash
of the same bytes makes 128 bits.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Odd multiplier of the rolling hashes, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xC2B2AE3D27D4EB4F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: fewer rows go to Python at once, unless the session says otherwise."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(conf) == "10000":
        spark.conf.set(conf, "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and all run on this machine."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folio-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)


def new_dir(spark: SparkSession, name: str) -> str:
    """A path for one table or archive under the shared folder, used by nobody else."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are computed once and kept as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _table(separators: bytes, lower: bool) -> np.ndarray:
    """By byte: 0 for a separator, else the (lower-cased) byte plus one. UTF-8 has no byte 255."""
    t = (np.arange(256) + 1).astype(np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0
    return t


_SPACE = b" \t\n\x0b\x0c\r"
#: Words are runs of ``[^\x20\x09-\x0D]``.
PLAIN = _table(_SPACE, False)
#: The same after A-Z became a-z.
LOWER = _table(_SPACE, True)
#: Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z became a-z.
ALNUM = _table(bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90)), True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder. The query's shuffle files go as soon as it is written."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf, "false")
    spark.conf.set(conf, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(conf, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more: all that was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what an operator needs of its input, under names that no input column has: id, hash of the text, text.

    Rows with equal id and text are interchangeable, so (id, hash) names a row's text even where ids repeat or are null.
    """
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.col(text_col).alias("_text"))


def same_row(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_key"] == b["_key"])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and their offsets; null gives no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def named(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of bytes, from eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    a, b = size.astype(np.uint64) * np.uint64(_BASE), size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    some = slice(None)
    for k in (0, 8, 16):
        w = eight[start[some] + k] & _MASK[np.minimum(size[some] - k, 8)]
        a[some], b[some] = mixed(a[some] ^ w), mixed((b[some] + w) * np.uint64(_BASE2))
        some = np.flatnonzero(size > k + 8)
        if not len(some):
            return a, b
    # what is longer: sums of its other bytes, eight at a time, each mixed with its place
    n = (size[some] - 17) // 8
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    w = eight[np.repeat(start[some] + 24, n) + 8 * place] & _MASK[np.minimum(np.repeat(size[some] - 24, n) - 8 * place, 8)]
    salt = mixed(place.astype(np.uint64) + np.uint64(1))
    a[some] = mixed(a[some] + np.add.reduceat(mixed(w ^ salt), first))
    b[some] = mixed(b[some] + np.add.reduceat(mixed(w * np.uint64(_BASE2) + salt), first))
    return a, b


class Words:
    """The words of some neighbouring texts: two hashes, first byte and end of each; text i has words ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, step: int = 1 << 18):
        parts, n, pos = [], len(data), 0
        while pos < n:
            end = min(pos + step, n)
            while end < n and table[data[end]]:  # never inside a word
                ahead = np.flatnonzero(table[data[end : end + 4096]] == 0)
                end = end + int(ahead[0]) if len(ahead) else min(end + 4096, n)
            parts.append(self._scan(table[data[pos:end]], offsets, pos))
            pos = end
        none = [np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.int64, np.int64)]
        self.hash, self.hash2, self.start, self.end = (np.concatenate(x) for x in zip(*parts)) if parts else none
        self.data, self.offsets = data, offsets
        self.at = np.searchsorted(self.start, offsets)

    @staticmethod
    def _scan(v: np.ndarray, offsets: np.ndarray, pos: int) -> tuple[np.ndarray, ...]:
        n = len(v)
        inside = v != 0
        goes_on = np.zeros(n + 1, bool)
        goes_on[1:n] = inside[1:] & inside[:-1]
        breaks = offsets[np.searchsorted(offsets, pos) : np.searchsorted(offsets, pos + n)] - pos
        goes_on[breaks] = False
        start = np.flatnonzero(inside & ~goes_on[:n])
        end = np.flatnonzero(inside & ~goes_on[1:]) + 1
        return *named(v, start, end), start + pos, end + pos


def runs(column: pa.Array, table: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int, Words]]:
    """Words of a column by runs of texts of about ``limit`` bytes (one text at least): (first, end, words)."""
    data, offsets = strings(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Spans:
    """Hashes of arbitrary runs of a sequence of 64-bit words, all in whole-array operations.

    With prefix sums of ``word[j] * base**j`` the hash of ``[s, e)`` is
    ``(sum[e] - sum[s]) * base**-s``, which depends on the run's words alone.
    """

    def __init__(self, words: np.ndarray, base: int = _BASE):
        n = len(words)
        inverse = pow(base, -1, 1 << 64)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.back = np.full(n + 1, inverse, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(words * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, k: int) -> np.ndarray:
        """Of all runs of k words, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:n]) * self.back[:n])


def both(w: Words) -> tuple[Spans, Spans]:
    """Two hash families over two hashes of each word, for 128 bits together."""
    return Spans(w.hash), Spans(w.hash2, _BASE2)


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of its smallest, the leftmost of equals (40 leading bits are compared)."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    step = 1 << 23
    if len(values) > step + w:
        return np.concatenate([sliding_argmin(values[i : min(i + step, n) + w - 1], w) + i for i in range(0, n, step)])
    low = np.uint64((1 << 24) - 1)
    m = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: n], m[w - size : w - size + n])
    return (m[:n] & low).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: one row (node, component) per node, component the smallest node it reaches.

    Alternating large-star and small-star steps (Kiveris and others, 2014):
    each is a pre-aggregated minimum by node and a join, so neither a hub nor a
    huge component meets in one task. The driver sees two counts a round.
    """
    edges = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    nodes = edges
    while True:
        if edges.isEmpty():
            break
        ways = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = saved(small)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            edges = new
            break
        edges = new
    children = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    del nodes
    return children.unionAll(roots)

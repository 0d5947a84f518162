"""Packing of segments into chunks of bounded token estimates: folds over small arrays, section by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T

_SENTENCE_END = r'(?<=[.!?…])\s+(?=[A-ZÁÉÍÓÚÑ"«—])'


def grouped(parts: Column, sizes: Column, most: int, extra: int = 0) -> Column:
    """Ends of greedy groups of parts: each holds a sum of sizes of at most ``most``; a larger part stands alone.

    extra: size of the joint, counted for all but the first part of a group. The
    fold carries the ends found so far and one sum; sizes are computed beforehand.
    """
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(0).alias("n"))

    def step(s: Column, n: Column) -> Column:
        alone = n > most
        some = s["open"] > 0
        closes = some & (alone | (s["n"] + n + extra > most))
        ends = F.when(closes, F.concat(s["ends"], F.array(s["at"]))).otherwise(s["ends"])
        return F.struct(
            F.when(alone, F.concat(ends, F.array(s["at"] + 1))).otherwise(ends).alias("ends"),
            (s["at"] + 1).alias("at"),
            F.when(alone, 0).when(closes, 1).otherwise(s["open"] + 1).cast("int").alias("open"),
            F.when(alone, 0).when(closes, n).otherwise(s["n"] + n + F.when(some, extra).otherwise(0)).cast("int").alias("n"),
        )

    return F.aggregate(sizes, start, step, lambda s: F.when(s["open"] > 0, F.concat(s["ends"], F.array(s["at"]))).otherwise(s["ends"]))


def packed(parts: Column, most: int, joint: str, size=T.est_tokens, extra: int = 0) -> Column:
    """Parts joined greedily while the sum of their sizes is at most ``most``; a larger part stands alone. size: of a part."""
    piece = lambda p, ends, end, k: F.array_join(F.slice(p, F.when(k == 0, 0).otherwise(F.get(ends, k - 1)) + 1, end - F.when(k == 0, 0).otherwise(F.get(ends, k - 1))), joint)
    cut = lambda p, ends: F.transform(ends, lambda end, k: piece(p, ends, end, k))
    whole = lambda p: T.bound(grouped(p, F.transform(p, size), most, extra), lambda ends: cut(p, ends))
    return T.bound(parts, whole)


def by_sentences(text: Column, most: int, size=T.est_tokens) -> Column:
    return packed(F.split(text, _SENTENCE_END), most, " ", size)


def split_large(text: Column, most: int, size=T.est_tokens) -> Column:
    """A segment's text in pieces of at most ``most`` tokens: by paragraphs, an oversize paragraph by sentences."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), T.strip), lambda p: p != "")
    smaller = lambda p: F.when(size(p) > most, by_sentences(p, most, size)).otherwise(F.array(p))
    pieces = lambda p: F.when(F.size(p) <= 1, by_sentences(text, most, size)).otherwise(F.flatten(F.transform(packed(p, most, "\n\n", size), smaller)))
    return F.when(size(text) <= most, F.array(text)).otherwise(T.bound(paragraphs, pieces))


def merged_small(segs: Column, least: int, most: int, size=T.est_tokens) -> Column:
    """Array of (text, boundary_type, position, tokens): a segment under ``least`` takes in its successor, never over a chapter."""
    start = F.slice(segs, 1, 1)

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        text = F.concat(last["text"], F.lit("\n\n"), s["text"])
        joined = F.struct(text.alias("text"), last["boundary_type"].alias("boundary_type"), last["position"].alias("position"), size(text).alias("tokens"))
        can = (last["tokens"] < least) & (last["tokens"] + s["tokens"] <= most) & (s["boundary_type"] != "chapter") & (last["boundary_type"] != "chapter")
        return F.when(can, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.slice(segs, F.lit(2), F.greatest(F.size(segs) - 1, F.lit(0))), start, step)


def expanded(segments: DataFrame, most: int, *keys: str, size=T.est_tokens) -> DataFrame:
    """Large segments in pieces: pieces inherit the position and become paragraphs."""
    large = F.col("token_estimated") > most
    rows = segments.withColumn("large", large).select(*keys, "seg_no", "boundary_type", "original_position", "large", F.posexplode(F.when(large, split_large(F.col("text"), most, size)).otherwise(F.array("text"))).alias("piece", "text"))
    return rows.select(*keys, "seg_no", "piece", F.when(F.col("large"), "paragraph").otherwise(F.col("boundary_type")).alias("boundary_type"), "original_position", "text", size(F.col("text")).alias("token_estimated"))


def chunks(segments: DataFrame, least: int, most: int, *keys: str, size=T.est_tokens) -> DataFrame:
    """(keys, chunk_index, original, token_estimated, boundary_type, status) of each section's segments. size: the token estimate of a text."""
    rows = expanded(segments, most, *keys, size=size)
    piece = F.struct("seg_no", "piece", "text", "boundary_type", F.col("original_position").alias("position"), F.col("token_estimated").alias("tokens"))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("s"))
    plain = F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["boundary_type"].alias("boundary_type"), x["position"].alias("position"), x["tokens"].alias("tokens")))
    out = whole.select(*keys, F.posexplode(merged_small(plain, least, most, size)).alias("chunk_index", "c"))
    return out.select(*keys, "chunk_index", F.col("c.text").alias("original"), F.col("c.tokens").alias("token_estimated"), F.col("c.boundary_type").alias("boundary_type"), F.lit("pending").alias("status"))


def indexed(chunks_: DataFrame, book: str, section: str) -> DataFrame:
    """The sections' chunks numbered through the book."""
    return chunks_.withColumn("book_index", F.row_number().over(W.partitionBy(book).orderBy(section, "chunk_index")) - 1)


def char_chunks(text: Column, most: int = 1200) -> Column:
    """Blocks between blank lines, joined while their characters with joints are at most ``most``."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), T.strip), lambda b: b != "")
    return packed(blocks, most, "\n\n", F.length, 2)

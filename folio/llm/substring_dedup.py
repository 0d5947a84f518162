"""Substring dedup: winnowed seeds, extension both ways, maximal repeats over a length threshold.

A window is ``length`` consecutive words of one document. A word is removed if
it lies in a window whose word sequence also starts anywhere else, in the same
document or another; windows are judged on the input.

1. Seeds. Every window picks the smallest hash among its runs of ``seed`` words
   (leftmost of equals), so equal windows pick the same seed at the same place.
   Seeds that occur once in all documents are dropped: nothing repeats there.
2. Extension. The windows that picked one seed occurrence are neighbours; with
   the seed they span a run reaching out to both sides. Occurrences whose whole
   runs are equal (128 bits) repeat as a whole: one class, counted with map-side
   sums, never paired. Only where classes of a seed differ do their windows
   differ at the edges: there one representative of each class is extended window
   by window, and each window's count decides how far each side reaches.
3. Maximal repeats. Repeated runs of a document are merged and cut out.

No step gathers a group: each is a pre-aggregated count or a join on a key whose
hot values AQE can split, and document text is joined only to its own spans.

Defined results: null text has no words; rows are kept one to one, whatever
repeats in them; equal rows count as two documents, whose spans are kept once; ids
may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import PLAIN, Words, both, keyed, runs, same_row, signed, sliding_argmin, strings, written


def _owned(w: Words, seed: int, length: int):
    """Seed occurrences with their windows: seed hash, text, first and last window, and both span families."""
    one, two = both(w)
    seeds = one.every(seed)
    place = sliding_argmin(seeds, length - seed + 1)
    first = np.arange(len(place))
    text = np.searchsorted(w.at, first, side="right") - 1
    whole = first + length <= w.at[text + 1]
    first, place, text = first[whole], place[whole], text[whole]
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(first)) - 1 if len(lo) else lo
    return seeds[place[lo]], text[lo], first[lo], first[hi], one, two


def _seeds(seed: int, length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in runs(batch.column("_text"), PLAIN):
                a, counts = np.unique(_owned(w, seed, length)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(counts)], ["a", "n"])

    return of


def _occurrences(seed: int, length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, w in runs(batch.column("_text"), PLAIN):
                a, text, lo, hi, one, two = _owned(w, seed, length)
                rows = pa.array(text + i)
                span = (lo - w.at[text]) << 8 | (hi - lo + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(a)), pa.array(signed(one.of(lo, hi + length))), pa.array(signed(two.of(lo, hi + length))), batch.column("_id").take(rows), batch.column("_key").take(rows), pa.array(span)],
                    ["a", "c1", "c2", "_id", "_key", "span"],
                )

    return of


def _windows(length: int):
    """One row for each window of the listed runs, with its class's count."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, sizes = batch.column("spans"), batch.column("sizes")
            for i, j, w in runs(batch.column("_text"), PLAIN):
                one, two = both(w)
                part, count = spans.slice(i, j - i), sizes.slice(i, j - i)
                span, size = part.flatten().to_numpy(), count.flatten().to_numpy()
                text = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                width, lo = span & 255, (span >> 8) + w.at[text]
                each = np.repeat(np.arange(len(span)), width)
                start = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)
                rows = pa.array(text[each] + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(one.of(start, start + length))), pa.array(signed(two.of(start, start + length))), batch.column("_id").take(rows), batch.column("_key").take(rows), pa.array((start - w.at[text[each]]) << 8 | 1), pa.array(size[each])],
                    ["c1", "c2", "_id", "_key", "span", "n"],
                )

    return of


def _cut(length: int):
    """Texts without their repeated words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for i, j, w in runs(batch.column("_text"), PLAIN):
                part = spans.slice(i, j - i)
                span = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()) if part.null_count == 0 else part.value_lengths().fill_null(0).to_numpy())
                lo = (span >> 8) + w.at[text]
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, lo + (span & 255) - 1 + length, -1)
                out = np.cumsum(edge[:-1]) > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(out)])[w.at])
                keep = ~out
                s, e = w.start[keep], w.end[keep]
                at = np.concatenate([[0], np.cumsum(keep)])[w.at]
                size = e - s + 1  # and a space
                begin = np.concatenate([[0], np.cumsum(size)])
                index = np.repeat(s - begin[:-1], size) + np.arange(begin[-1])
                data = w.data[np.minimum(index, len(w.data) - 1)] if len(index) else np.zeros(0, np.uint8)
                data[begin[1:] - 1] = 32
                raw = data.tobytes()
                kept = [raw[a : max(a, b - 1)] for a, b in zip(begin[at[:-1]], begin[at[1:]])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, j - i), pa.array(np.diff(w.at)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["_id", "n_words", "n_removed", "kept_text"],
                )

    return of


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, seed: int = 12) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (kept words joined by one space)."""
    if not 0 < seed <= length <= seed + 254:
        raise ValueError("seed: 1 to length, and length at most 254 more")  # a span holds its number of windows in eight bits
    docs = keyed(df, id_col, text_col)
    key = docs.schema["_id"].dataType.simpleString()
    seeds = docs.select("_text").mapInArrow(_seeds(seed, length), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a")
    seeds = written(seeds, "repeated-seeds")  # apart from the join, so that a hot seed's occurrences can be dealt to several tasks
    found = docs.mapInArrow(_occurrences(seed, length), f"a long, c1 long, c2 long, _id {key}, _key long, span long").join(seeds, "a", "left_semi")
    found = written(found, "seeds")
    classes = written(found.groupBy("a", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_key", "span")).alias("r")), "classes")
    mixed = written(classes.groupBy("a").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("a"), "mixed-seeds")
    listed = classes.join(mixed, "a", "left_semi").groupBy("r._id", "r._key").agg(F.collect_list(F.struct("r.span", "n")).alias("x"))
    listed = listed.select("_id", "_key", F.col("x.span").alias("spans"), F.col("x.n").alias("sizes"))
    # of rows with equal id and text one stands for all: their runs are in classes of two or more
    texts = docs.join(listed, same_row(docs, listed)).select(docs["_id"], docs["_key"], "_text", "spans", "sizes")
    windows = texts.mapInArrow(_windows(length), f"c1 long, c2 long, _id {key}, _key long, span long, n long")
    windows = written(windows, "windows")
    repeated = windows.groupBy("c1", "c2").agg(F.sum("n").alias("n")).where("n > 1").select("c1", "c2")
    edges = windows.where("n = 1").join(repeated, ["c1", "c2"], "left_semi").select("_id", "_key", "span")
    whole = found.join(classes.where("n > 1").select("c1", "c2"), ["c1", "c2"], "left_semi").select("_id", "_key", "span")
    spans = whole.unionAll(edges).groupBy("_id", "_key").agg(F.collect_set("span").alias("spans"))
    spans = written(spans, "spans")
    marked = docs.join(spans, same_row(docs, spans), "left").select(docs["_id"], "_text", "spans")
    out = marked.mapInArrow(_cut(length), f"_id {key}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("_id", id_col)

"""Benchmark decontamination: an FM-index per training shard, searched for every test phrase.

A phrase is ``window`` consecutive words of a benchmark item, or a whole item of
fewer words. A shard is what one task reads of the documents, closed when its
index holds ``shard`` symbols. Symbols are the words that occur in the benchmark
at all; a document's other words can't be in a phrase, so they part the sequence,
and a stretch shorter than the shortest phrase holds none. Backward search through
the wavelet matrix's ranks finds all phrases of a length together, sampled suffix
positions place their occurrences, and overlapping ones merge into removal spans.

The benchmark goes to the executors in blocks of a bounded number of phrases;
the documents' text is never shuffled.

Defined results: null and empty texts have no words and no spans; items without
words are never found; item ids are compared as strings; items without an id are
found like others and stand as one null in the list; rows map one to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ALNUM, Spans, Words, keyed, runs, same_row, strings, written
from folio.llm.fm_index import FMIndex

#: Phrases that are broadcast and searched at once.
BLOCK = 1 << 18


class Phrases:
    """Distinct phrases of some items: symbols by word hash, and per length the patterns with the items they come from."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        every = [w for _, w in items]
        self.words = np.unique(np.concatenate(every))
        by_length: dict[int, dict[bytes, set[str | None]]] = {}
        for name, words in items:
            codes = np.searchsorted(self.words, words) + 1
            k = min(window, len(codes))
            for s in range(len(codes) - k + 1):
                by_length.setdefault(k, {}).setdefault(codes[s : s + k].astype(np.int64).tobytes(), set()).add(name)
        self.patterns = {k: (np.frombuffer(b"".join(d), np.int64).reshape(-1, k), [_sorted(names) for names in d.values()]) for k, d in by_length.items()}
        self.shortest = min(by_length)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.words >> np.uint64(48)] = True

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.words, hashes[some]), len(self.words) - 1)
        out[some] = np.where(self.words[at] == hashes[some], at + 1, 0)
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block: int) -> Iterator[Phrases]:
    items, count = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        data, offsets = strings(pa.array([row.t]))
        w = Words(data, offsets, ALNUM).hash
        if len(w):
            items.append((row.i, w))
            count += max(1, len(w) - window + 1)
        if count >= block:
            yield Phrases(items, window)
            items, count = [], 0
    if items:
        yield Phrases(items, window)


def _search(shared, shard: int):
    def flush(phrases: Phrases, pending: list) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([p[0] for p in pending])
        keys = pa.concat_arrays([p[1] for p in pending])
        n_words = np.concatenate([p[2] for p in pending])
        codes, row, pos, base = [], [], [], 0
        for p in pending:
            codes.append(p[3])
            row.append(p[4] + base)
            pos.append(p[5])
            base += len(p[2])
        codes, row, pos = map(np.concatenate, (codes, row, pos))
        begin, end, names = {}, {}, {}
        if codes.any():
            index = FMIndex(codes, len(phrases.words))
            for k, (patterns, items) in phrases.patterns.items():
                found, place = index.search(patterns)
                for r in np.unique(row[place]) if len(place) else ():
                    begin.setdefault(int(r), [])
                    end.setdefault(int(r), [])
                    names.setdefault(int(r), set())
                for f, p in zip(found.tolist(), place.tolist()):
                    r = int(row[p])
                    begin[r].append(int(pos[p]))
                    end[r].append(int(pos[p]) + k)
                    names[r].update(items[f])
        spans, items = [], []
        for r in range(len(n_words)):
            spans.append(_merged(sorted(zip(begin[r], end[r]))) if r in begin else [])
            items.append(_sorted(names[r]) if r in names else [])
        yield pa.RecordBatch.from_arrays(
            [ids, keys, pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
            ["_id", "_key", "n_words", "spans", "items"],
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, pending, symbols, rows = shared.value, [], 0, 0
        for batch in batches:
            for i, j, w in runs(batch.column("_text"), ALNUM):
                codes = phrases.codes(w.hash)
                text = np.repeat(np.arange(j - i), np.diff(w.at))
                known = codes > 0
                new = np.ones(len(codes), bool)
                new[1:] = (known[1:] != known[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(codes)))
                keep = np.repeat(known[first] & (size >= phrases.shortest), size) if len(first) else known
                at = np.flatnonzero(keep)
                # a 0 before each stretch parts it from the one before
                gap = np.flatnonzero(new[at])
                put = lambda x, at=at, gap=gap: np.insert(x[at], gap, 0)
                pending.append((batch.column("_id").slice(i, j - i), batch.column("_key").slice(i, j - i), np.diff(w.at), put(codes), np.insert(text[at], gap, 0), put(np.arange(len(codes)) - w.at[text])))
                symbols, rows = symbols + len(pending[-1][3]), rows + j - i
                if symbols >= shard or rows >= 20_000:
                    yield from flush(phrases, pending)
                    pending, symbols, rows = [], 0, 0
        if pending:
            yield from flush(phrases, pending)

    return of


def _sorted(names: set) -> list:
    """Item ids in order; those of items without an id are one null at the end, which a list of ids leaves out."""
    return [*sorted(names - {None}), *([None] if None in names else [])]


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items that several blocks have found in the same documents."""
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in _merged(sorted((x["start"], x["end"]) for y in s for x in y))] for s in batch.column("spans").to_pylist()]
        items = [_sorted({x for y in s for x in y}) for s in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], ["_id", "_key", "spans", "items"])


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shard: int = 1 << 20, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, text_key, n_words, n_hit, spans (words from start to before end), items (ids, sorted), contaminated.

    contaminated: at least one word in 20 is in an occurrence of a phrase.
    """
    docs = keyed(df, id_col, text_col)
    kind = docs.schema["_id"].dataType.simpleString()
    spans = "spans array<struct<start:bigint,end:bigint>>, items array<string>"
    schema = f"_id {kind}, _key long, n_words long, {spans}"
    blocks = _blocks(benchmark, item_col, item_text_col, window, block)
    first, second = next(blocks, None), next(blocks, None)
    send = df.sparkSession.sparkContext.broadcast
    if first is None:
        out = docs.select("_id", "_key", F.size(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("_text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda x: x != "")).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    elif second is None:
        out = docs.mapInArrow(_search(send(first), shard), schema)
    else:
        out = docs.mapInArrow(_search(send(first), shard), schema)
        hits = written(out.where("size(spans) > 0").select("_id", "_key", "spans", "items"), "hits")
        for phrases in (p for some in ([second], blocks) for p in some):
            hits = hits.unionAll(written(docs.mapInArrow(_search(send(phrases), shard), schema).where("size(spans) > 0").select("_id", "_key", "spans", "items"), "hits"))
        hits = hits.groupBy("_id", "_key").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")).mapInArrow(_union, f"_id {kind}, _key long, {spans}")
        words = out.select("_id", "_key", "n_words")
        empty = [F.coalesce(hits[c], F.expr(f"cast(array() as {out.schema[c].dataType.simpleString()})")).alias(c) for c in ("spans", "items")]
        out = words.join(hits, same_row(words, hits), "left").select(words["_id"], words["_key"], "n_words", *empty)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = out.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.select(F.col("_id").alias(id_col), F.col("_key").alias("text_key"), "n_words", "n_hit", "spans", "items", "contaminated")

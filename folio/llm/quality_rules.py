"""Quality rules: thresholds from mergeable quantile sketches per language and source, then a joined filter.

Each document's ratios (signs of mark-up per word, characters per word, repeated
lines per line) go into KLL sketches per (language, source); the sketches merge
into one per language, which serves sources with fewer than ``least`` documents.
A threshold lies some spreads beyond the median of the group, so it follows what
is usual there; a least spread keeps groups in which all documents are alike from
rejecting small differences. Documents join their group's thresholds; for texts
of few words, whose ratios scatter more, the distance allowed grows with the
inverse square root of their number.

Beside that a fixed base rule fails documents with fewer than 10 words or with
over 20 % of the words in 5-word windows that occur twice or more in the text.

Defined results: null text has no words and fails the base; null languages and
sources are groups of their own; input columns come back unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import PLAIN, Spans, Words, _table, mixed, runs, small_batches, written

_LINES = _table(b"\n", False)
_SIGNS = np.zeros(256, np.int64)
_SIGNS[list(b"#*$%&|<>")] = 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Ratio: the sides that are cut, how many spreads from the median, the least spread.
RULES = {"symbol_ratio": ("above", 4.0, 0.025), "word_length": ("both", 6.0, 0.4), "dup_line_ratio": ("above", 6.0, 0.1)}

#: Input columns of these names are left out.
_OWN = ("_c", "_q", "_cut")
#: Texts of fewer words get more distance.
STEADY = 100


def counts(texts: pa.Array) -> pa.Array:
    """The counts of each text, over the whole text."""
    parts = []
    for _, _, w in runs(texts, PLAIN):
        n = len(w.at) - 1
        text = np.repeat(np.arange(n), np.diff(w.at))
        running = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum((w.data & 0xC0) != 0x80, out=running[1:])
        chars = np.bincount(text, running[w.end] - running[w.start], n)
        np.cumsum(_SIGNS[w.data], out=running[1:])
        signs = np.diff(running[w.offsets])
        lines = Words(w.data, w.offsets, _LINES)
        line_text = np.repeat(np.arange(n), np.diff(lines.at))
        full = np.searchsorted(w.start, lines.start) < np.searchsorted(w.start, lines.end)
        line_text, line_hash = line_text[full], lines.hash[full]
        n_lines = np.bincount(line_text, minlength=n)
        _, first = np.unique(line_hash ^ mixed(line_text.astype(np.uint64)), return_index=True)
        dup = n_lines - np.bincount(line_text[first], minlength=n)
        start = np.arange(max(len(text) - 4, 0))
        start = start[text[start] == text[start + 4]] if len(start) else start
        keys = Spans(w.hash).every(5)[start] ^ mixed(text[start].astype(np.uint64))
        _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
        again = start[size[group] > 1]
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 5, -1)
        repeat = np.bincount(text, np.cumsum(edge[:-1]) > 0, n)
        parts.append(np.stack([np.diff(w.at), chars, signs, n_lines, dup, repeat]).astype(np.int64))
    whole = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(x) for x in whole], list(COUNTS))


counts_udf = F.arrow_udf(counts, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))


def _measured(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One struct column _q beside the input's."""
    some = F.col("_c.n_words") > 0
    ratios = [
        F.when(some, F.col("_c.n_symbols") / F.col("_c.n_words")).alias("symbol_ratio"),
        F.when(some, F.col("_c.word_chars") / F.col("_c.n_words")).alias("word_length"),
        F.when(F.col("_c.n_lines") > 0, F.col("_c.n_dup_lines") / F.col("_c.n_lines")).alias("dup_line_ratio"),
    ]
    failed = (F.col("_c.n_words") < 10) | (100 * F.col("_c.n_repeat_words") > 20 * F.col("_c.n_words"))
    out = df.drop(*_OWN).withColumn("_c", counts_udf(F.col(text_col)))
    return out.withColumn("_q", F.struct("_c.*", *ratios, failed.alias("base_failed"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))).drop("_c")


def thresholds(measured: DataFrame, least: int = 50, k: int = 400) -> DataFrame:
    """(lang, source, a lowest and a highest value of each ratio)."""
    rows = measured.where("_q.n_words > 0").select("_q.*")
    sketches = written(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(k)).alias(r) for r in RULES]), "sketches")
    by_lang = sketches.groupBy(F.col("lang").alias("l")).agg(*[F.kll_merge_agg_double(r, F.lit(k)).alias(f"{r}_lang") for r in RULES])
    both = sketches.join(by_lang, F.col("lang").eqNullSafe(F.col("l")))
    cuts = []
    for r, (side, spreads, smallest) in RULES.items():
        q = F.when(F.col("n") >= least, F.col(r)).otherwise(F.col(f"{r}_lang"))
        low, mid, high = (F.kll_sketch_get_quantile_double(q, F.lit(p)) for p in (0.25, 0.5, 0.75))
        cuts.append(mid.alias(f"{r}_mid"))
        cuts.append((mid + spreads * F.greatest(high - mid, F.lit(smallest))).alias(f"{r}_max"))
        cuts.append((mid - spreads * F.greatest(mid - low, F.lit(smallest)) if side == "both" else F.lit(float("-inf"))).alias(f"{r}_min"))
    return both.select("lang", "source", *cuts)


def quality_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 50) -> DataFrame:
    """The input's columns and a struct _q: counts, ratios, base_failed, kept."""
    small_batches(df.sparkSession)
    measured = _measured(df, text_col, lang_col, source_col)
    cuts = written(thresholds(measured, least), "thresholds").select(F.struct("*").alias("_cut"))
    on = F.col("_q.lang").eqNullSafe(F.col("_cut.lang")) & F.col("_q.source").eqNullSafe(F.col("_cut.source"))
    inside = F.lit(True)
    slack = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(STEADY)) / F.greatest(F.col("_q.n_words"), F.lit(1))))
    for r in RULES:
        mid = F.col(f"_cut.{r}_mid")
        inside &= F.coalesce((mid + (F.col(f"_q.{r}") - mid) / slack).between(F.col(f"_cut.{r}_min"), F.col(f"_cut.{r}_max")), F.lit(True))
    kept = ~F.col("_q.base_failed") & inside
    out = measured.join(cuts, on, "left").withColumn("_q", F.col("_q").withField("kept", kept))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in _OWN], "_q")

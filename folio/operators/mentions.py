"""Mentions of named characters: name tokens, evidence from their context, scores and the best of each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.functions.text import folded

_LETTERS = "A-Za-zÁÉÍÓÚÑáéíóúñ"


#: Characters of context that any rule looks at.
_NEAR = 42
# a capital is looked for first, what stands before it after that
_WHOLE = rf"{L.NAME[:L.NAME.index(']') + 1]}(?<![\p{{L}}\p{{N}}_].){L.NAME[L.NAME.index(']') + 1:]}(?![\p{{L}}\p{{N}}_])"


def _cut(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """(keys, _row, _pos, _piece, name, before, after, sentence_start): a text is cut behind its names; _piece is the length of a name with the gap before it.

    A name's context is its own and the next gap, or if one is short the pieces on that side: each has four characters
    at least, so eleven hold the context. Nothing of this needs a shuffle.
    """
    text = F.col(text_col)
    pieces, names = F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{_WHOLE}|\z)"), F.lit(0)), F.regexp_extract_all(text, F.lit(_WHOLE), F.lit(0))
    texts = df.select(*keys, F.monotonically_increasing_id().alias("_row"), pieces.alias("_pieces"), names.alias("_names"))
    rows = texts.select(*keys, "_row", "_pieces", F.posexplode("_names").alias("_pos", "name"))
    piece, following, at = F.get("_pieces", F.col("_pos")), F.get("_pieces", F.col("_pos") + 1), F.col("_pos")
    rows = rows.select(*keys, "_row", "_pos", "_pieces", "name", F.length(piece).alias("_piece"), F.left(piece, F.length(piece) - F.length("name")).alias("gap"), following.alias("next"))
    joined = lambda start, n: F.array_join(F.slice("_pieces", start, n), "")
    before = F.when(F.length("gap") >= _NEAR, F.col("gap")).otherwise(F.concat(joined(F.greatest(at - 11, F.lit(0)) + 1, F.least(at, F.lit(11))), "gap"))
    after = F.when(F.length("next") >= _NEAR, F.col("next")).otherwise(joined(at + 2, F.lit(11)))
    # the last sign before a name; a gap of white space leaves the name before it, or the text's beginning
    last = lambda c: F.regexp_extract(c, r"(?U)(\S)\s*$", 1)
    sign = F.coalesce(F.nullif(last(F.right("gap", F.lit(_NEAR))), F.lit("")), F.when(F.length("gap") > _NEAR, last(F.col("gap"))), F.lit(""))
    end = F.right(F.rtrim("gap"), F.lit(1))
    sign = F.when((end == "") | end.rlike(r"(?U)\s"), sign).otherwise(end)
    starts = sign.isin(".", "!", "?") | ((sign == "") & (at == 0))
    return rows.select(*keys, "_row", "_pos", "_piece", "name", F.right(before, F.lit(_NEAR)).alias("before"), F.left(after, F.lit(_NEAR)).alias("after"), starts.alias("sentence_start"))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds start, by the sizes of the pieces so far."""
    so_far = F.sum("_piece").over(W.partitionBy("_row").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("start", (so_far - F.length("name")).cast("int")).drop("_row", "_pos", "_piece")


def name_tokens(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """(keys, name, start, before, after, sentence_start) of each run of letters and digits that is a name.

    start counts characters from 0; before and after hold the 42 characters around it. Rows with equal or null keys
    are texts of their own.
    """
    return _placed(_cut(df, *keys, text_col=text_col)).select(*keys, "name", "start", "before", "after", "sentence_start")


def evidence(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """The names with their evidence, which is taken behind the shuffle: an input of one file is cut by few tasks."""
    return with_evidence(name_tokens(df, *keys, text_col=text_col))


def with_evidence(names: DataFrame) -> DataFrame:
    """Adds norm and the flags of each mention's context."""
    name = F.col("name")
    before = lambda n: F.right("before", F.lit(n))
    after = lambda n: F.left("after", F.lit(n))
    word = lambda c: folded(F.regexp_extract(c, f"(?<![{_LETTERS}])([{_LETTERS}]++)[^{_LETTERS}]*+$", 1))
    verbs = lambda v: "(?:" + "|".join(v) + ")"
    edge = r"(?![\p{L}\p{N}_])"
    spoken = rf"(?iu)(?<![\p{{L}}\p{{N}}_]){verbs(L.SPEECH)}\s+"
    said = F.concat(F.lit(spoken), name, F.lit(edge))  # a pattern for each name: only tried where there is a verb
    return names.select(
        *[c for c in names.columns if c not in ("before", "after", "sentence_start")],
        folded(name).alias("norm"),
        "sentence_start",
        ((before(42).rlike(spoken) & F.regexp_like(before(42), said)) | after(42).rlike(rf"(?iu)^\s+{verbs(L.SPEECH)}{edge}")).alias("speech"),
        after(24).rlike(rf"(?iu)^\s+{verbs(L.ACTION)}{edge}").alias("action"),
        word(before(20)).isin(L.TITLES).alias("title"),
        word(before(25)).isin(L.GENITIVE).alias("genitive"),
    )


def stats(evidence: DataFrame, *keys: str) -> DataFrame:
    count = lambda c: F.sum(F.col(c).cast("int")).alias(f"{c}_hits")
    return evidence.groupBy(*keys, "norm").agg(
        F.count("*").alias("occurrences"), F.min("start").alias("first_index"), F.min_by("name", "start").alias("display"), *map(count, ("sentence_start", "speech", "action", "title", "genitive"))
    )


def score() -> Column:
    return F.least(F.col("occurrences"), F.lit(3)) + 3 * F.col("speech_hits") + 3 * F.col("action_hits") + 2 * F.col("title_hits") - F.when(F.col("occurrences") == F.col("sentence_start_hits"), 2).otherwise(0)


def ranked(counted: DataFrame, *keys: str, known: DataFrame | None = None, most: int = 6) -> DataFrame:
    """The best ``most`` of each text. known: (keys, name) of names that need no evidence; their spelling wins, of several the one with the highest ``place`` if there is such a column."""
    if known is not None:
        later = F.struct(F.col("place") if "place" in known.columns else F.lit(0), "name")
        given = known.withColumn("norm", folded(F.col("name"))).groupBy(*keys, "norm").agg(F.max_by("name", later).alias("known"))
        counted = counted.join(given, [*keys, "norm"], "left")
    else:
        counted = counted.withColumn("known", F.lit(None).cast("string"))
    verbs = sorted({*_plain(L.SPEECH), *_plain(L.ACTION)})
    direct = (F.col("speech_hits") > 0) | (F.col("action_hits") > 0) | (F.col("title_hits") > 0)
    repeated = (F.col("occurrences") >= 2) & (F.col("sentence_start_hits") < F.col("occurrences"))
    fit = ~F.col("norm").isin(L.NOT_NAMES) & ~F.col("norm").isin(verbs) & ~(~direct & (F.col("genitive_hits") >= F.col("occurrences"))) & (score() >= 2) & (direct | repeated)
    rows = counted.withColumn("score", F.when(F.col("known").isNotNull(), 100 + F.col("occurrences")).otherwise(score()).cast("int"))
    rows = rows.withColumn("name", F.coalesce("known", "display")).where(F.col("known").isNotNull() | fit)
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("occurrences"), F.asc("first_index"), F.desc("name"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*keys, "rank", "name", "score", "occurrences")


def _plain(words: list[str]) -> list[str]:
    signs = dict.fromkeys(map(ord, L.ACCENTED)) | dict(zip(map(ord, L.ACCENTED), L.PLAIN))  # marks alone go
    return [w.translate(signs).lower() for w in words]


def character_mentions(df: DataFrame, *keys: str, text_col: str = "text", known: DataFrame | None = None, most: int = 6) -> DataFrame:
    return ranked(stats(evidence(df, *keys, text_col=text_col), *keys), *keys, known=known, most=most)

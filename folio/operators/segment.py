"""Lines, segments and sections of texts: gaps and islands over line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.functions import text as T

def lines(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """(keys, line_no, line with its end, start): start is the offset of its first character."""
    text = F.col(text_col)
    parts = F.split(text, r"(?<=\n)|(?<=[\x0b\x0c\x1c-\x1e\x85  ])|(?<=\r)(?!\n)")
    rows = df.select(*keys, F.posexplode(F.filter(parts, lambda x: x != "")).alias("line_no", "line"))
    before = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)).cast("int"))


#: Patterns by kind; a genre may have others.
PATTERNS = {"chapter": L.CHAPTER, "scene": L.SCENE, "pov": L.POINT_OF_VIEW}


def boundary(line: Column, previous_blank: Column, inside: Column, patterns: dict[str, list[str]] | None = None) -> Column:
    """What begins at a line: chapter, scene, pov or null. A blank line after a blank one parts scenes, not at the ends."""
    s, own = T.strip(line), PATTERNS | (patterns or {})
    return (
        F.when((s == "") & previous_blank & inside, "scene")
        .when(s == "", F.lit(None))
        .when(T.matches(s, own["chapter"]), "chapter")
        .when(T.matches(s, own["scene"]), "scene")
        .when(T.matches(s, own["pov"]), "pov")
    )


def classified(df: DataFrame, *keys: str, text_col: str = "text", patterns: dict[str, list[str]] | None = None) -> DataFrame:
    rows = lines(df, *keys, text_col=text_col)
    w = W.partitionBy(*keys).orderBy("line_no")
    blank = T.strip(F.col("line")) == ""
    last = F.count("*").over(W.partitionBy(*keys)) - 1
    inside = (F.col("line_no") > 0) & (F.col("line_no") < last)
    return rows.withColumn("boundary", boundary(F.col("line"), F.coalesce(F.lag(blank).over(w), F.lit(False)), inside, patterns))


def segments(df: DataFrame, *keys: str, text_col: str = "text", patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, seg_no, boundary_type, original_position, text, token_estimated); blank segments go."""
    w = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = classified(df, *keys, text_col=text_col, patterns=patterns).withColumn("island", F.sum(F.when(F.col("boundary").isNotNull() & (F.col("line_no") > 0), 1).otherwise(0)).over(w))
    out = rows.groupBy(*keys, "island").agg(
        F.min_by("boundary", "line_no").alias("b"), F.min("start").alias("original_position"), F.expr("listagg(line) WITHIN GROUP (ORDER BY line_no)").alias("text")
    )
    out = out.withColumn("text", T.strip(F.col("text"))).where(F.col("text") != "")
    return out.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy("island")) - 1).alias("seg_no"), F.coalesce("b", F.lit("paragraph")).alias("boundary_type"), "original_position", "text", T.est_tokens(F.col("text")).alias("token_estimated"))


def has_markers(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: T.matches(x, L.SECTION_MARKERS))) >= 2


def sections(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """(keys, section_idx, text): split at marker lines; the marker opens its section; blank sections go."""
    rows = df.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    w = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.sum(F.when(T.matches(F.col("line"), L.SECTION_MARKERS) & (F.col("line_no") > 0), 1).otherwise(0)).over(w))
    out = rows.groupBy(*keys, "island").agg(T.strip(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)")).alias("text")).where("text <> ''")
    return out.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy("island")) - 1).alias("section_idx"), "text")


def merged_blocks(blocks: Column, least: int = 40) -> Column:
    """Blocks joined by blank lines until they have ``least`` words; a short rest joins the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, b: Column) -> Column:
        joined = F.when(s["open"] == "", b).otherwise(F.concat(s["open"], F.lit("\n\n"), b))
        full = F.size(T.words(joined)) >= least
        return F.struct(F.when(full, F.concat(s["done"], F.array(joined))).otherwise(s["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    def end(s: Column) -> Column:
        n = F.size(s["done"])
        last = F.concat(F.element_at(s["done"], -1), F.lit("\n\n"), s["open"])
        return F.when(s["open"] == "", s["done"]).when(n == 0, F.array(s["open"])).otherwise(F.concat(F.slice(s["done"], F.lit(1), n - 1), F.array(last)))

    return F.aggregate(blocks, start, step, end)


def paragraph_sections(text: Column, least: int = 40) -> Column:
    """The sections of a text without markers."""
    blocks = F.filter(F.transform(F.split(text, "\n{2,}"), T.strip), lambda b: b != "")
    merged = merged_blocks(blocks, least)
    return F.when(F.size(merged) > 0, merged).otherwise(F.array(T.strip(text)))


def page_sections(pages: DataFrame, book: str = "book_id", page: str = "page_no", text_col: str = "text", least_words: int = 5) -> DataFrame:
    """Pages of some words to sections: at pages whose first line is a chapter's, if two pages hold one; else merged to 40 words."""
    rows = pages.where(F.size(T.words(F.col(text_col))) >= least_words).select(book, page, T.strip(F.col(text_col)).alias("text"))
    w = W.partitionBy(book)
    rows = rows.withColumn("marked", F.sum(F.exists(F.split("text", "\n"), lambda x: x.rlike(L.PDF_CHAPTER)).cast("int")).over(w) >= 2)
    opens = F.split("text", "\n")[0].rlike(L.PDF_CHAPTER)
    order = W.partitionBy(book).orderBy(page)
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("opens", opens)
    rows = rows.withColumn("island", F.sum(F.when(F.col("opens") & (F.col("n") > 1), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    chapters = rows.where("marked").groupBy(book, "island").agg(F.expr(f"listagg(text, '\n\n') WITHIN GROUP (ORDER BY {page})").alias("text"))
    chapters = chapters.select(book, (F.row_number().over(W.partitionBy(book).orderBy("island")) - 1).alias("section_idx"), "text")
    merged = rows.where("not marked").groupBy(book).agg(F.array_sort(F.collect_list(F.struct(page, "text"))).alias("p"))
    merged = merged.select(book, F.posexplode(merged_blocks(F.col("p.text"))).alias("section_idx", "text"))
    return chapters.unionByName(merged)

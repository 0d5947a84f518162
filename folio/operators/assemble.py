"""Output texts, alignment of a draft to reference lengths, and evaluation of detected names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.functions import text as T
from folio.operators import similar
from folio.session import kept


def chosen_text(translated: Column, status: Column, original: Column) -> Column:
    return F.when(F.length(translated) > 0, translated).when(status == "flagged", F.concat(F.lit(L.REVIEW_MARKER), original)).otherwise(original)


def reassembled(chunks: DataFrame, book: str, order: str, section: str, text: Column) -> DataFrame:
    """(book, text): chunks joined by a blank line, sections by two more."""
    w = W.partitionBy(book).orderBy(order)
    jump = F.col(section) != F.lag(section).over(w)
    part = F.concat(F.when(F.coalesce(jump, F.lit(False)), F.lit("\n\n\n\n")).otherwise(F.lit("")), text)
    rows = chunks.select(book, order, part.alias("part"))
    return rows.groupBy(book).agg(F.expr(f"listagg(part, '\n\n') WITHIN GROUP (ORDER BY {order})").alias("text"))


def write_books(books: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """One file for each book, in a folder of the output's name. A book without chunks is refused."""
    if not books.take(1):
        raise ValueError("there is no chunk to write")
    books.select(name, F.col(text).alias("value")).write.partitionBy(name).mode("overwrite").text(folder)


def targets(rows: DataFrame, book: str, order: str, length: Column, total_chars: Column) -> DataFrame:
    """Where each reference chunk would end in a draft of total_chars: its share so far, rounded half to even."""
    size = F.greatest(length, F.lit(1))
    w = W.partitionBy(book)
    upto = F.sum(size).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("target", F.bround(upto / F.sum(size).over(w) * total_chars).cast("int"))


def _is_break(chars: Column, i: Column) -> Column:
    """Whether a text breaks naturally at an offset: behind a line feed, or before white space behind a sign of punctuation."""
    before, behind = F.get(chars, i - 1), F.get(chars, i)
    return (before == "\n") | (before.isin(*".?!;:") & behind.rlike(r"\s"))


def snapped(chars: Column, targets_: Column, n: Column, window: int = 120) -> Column:
    """Cuts near the targets, a zero before them: the nearest break within the window, the left of two, always behind the cut before.

    Only offsets in the window are looked at, so the work grows with the targets and not with the text.
    """

    def step(cuts: Column, target: Column) -> Column:
        def cut(s: Column) -> Column:
            low, high = s["start"] + 1, n - 1
            t = F.greatest(low, F.least(target, high))
            return T.bound(t, lambda t: F.when((s["start"] >= n) | (low > high), n).otherwise(F.coalesce(nearest(t, F.greatest(low, t - window), F.least(high, t + window)), t)))

        def nearest(t: Column, low: Column, high: Column) -> Column:
            near = F.filter(F.sequence(low, high), lambda i: _is_break(chars, i))
            return F.array_min(F.transform(near, lambda i: F.struct(F.abs(i - t).alias("far"), i.alias("at"))))["at"]

        return F.concat(cuts, F.array(T.bound(F.struct(F.element_at(cuts, -1).alias("start")), cut).cast("int")))

    return F.aggregate(targets_, F.array(F.lit(0)), step)


def aligned(text: Column, lengths: Column) -> Column:
    """A draft's pieces, as many as lengths, cut in proportion to them."""
    sums = F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.greatest(x, F.lit(1)))))
    given = F.struct(F.split(text, "").alias("chars"), sums.alias("sums"), F.length(text).alias("n"))

    def cut(g: Column) -> Column:
        inner = F.slice(g["sums"], F.lit(2), F.greatest(F.size(g["sums"]) - 2, F.lit(0)))
        goal = F.transform(inner, lambda u: F.bround(u / F.element_at(g["sums"], -1) * g["n"]).cast("int"))
        cuts = F.concat(snapped(g["chars"], goal, g["n"]), F.array(g["n"]))
        return T.bound(cuts, lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda start, k: T.strip(F.substring(text, start + 1, F.get(c, k + 1) - start))))

    return F.when((F.length(text) == 0) | (F.size(lengths) == 0), F.transform(lengths, lambda x: F.lit(""))).otherwise(T.bound(given, cut))


def page_words(text: Column, counts: Column, window: int = 20) -> Column:
    """A text's words dealt to pages in proportion to their word counts, cut at sentence ends within the window, the later first. Null is an empty text."""
    given = F.struct(T.words(F.coalesce(text, F.lit(""))).alias("w"), counts.alias("counts"))
    # bound as a lambda's variable, so that the text is split once; only words in the window are looked at
    return F.transform(F.array(given), lambda g: _pages(g["w"], g["counts"], window))[0]


def _pages(w: Column, counts: Column, window: int) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0), lambda a, x: a + x), F.lit(1))
    n = F.size(w)
    ends = lambda i: F.regexp_replace(F.get(w, i - 1), "[\"'»)]+$", "").rlike("[.!?]$")

    def first_end(low: Column, high: Column, step: int) -> Column:
        """The first place behind a sentence's end, from low to high or back from high to low."""
        places = F.when(low <= high, F.sequence(low, high) if step > 0 else F.sequence(high, low, F.lit(-1)))
        return F.get(F.filter(places, ends), F.lit(0))

    def step(cuts: Column, c: Column) -> Column:
        t = F.least(F.element_at(cuts, -1) + F.bround(c / total * n).cast("int"), n)
        near = F.transform(F.array(t), lambda t: F.coalesce(first_end(F.greatest(t, F.lit(1)), F.least(n, t + window) - 1, 1), first_end(F.greatest(F.lit(0), t - window) + 1, t, -1), t))
        return F.concat(cuts, near)

    cuts = F.concat(F.aggregate(F.slice(counts, F.lit(1), F.size(counts) - 1), F.array(F.lit(0)), step), F.array(n))
    dealt = lambda cuts: F.transform(counts, lambda x, k: F.array_join(F.slice(w, F.get(cuts, k) + 1, F.greatest(F.get(cuts, k + 1) - F.get(cuts, k), F.lit(0))), " "))
    return F.when(n == 0, F.transform(counts, lambda x: F.lit(""))).otherwise(F.transform(F.array(cuts), dealt)[0])


def paged(pages: DataFrame, translations: DataFrame, book: str, order: str, text: str = "text") -> DataFrame:
    """(book, page, original, translation): the k-th page with the k-th translation; what has no partner goes."""
    w = W.partitionBy(book).orderBy(order)
    numbered = lambda df, name: df.select(book, F.row_number().over(w).alias("page"), F.col(text).alias(name))
    return numbered(pages, "original").join(numbered(translations, "translation"), [book, "page"])


def prompt_sizes(prompts: DataFrame, books: DataFrame, book: str, prompt: str = "prompt") -> DataFrame:
    """(book, avg_chars, max_chars) of each book's prompts, 0 for a book without."""
    sizes = prompts.groupBy(book).agg(F.avg(F.length(prompt)).alias("a"), F.max(F.length(prompt)).alias("m"))
    return books.join(sizes, book, "left").select(book, F.coalesce("a", F.lit(0.0)).alias("avg_chars"), F.coalesce("m", F.lit(0)).alias("max_chars"))


def exact_metrics(gold: Column, pred: Column) -> list[Column]:
    tp = F.size(F.array_intersect(gold, pred))
    part = lambda n: F.when(n == 0, 0.0).otherwise(tp / n)
    p, r = part(F.size(pred)), part(F.size(gold))
    return [tp.alias("tp"), F.size(pred).alias("pred"), F.size(gold).alias("gold"), p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1")]


def fuzzy_hits(sets: DataFrame, group: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """name_hits of sets: (group, gold, pred), both arrays of names."""
    names = lambda c: sets.select(group, F.explode(F.array_distinct(c)).alias("name")).where("name IS NOT NULL")
    return name_hits(sets.select(group), names(gold), names(pred), group)


def name_hits(groups: DataFrame, golds: DataFrame, preds: DataFrame, group: str) -> DataFrame:
    """(group, tp): predicted names, in order, that find a best gold name not taken yet of similarity 0.84 or more.

    golds, preds: (group, name), each once. Similar spellings are found once for all groups that have both.
    """
    told = lambda df: df.select(F.col(group).alias("_group")).distinct()
    same = F.col(group).eqNullSafe(F.col("_group"))  # a null group is one too
    names = lambda df, other, c: df.join(told(other), same, "left_semi").select(group, F.col("name").alias(c), F.lower("name").alias("low"))
    p, g = names(preds, golds, "pred"), names(golds, preds, "gold")
    pairs = kept(similar.similar_pairs(p.select(F.col("low").alias("a")), g.select(F.col("low").alias("b"))))
    of = g.withColumnsRenamed({group: "_group", "low": "b"})
    edges = p.withColumnRenamed("low", "a").join(pairs, "a").join(of, same & (pairs["b"] == of["b"])).select(group, "pred", "gold", "score")
    empty = p.where("low = ''").join(of.where("b = ''"), same).select(group, "pred", "gold", F.lit(1.0).alias("score"))
    hits = similar.one_to_one(edges.unionByName(empty), group, kept).groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("tp"))
    return groups.join(hits, same, "left").select(group, F.coalesce("tp", F.lit(0)).cast("int").alias("tp"))


def fix_chunks(source_chunks: DataFrame, drafts: DataFrame) -> DataFrame:
    """Source chunks (book_id, book_index, original, ...) with drafts (book_id, sections): each draft cut in proportion to its source's chunks. original becomes the draft's piece, source the reference."""
    size = F.struct("book_index", F.length("original").alias("n"))
    whole = source_chunks.groupBy("book_id").agg(F.array_sort(F.collect_list(size)).alias("s"))
    draft = F.array_join(F.coalesce("sections", F.array().cast("array<string>")), "\n\n")
    pieces = whole.join(drafts, "book_id").select("book_id", F.col("s.book_index").alias("at"), aligned(draft, F.col("s.n")).alias("p"))
    pieces = pieces.select("book_id", F.explode(F.arrays_zip("at", "p")).alias("x")).select("book_id", F.col("x.at").alias("book_index"), F.col("x.p").alias("draft"))
    return source_chunks.join(pieces, ["book_id", "book_index"]).withColumn("source", F.col("original")).withColumn("original", F.col("draft")).drop("draft")

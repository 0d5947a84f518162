"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Targets: sources share the total size by weight; a target stops at ``most`` times
its source's size and what it can't take is shared again by weight. With L the
common level, each target is ``min(most * size, L * weight)``; L follows from
prefix sums over the sources in the order of ``size / weight``.

Documents: the whole epochs of a target come first, each taking every document
once. The rest is a weighted sample without replacement: each document has an
exponential key ``-ln(u) / quality`` with u from a hash of id and text, documents
go in the order of their keys, and those whose running size stays within the rest
are taken. To keep a hot source out of one task the order is cut in two: sizes
are summed by (source, slice of the key's range) and prefix-summed over slices;
only documents of the one slice where the rest runs out are sorted. The document
over which it runs out is taken if the sum comes nearer to the rest that way.

quality is the share of a document's words and signs that are words.

Defined results: null text has size 0 and is never taken; a null source is a
source of its own, the last; sources without a word have target 0; rows with
equal id and text have equal keys and go together in an order without meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import WORD, written

#: Slices of the range of keys, by quantiles of the exponential distribution.
SLICES = 4096


def quality(text: Column) -> Column:
    """Words as a share of words and signs of mark-up, 0 to 1."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))
    signs = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
    return F.when(words > 0, words / (words + signs)).otherwise(F.lit(0.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes: (source, size), a row per source. Adds target. Sources are few; they are ordered in one task."""
    at = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(at) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    s = sizes.withColumn("weight", weight)
    # sources in the order in which they stop: those before have all they can take
    order = W.orderBy(F.col("size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("size").over(W.partitionBy()) - most * F.coalesce(F.sum("size").over(before), F.lit(0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("stops", most * F.col("size") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("size") / F.col("weight"), "level"))).over(W.partitionBy())["level"]
    return s.select("source", "size", F.when(F.col("stops"), (most * F.col("size")).cast("double")).otherwise(final * F.col("weight")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per input row: id, text_key, size, source, source_size, target, copies (times taken), taken (copies * size)."""
    text = F.col(text_col)
    docs = df.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"), quality(text).alias("quality"), F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.coalesce(text, F.lit("")))).alias("h"),
    )
    u = (F.conv(F.substring("h", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    docs = docs.withColumn("key", F.when(F.col("quality") > 0, -F.log(u) / F.col("quality")))
    part = F.least(F.floor((1 - F.exp(-F.col("key"))) * SLICES), F.lit(SLICES - 1)).cast("int")
    docs = written(docs.select("_id", "_key", "source", "size", "key", "h", F.coalesce(part, F.lit(SLICES)).alias("slice")), "keys")
    slices = docs.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sizes = slices.groupBy("source").agg(F.sum("slice_size").alias("size"))
    plan = targets(sizes, weights, most).select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = F.sum("slice_size").over(W.partitionBy("source").orderBy("slice"))
    slices = slices.withColumn("up_to", running).join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    slices = slices.withColumn("last", (F.col("up_to") > F.col("rest")) & (F.col("up_to") - F.col("slice_size") <= F.col("rest")) & (F.col("slice") < SLICES))
    slices = written(slices.select(F.col("source").alias("s"), F.col("slice").alias("p"), "source_size", "target", "epochs", "rest", (F.col("up_to") - F.col("slice_size")).alias("under"), "up_to", "last"), "slices")
    docs = docs.join(slices, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("p")))
    docs = docs.withColumn("inside", (F.col("up_to") <= F.col("rest")) & (F.col("slice") < SLICES))
    edge = docs.where("last").withColumn("run", F.col("under") + F.sum("size").over(W.partitionBy("s", "p").orderBy("key", "h").rowsBetween(W.unboundedPreceding, 0)))
    # the document over which the rest runs out is taken if that comes nearer to it
    edge = edge.withColumn("inside", 2 * F.col("run") - F.col("size") <= 2 * F.col("rest")).drop("run")
    out = docs.where("not last").unionByName(edge)
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("inside").cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select(F.col("_id").alias(id_col), F.col("_key").alias("text_key"), "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

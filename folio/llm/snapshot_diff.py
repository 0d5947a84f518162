"""Difference of two snapshots of a table whose keys may have been given anew.

Only names of values travel: a row is its key, a SHA-256 of each compared column
(null stays null) and the digest of the row. First rows meet by key: both
snapshots are dealt to buckets by a hash of the key, and each pair of buckets is a
pandas merge. What found no partner meets again by its content, the first compared
column: buckets by a hash of the content, sorted by key (the direction of each side
is a parameter), numbered by ``cumcount`` and merged on content and number.

A bucket holds a bounded number of rows, whatever repeats: groups of one key or one
content with more than ``slice_rows`` rows are ranked over all partitions (a sort by
range, with counts before each range) and cut into slices of so many ranks, and
each slice is dealt like a group of its own. The i-th of a slice meets the i-th of
the same slice, so pairs are the same as without slices.

Defined results: null keys equal null keys and null contents null contents; rows
that share a key are paired one to one, in the order of their values' SHA-256
(nulls first), and what is left over by content; equal rows are interchangeable;
other columns are not looked at, whatever their names. Empty tables give inserts
or deletes only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import forget, written


def _named(df: DataFrame, key: str, columns: list[str], side: int) -> DataFrame:
    """side, key (never null) and whether it was null, the compared columns' hashes c0, c1, ..., and the row's digest."""
    hashes = [F.unhex(F.sha2(F.col(c).cast("string").cast("binary"), 256)).alias(f"c{k}") for k, c in enumerate(columns)]
    row = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]).cast("binary"), 256)
    kind = df.schema[key].dataType
    given = F.col(key) if isinstance(kind, (T.LongType, T.StringType)) else F.col(key).cast("long" if isinstance(kind, T.IntegralType) else "string")
    nothing = F.lit("" if isinstance(kind, T.StringType) or not isinstance(kind, T.IntegralType) else 0)
    return df.select(F.lit(side).alias("side"), F.coalesce(given, nothing).alias("key"), F.col(key).isNull().alias("no_key"), *hashes, F.unhex(row).alias("digest"))


def _group(*columns: str) -> Column:
    """A group's number: 64 bits of its values, with nulls as values; groups that share it share buckets, and pandas tells them apart."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string").cast("binary"), F.lit(b"")) for c in columns], *[F.col(c).isNull() for c in columns])


def _sliced(rows: DataFrame, order: list[Column], most: int, tables: list[DataFrame]) -> DataFrame:
    """slice: the rank of each row in its (side, group), in units of ``most``. No group is sorted in one task."""
    parts = max(2, -(-rows.count() // most))
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "side", "group", *order, "row").withColumn("part", F.spark_partition_id())
    ranged = _kept(ranged, tables)
    sizes = ranged.groupBy("side", "group", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("side", "group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per range
    rank = F.row_number().over(W.partitionBy("side", "group", "part").orderBy(*order, "row")) - 1
    out = ranged.withColumn("rank", rank).join(sizes.select("side", "group", "part", before.alias("before")).hint("merge"), ["side", "group", "part"])
    return out.withColumn("slice", F.floor((F.col("rank") + F.col("before")) / most).cast("long")).drop("part", "rank", "before", "row")


def _kept(df: DataFrame, tables: list[DataFrame]) -> DataFrame:
    tables.append(written(df, "snapshot-diff"))
    return tables[-1]


def _dealt(rows: DataFrame, group: Column, order: list[Column], most: int, tables: list[DataFrame]) -> DataFrame:
    """rows with group and slice; a group of one side and slice has at most ``most`` rows."""
    rows = rows.withColumn("group", group)
    large = _kept(rows.groupBy("side", "group").count().where(F.col("count") > most).select("group").distinct(), tables)
    if large.isEmpty():
        return rows.withColumn("slice", F.lit(0).cast("long"))
    # one join deals rows by group; a large one is split by the adaptive skew join, which needs none of its rows together
    told = _kept(rows.join(large.withColumn("large", F.lit(True)).hint("merge"), "group", "left"), tables)
    hot = _sliced(told.where("large").drop("large"), order, most, tables)
    return told.where("large is null").drop("large").withColumn("slice", F.lit(0).cast("long")).unionByName(hot)


def _merger(by: list[str], order: list[str], ascending: tuple[bool, bool], columns: list[str]):
    """Rows of the two sides of a bucket, paired by the columns ``by``, the slice and their number within them."""

    def numbered(rows: pd.DataFrame, up: bool) -> pd.DataFrame:
        rows = rows.set_axis([c[:-2] for c in rows.columns], axis=1)
        if len(rows):
            rows = rows.sort_values(order, ascending=up, na_position="first" if up else "last", kind="stable")
        rows = rows.astype({c: object for c in columns})  # so that numbers stay whole beside what is missing
        return rows.assign(i=rows.groupby([*by, "slice"], dropna=False, sort=False).cumcount())

    def merge(earlier: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
        out = numbered(earlier, ascending[0]).merge(numbered(later, ascending[1]), on=[*by, "slice", "i"], how="outer", suffixes=("_e", "_l"), indicator=True)
        found = {"in_e": out["_merge"] != "right_only", "in_l": out["_merge"] != "left_only"}
        for c in columns:
            for s in "el":
                value = out[c if c in by else f"{c}_{s}"].astype(object)
                found[f"{c}_{s}"] = value.where(found[f"in_{s}"] & value.notna(), None)
        return pd.DataFrame(found)

    return merge


def _paired(rows: DataFrame, by: list[str], order: list[str], ascending: tuple[bool, bool], columns: list[str], n: int) -> DataFrame:
    """Cogroups the two sides by bucket."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "in_e boolean, in_l boolean, " + ", ".join(f"{c}_{s} {kinds[c]}" for c in columns for s in "el")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("group", "slice"), F.lit(n)).cast("int")).drop("group")
    # a cogroup of one table with itself takes equal names for one column
    side = lambda k: rows.where(F.col("side") == k).select(*[F.col(c).alias(f"{c}_{k}") for c in rows.columns if c != "side"]).groupBy(f"bucket_{k}")
    return side(0).cogroup(side(1)).applyInPandas(_merger(by, order, ascending, columns), schema)


def snapshot_diff(earlier: DataFrame, later: DataFrame, key: str, columns: list[str], descending: bool = False, bucket_rows: int = 5_000, slice_rows: int = 100) -> DataFrame:
    """(key, old_key, op, changed, row_sha256) for each pair of rows and each row without a partner.

    ``op``: same or update (equal keys), rekey (equal ``columns[0]``), insert, delete. ``changed``: a pair's differing
    columns, comma-joined. ``row_sha256``: of the later row's columns, joined by a line feed, null as ``~``.
    ``descending``: later rows of one content are numbered from the largest key on, for keys that were turned round.
    """
    tables: list[DataFrame] = []
    cs = [f"c{k}" for k in range(len(columns))]
    carried = ["key", "no_key", *cs, "digest"]
    key_type = earlier.schema[key].dataType.simpleString()
    both = _kept(_named(earlier, key, columns, 0).unionByName(_named(later, key, columns, 1)), tables)
    # several buckets for each shuffle partition, which get their buckets by chance
    n = max(4 * int(earlier.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // bucket_rows))

    rows = _dealt(both, _group("key", "no_key"), [F.col(c) for c in cs], slice_rows, tables)
    met = _kept(_paired(rows, ["key", "no_key"], cs, (True, True), carried, n), tables)
    left = lambda s, other, k: met.where(~F.col(f"in_{other}")).select(F.lit(k).alias("side"), *[F.col(f"{c}_{s}").alias(c) for c in carried])

    # by content: null keys first, then by key, or the other way round
    up = [F.col("no_key").desc(), F.col("key").asc(), *[F.col(c).asc() for c in cs[1:]]]
    down = [F.col("no_key").asc(), F.col("key").desc(), *[F.col(c).desc() for c in cs[1:]]]
    sides = [left("e", "l", 0), left("l", "e", 1)]
    if descending:
        rows = _dealt(sides[0], _group("c0"), up, slice_rows, tables).unionByName(_dealt(sides[1], _group("c0"), down, slice_rows, tables))
    else:
        rows = _dealt(sides[0].unionByName(sides[1]), _group("c0"), up, slice_rows, tables)
    rows = rows.withColumn("has_key", ~F.col("no_key"))
    again = _paired(rows, ["c0"], ["has_key", "key", *cs[1:]], (True, not descending), carried, n)

    pairs = met.where("in_e and in_l").withColumn("met", F.lit(True)).unionByName(again.withColumn("met", F.lit(False)))
    pair = F.col("in_e") & F.col("in_l")
    changed = F.concat_ws(",", *[F.when(pair & ~F.col(f"{c}_e").eqNullSafe(F.col(f"{c}_l")), F.lit(name)) for c, name in zip(cs, columns)])
    op = F.when(~F.col("in_e"), "insert").when(~F.col("in_l"), "delete").when(~F.col("met"), "rekey").when(changed == "", "same").otherwise("update")
    key_of = lambda s: F.when(F.col(f"in_{s}") & ~F.col(f"no_key_{s}"), F.col(f"key_{s}")).cast(key_type)
    out = pairs.select(
        F.when(F.col("in_l"), key_of("l")).otherwise(key_of("e")).alias("key"), key_of("e").alias("old_key"), op.alias("op"), changed.alias("changed"),
        F.when(F.col("in_l"), F.lower(F.hex("digest_l"))).alias("row_sha256"),
    )
    result = written(out, "snapshot-diff")
    forget(*tables)
    return result

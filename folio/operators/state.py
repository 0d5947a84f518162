"""State as append-only logs with latest-wins views: books, chunks, quota and memory versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class DuplicateBook(Exception):
    pass


def new_rows(rows: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows to append: those whose key is not there yet, one per key."""
    return rows.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def insert_books(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Books to append; an equal file hash is refused."""
    if rows.join(existing, "file_hash", "left_semi").take(1):
        raise DuplicateBook("a book with this file hash is there already")
    return rows


def latest(events: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("e")).select(*keys, "e.*")


def latest_set(events: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """Of each column the last value that an event has set: an event that leaves one null keeps the value before."""
    rest = [c for c in events.columns if c not in (*keys, order)]
    return events.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def pending(chunks: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a resumed run still has to do."""
    return chunks.join(done.select(*keys), list(keys), "left_anti")


def counts(chunks: DataFrame, *keys: str) -> DataFrame:
    n = F.count("*")
    done, flagged = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "flagged")
    return chunks.groupBy(*keys).agg(n.alias("total"), done.alias("done"), flagged.alias("flagged"), (n - done - flagged).alias("pending"))


def quota(events: DataFrame, model: str, day: str, tokens: str) -> DataFrame:
    return events.groupBy(model, day).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens_used"))


def versions(updates: DataFrame, book: str, order: str) -> DataFrame:
    return updates.withColumn("version", F.row_number().over(W.partitionBy(book).orderBy(order)))


def latest_version(rows: DataFrame, book: str, *values: str) -> DataFrame:
    return rows.groupBy(book).agg(F.max("version").alias("version"), *[F.max_by(v, "version").alias(v) for v in values])


def progress(current, total):
    """Whole per cent."""
    return F.floor(current * F.lit(100.0) / total).cast("int")

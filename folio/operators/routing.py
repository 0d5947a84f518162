"""Which model takes which call: priorities, daily limits, failover and the point where a run pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators import scan


def usable(calls: DataFrame, model: str, day: str, order: str, tokens: str, limit) -> DataFrame:
    """A call goes through if what its model has used that day before it is under the limit; it may overshoot. A day of calls of one model is summed in slices."""
    before = scan.sum_before(calls, [model, day], order, F.col(tokens), "used_before")
    return before.withColumn("usable", F.col("used_before") < limit)


def plan(chunks: DataFrame, models: list[tuple[str, int, int]], book: str, order: str, tokens: str) -> DataFrame:
    """models: (name, priority, limit). Each book's calls go in order to the first model that is not used up; null when all are.

    A model is used up by the calls that it has taken, so the k-th model starts where the first k - 1 have ended: with limits
    that may be overshot by one call each, that is one prefix sum for each model.
    """
    rows = chunks.withColumn("model", F.lit(None).cast("string"))
    for name, _, limit in sorted(models, key=lambda m: m[1]):
        open_ = F.col("model").isNull()
        before = F.coalesce(F.sum(F.when(open_, F.col(tokens))).over(W.partitionBy(book).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("model", F.when(open_ & (before < limit), name).otherwise(F.col("model")))
    return rows


def pause_points(planned: DataFrame, book: str, order: str) -> DataFrame:
    """Rows before the first call without a model: a run stops there."""
    stop = F.min(F.when(F.col("model").isNull(), F.col(order))).over(W.partitionBy(book))
    return planned.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col(order) < F.col("stop"))).drop("stop")


def gate(chunks: DataFrame, book: str, order: str, speaks, forced, every: int, succeeds=None) -> DataFrame:
    """Whether to extract: the first chunk, a forced one, one whose notes speak of news, or each ``every``-th quiet one in a row.

    ``succeeds``: whether an extraction at this chunk, if there is one, goes well (default: always). Only then is the
    count of quiet chunks begun anew; after a failure the next quiet chunk is tried at once. The count never matters
    beyond ``every``, so a chunk is a table of transitions over ``every`` states, and tables compose.
    """
    ok = F.lit(True) if succeeds is None else succeeds
    loud = (F.col(order) == 0) | forced | speaks
    rows = chunks.withColumns({"loud": F.coalesce(loud, F.lit(False)), "ok": F.coalesce(ok, F.lit(False))})
    full = every - 1  # the next quiet chunk is one to extract at
    after_loud = lambda s: F.when(F.col("ok"), 0).otherwise(s)
    after_quiet = lambda s: F.when(s < full, s + 1).when(F.col("ok"), 0).otherwise(full)
    step = F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: F.when(F.col("loud"), after_loud(s)).otherwise(after_quiet(s)))
    rows = scan.states_before(rows, [book], order, step, every, "quiet")
    return rows.withColumn("extract", F.col("loud") | (F.col("quiet") == full)).drop("loud", "ok", "quiet")


def adapters(configs: DataFrame, makers: list[str]) -> DataFrame:
    """Settings (name, priority, api_key, seq) of models that there is an adapter for and that have a key, in order of priority."""
    known = F.broadcast(configs.sparkSession.createDataFrame([(m,) for m in makers], "name string"))  # as many as adapters
    rows = configs.join(known, "name").where(F.coalesce("api_key", F.lit("")) != "")
    return rows.withColumn("place", F.row_number().over(W.orderBy("priority", "seq")))  # a row per model


def available(models: DataFrame, events: DataFrame, now, cooldown: int = 300) -> DataFrame:
    """models (name, daily_token_limit) with available: not failed within the cooldown, and under the day's limit. events: (name, ts, tokens, failed)."""
    today = F.when(F.to_date("ts") == F.to_date(now), F.col("tokens"))
    state = events.groupBy("name").agg(F.sum(today).alias("used"), F.max(F.when(F.col("failed"), F.col("ts"))).alias("at"))
    cool = F.col("at").isNull() | (now >= F.col("at") + F.make_dt_interval(secs=F.lit(cooldown)))
    return models.join(state, "name", "left").withColumn("available", (F.coalesce("used", F.lit(0)) < F.col("daily_token_limit")) & cool).drop("at")

"""Task-log metrics, comparisons, and A/B analysis. All are one hash aggregation on the grouping key."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgrid.sources.shared import checkpointed


def trailing(log: DataFrame, as_of: str, days: int, ts: str = "ts") -> DataFrame:
    """Rows no older than so many days before as_of. The bound is a literal, so that it reaches the scan."""
    from datetime import timedelta

    since = datetime.fromisoformat(as_of) - timedelta(days=days)
    return log.filter(F.col(ts) >= F.lit(since.isoformat(sep=" ")).cast(log.schema[ts].dataType))


def share(part: Column, whole: Column) -> Column:
    """Percentage as DOUBLE, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double") * 100)


def task_metrics(log: DataFrame, *keys: str, ok: str = "success", time: str = "response_time", quality: str = "quality_score", satisfaction: str | None = None) -> DataFrame:
    """Counts, rates and means by key; means ignore nulls of their own measure alone."""
    n, good = F.count(F.lit(1)), F.count_if(F.col(ok))
    out = [n.alias("total_tasks"), good.alias("successful_tasks"), (n - good).alias("failed_tasks"), share(good, n).alias("success_rate"), share(good, n).alias("completion_rate"), share(n - good, n).alias("error_rate")]
    means = {"average_response_time": time, "average_quality": quality} | ({"average_satisfaction": satisfaction} if satisfaction else {})
    out += [F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6).alias(k) for k, c in means.items()]
    return log.groupBy(*keys).agg(*out)


def with_absent(known: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """All known keys; zeros for those without rows."""
    out = known.select(key).distinct().join(metrics, key, "left")
    return out.select(key, *(F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name) for f in metrics.schema if f.name != key))


def change(value: Column, base: Column, less_is_better: bool = False) -> Column:
    """Per cent of change against a positive baseline; null where it isn't positive."""
    return F.when(base > 0, ((base - value) if less_is_better else (value - base)) / base * 100)


def assign(tasks: DataFrame, order: str, k: int) -> DataFrame:
    """Round-robin: the variation is the number of earlier assignments modulo k.

    The numbers come from ranges: rows are sorted by range partition, partitions counted, and each adds its offset, so no single task sees all rows.
    The places are written down first: ranges are found by sampling, and a second reading could draw them elsewhere.
    """
    if tasks.select(order).schema[0].dataType.typeName() not in ("long", "integer"):
        raise ValueError("the order must be an integer")
    ranged = tasks.repartitionByRange(order).sortWithinPartitions(order)
    numbered = ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - (F.spark_partition_id().cast("long") * (1 << 33)))
    return number(checkpointed(numbered)).withColumn("variation", (F.col("__n") % k).cast("long")).drop("__n")


def number(numbered: DataFrame) -> DataFrame:
    counts = numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    return numbered.join(F.broadcast(before), "__p").withColumn("__n", F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")  # a row a partition


def score(success: Column, quality: Column, satisfaction: Column, error: Column) -> Column:
    return 0.4 * success + 0.3 * quality + 0.2 * satisfaction + 0.1 * (100 - error)


def winner(by_variation: DataFrame, least: int = 30) -> DataFrame:
    """The best variation of enough tasks (the earlier in a tie), its lift over variation 0 and its confidence."""
    base = by_variation.filter((F.col("variation") == 0) & (F.col("total_tasks") >= least)).agg(F.max("score").alias("base"))
    best = by_variation.filter(F.col("total_tasks") >= least).orderBy(F.desc("score"), "variation").limit(1)
    lift = F.when(F.col("base") > 0, (F.col("score") - F.col("base")) / F.col("base") * 100).otherwise(F.lit(0.0))
    return best.crossJoin(base).select("variation", "total_tasks", F.round("score", 6).alias("score"), F.round(lift, 6).alias("lift"), F.round(F.least(F.lit(95.0), F.col("total_tasks") * 0.95), 6).alias("confidence"))


def ema(log: DataFrame, key: str, order: str, ok: str, alpha: float = 0.1, start: float = 1.0) -> DataFrame:
    """Exponential mean of successes in order, in closed form: a row's weight depends on its place from the end alone."""
    w = W.partitionBy(key)
    back = F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy(order))
    placed = log.select(key, (F.lit(alpha) * F.pow(F.lit(1 - alpha), back.cast("double")) * F.col(ok).cast("double")).alias("term"))
    return placed.groupBy(key).agg(F.round(F.sum("term") + F.lit(start) * F.pow(F.lit(1 - alpha), F.count(F.lit(1)).cast("double")), 6).alias("ema"))


def failure_streak(log: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """Failures since the last success, by one aggregation and a join on its maximum."""
    last = log.groupBy(key).agg(F.max(F.when(F.col(ok), F.col(order))).alias("__last"))
    return log.join(last, key).groupBy(key).agg(F.count_if(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).alias("streak"))

"""Health roll-ups over check results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = {"healthy": 0, "unknown": 1, "degraded": 2, "unhealthy": 3}


def manager_health(checks: DataFrame, manager: str = "manager") -> DataFrame:
    """unhealthy if a critical check fails, degraded if any does, else healthy; a check without a result passes for is_healthy alone."""
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    status = F.when(F.bool_or(failed & F.col("critical")), "unhealthy").when(F.bool_or(~F.coalesce(F.col("ok"), F.lit(False))), "degraded").otherwise("healthy")
    return checks.groupBy(manager).agg(status.alias("status"), F.bool_and(F.coalesce("ok", F.lit(True))).alias("is_healthy"))


def system_health(managers: DataFrame) -> DataFrame:
    worst = F.max(F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0))
    return managers.agg(F.when(worst == 2, "unhealthy").when(worst == 1, "degraded").otherwise("healthy").alias("status"), F.count(F.lit(1)).alias("managers"))

"""The retry state of links, as a fold of their attempts in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import backoff_seconds

# Counted attempts until a link is given up, and the wait after a refusal at the gate.
MAX_ATTEMPTS = 168
GATE_SECONDS = 3600


def link_states(attempts: DataFrame, key: str, order: list[str], outcome: str = "outcome", at: str = "attempt_at", most: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, status, attempts, next_retry_at) after ``attempts`` of outcome valid, invalid, transient or gate.

    The first valid or invalid one, or the ``most``-th transient one, settles a link; what comes after does not count. Refusals at the
    gate wait an hour and are not counted.
    """
    ordered = Window.partitionBy(key).orderBy(at, *order)
    counted = attempts.withColumns({
        "_n": F.sum(F.when(F.col(outcome) == "transient", 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        "_place": F.row_number().over(ordered),
    })
    settles = F.col(outcome).isin("valid", "invalid") | ((F.col(outcome) == "transient") & (F.col("_n") >= most))
    state = F.struct(F.col(outcome).alias("outcome"), F.col("_n").alias("n"), F.col(at).alias("at"))
    folded = counted.groupBy(key).agg(F.min_by(state, F.when(settles, F.col("_place"))).alias("_settled"), F.max_by(state, "_place").alias("_last"))
    last = F.coalesce("_settled", "_last")
    wait = F.when(last["outcome"] == "gate", F.lit(GATE_SECONDS)).otherwise(backoff_seconds(last["n"]))
    status = F.when(F.col("_settled").isNull(), "pending_validation").when(last["outcome"] == "valid", "validated").when(last["outcome"] == "invalid", "invalid").otherwise("error")
    return folded.select(
        key, status.alias("status"), last["n"].cast("long").alias("attempts"),
        F.when(F.col("_settled").isNull(), last["at"] + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)).alias("next_retry_at"),
    )

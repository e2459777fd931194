"""What a treatment saves against a baseline, task by task and net of its fixed cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(evals: DataFrame, value: str = "tokens", correct: str = "correct") -> DataFrame:
    """(track, task, baseline, treatment, reduction, wins) of runs (track, task, condition, value, correct).

    Repeats are averaged. A task wins only if it saves and is no less often right.
    """
    by = evals.groupBy("track", "task").agg(
        *[F.avg(F.when(F.col("condition") == c, F.col(value))).alias(c) for c in ("baseline", "treatment")],
        *[F.avg(F.when(F.col("condition") == c, F.col(correct).cast("double"))).alias(f"_{c}") for c in ("baseline", "treatment")],
    )
    both = by.where(F.col("baseline").isNotNull() & F.col("treatment").isNotNull())
    reduction = F.when(F.col("baseline") != 0, (F.col("baseline") - F.col("treatment")) / F.col("baseline"))
    wins = (F.col("treatment") < F.col("baseline")) & (F.col("_treatment") >= F.col("_baseline"))
    return both.select("track", "task", "baseline", "treatment", reduction.alias("reduction"), F.coalesce(wins, F.lit(False)).alias("wins"))


def net(pairs: DataFrame, overhead: DataFrame) -> DataFrame:
    """(track, saved, overhead, net): savings of all tasks less the track's fixed tokens, which are the
    sum of ``overhead(track, tokens)``."""
    fixed = overhead.groupBy("track").agg(F.sum("tokens").alias("overhead"))
    saved = pairs.groupBy("track").agg(F.sum(F.col("baseline") - F.col("treatment")).alias("saved"))
    joined = saved.join(fixed, "track", "left").withColumn("overhead", F.coalesce("overhead", F.lit(0)))
    return joined.select("track", "saved", "overhead", (F.col("saved") - F.col("overhead")).alias("net"))

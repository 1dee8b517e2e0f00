"""Whether the end of a reading has ground in the image. Steps are columns of their own, so that none is computed twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsafe.functions import traces


def floors(rows: DataFrame, window: int = 6) -> DataFrame:
    """rows (p, s) with p_floor and s_floor, from the medians of what goes before the last window."""
    n = F.size("p")
    stable = F.least(F.greatest(F.lit(8), n - F.least(F.lit(window), n)), n)
    out = rows.withColumns({"_p": F.array_sort(F.slice("p", F.lit(1), stable)), "_s": F.array_sort(F.slice("s", F.lit(1), stable))})
    floor = lambda a, cap, low, share: F.least(F.lit(cap), F.greatest(F.lit(low), share * traces.middle(F.col(a))))
    return out.withColumns({"p_floor": floor("_p", 0.72, 0.56, 0.68), "s_floor": floor("_s", 0.18, 0.10, 0.28)}).drop("_p", "_s")


def _stats(k: Column) -> Column:
    part = lambda name: traces.tail(F.col(name), k)
    return F.struct(traces.spread(part("c")).alias("range"), traces.mean(part("c")).alias("c"), traces.mean(part("p")).alias("p"), traces.mean(part("s")).alias("s"))


def decide(rows: DataFrame, window: int = 6, least: int = 3, prefix: int = 8) -> DataFrame:
    """rows (p, c, s, last_ink, near_loop) with reason and start: why the end of a reading has no ground in the image and
    the first place of that end; null where it has, and in traces shorter than prefix + least."""
    out = floors(rows, window)
    p_floor, s_floor = F.col("p_floor"), F.col("s_floor")
    out = out.withColumn("_run", traces.trailing_run(F.zip_with("p", "s", lambda x, y: (x < p_floor) & (y < s_floor))))
    out = out.withColumns({"_w": _stats(F.lit(window)), "_t": _stats(F.col("_run").cast("int"))})

    def still(k: str, slack_p: float, slack_s: float) -> Column:
        return (F.col(f"{k}.range") <= 0.035) & (F.col(f"{k}.p") <= p_floor + slack_p) & (F.col(f"{k}.s") <= s_floor + slack_s)

    def spent(k: str, slack_p: float) -> Column:
        return (F.col(f"{k}.c") >= F.col("last_ink") - 0.06) & (F.col(f"{k}.s") <= s_floor) & (F.col(f"{k}.p") <= p_floor + slack_p)

    run = F.col("_run") >= least
    out = out.withColumns({"_still": run & still("_t", 0.0, 0.0), "_spent": run & spent("_t", 0.0), "_loop": F.col("near_loop").isNotNull() & (still("_w", 0.05, 0.03) | spent("_w", 0.04))})
    loop = F.col("_loop") | (F.col("near_loop").isNotNull() & (F.col("_still") | F.col("_spent")))
    why = F.when(loop, F.lit("attention_near_loop")).when(F.col("_spent"), F.lit("visual_evidence_exhausted")).when(F.col("_still"), F.lit("attention_stall"))
    out = out.withColumn("reason", F.when(F.size("p") >= prefix + least, why))
    start = F.when(F.col("reason") == "attention_near_loop", F.col("near_loop")).when(F.col("reason").isNotNull(), F.size("p") - F.col("_run"))
    return out.withColumn("start", start.cast("long")).drop("_run", "_w", "_t", "_still", "_spent", "_loop")

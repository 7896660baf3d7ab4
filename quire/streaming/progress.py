"""Progress of long jobs: a monotone merge of events, over a batch by windows and over a stream by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Phases in their order.
PHASES = ("queued", "uploading", "extracting", "structuring", "ocr", "classifying", "ready")


def rank(phase: Column, phases=PHASES) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, phases)), phase), F.lit(0)).cast("int")


def merged(events: DataFrame, key: str, at: str, tie: str, phase: str, percent: str, phases=PHASES) -> DataFrame:
    """events with the phase and percent a reader sees after each: neither ever goes back."""
    upto = W.partitionBy(key).orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)
    top = F.max(rank(F.col(phase), phases)).over(upto)
    return events.select(key, tie, top.alias("phase_rank"), F.max(percent).over(upto).alias("percent"))


def merged_stream(events: DataFrame, phases=PHASES) -> DataFrame:
    """(key, phase, percent) of a stream (key, phase, percent): a state of one row a key, written after every batch of it.

    Late events of a lower phase change nothing, nor do null percents. A key
    keeps its row of state, as late events can come at any time.
    """
    import pandas as pd

    order = {p: i for i, p in enumerate(phases)}

    def step(key, batches, state):
        at, percent = state.get if state.exists else (-1, 0.0)
        for batch in batches:
            at = max([at, *(order.get(p, -1) for p in batch["phase"])])
            percent = max([percent, *batch["percent"].dropna()])
        state.update((at, percent))
        yield pd.DataFrame({"key": [key[0]], "phase": [phases[at] if at >= 0 else None], "percent": [percent]})

    return events.groupBy("key").applyInPandasWithState(step, "key string, phase string, percent double", "rank int, percent double", "update", "NoTimeout")


def counted(events: DataFrame, key: str = "key", at: str = "at", late: str = "classifying", during: str = "ocr", phases=PHASES) -> DataFrame:
    """events (key, at, phase, current, total) with what a reader sees after each: phase_rank and the counter (seen, of).

    A phase never goes back. A counter follows the events of the phase that is shown; besides these, one late phase still
    moves it while a certain other one is shown, as both go on side by side. seen never falls below what was seen in the
    phase that is shown, nor does of. Nulls move nothing.
    """
    order = W.partitionBy(key).orderBy(at, F.col("phase_rank_own").desc())
    own = rank(F.col("phase"), phases)
    rows = events.withColumn("phase_rank_own", own).withColumn("phase_rank", F.max("phase_rank_own").over(order.rowsBetween(W.unboundedPreceding, 0)))
    shown, slow = F.lit(phases.index(during) + 1), F.lit(phases.index(late) + 1)
    counts = (F.col("phase_rank_own") == F.col("phase_rank")) | ((F.col("phase_rank") == shown) & (F.col("phase_rank_own") == slow))
    within = W.partitionBy(key, "phase_rank").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    best = lambda c: F.max(F.when(counts, F.col(c))).over(within)
    return rows.withColumn("seen", best("current")).withColumn("of", best("total")).drop("phase_rank_own")


def admitted(jobs: DataFrame, slots: int = 1) -> DataFrame:
    """The jobs that run next: highest priority first, then the one that came first."""
    return jobs.orderBy(F.desc("priority"), "at", "job").limit(slots)


def hint(idle_s: Column, loading: Column) -> Column:
    """stale after 60 s without news, 180 s while loading; dead after five times that."""
    limit = F.when(loading, 180).otherwise(60)
    return F.when(idle_s > limit * 5, "dead").when(idle_s > limit, "stale")

"""Delivery with permanent holes: when a window can be scored although parts of its stretch never come, when it is beyond
hope and why, and the ordered release of what is left, with a horizon for windows that stay away.

A hole takes its rows from the instant of its declaration on, whether they had arrived or not; what was scored before
stays scored. Delivered rows therefore grow and shrink, so each window is a sweep of signed events: rows come alive with
their batch and die with the first hole that covers them. Events of one instant count in the order hole, arrival, batch.
All steps are keyed by batches or windows; a task holds the batches of one stretch, or one block of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.delivery import batch_of_row, batch_rows, stretch_batches

#: Causes in the order in which one is named where several holes of one instant settle a window.
CAUSES = ("lost", "scheduled", "recorder", "stream", "not_generated", "undelivered", "horizon")


def cause_rank(cause: Column) -> Column:
    out = F.lit(len(CAUSES))
    for k, name in enumerate(CAUSES):
        out = F.when(cause == name, k).otherwise(out)
    return out


def batch_parts(holes: DataFrame, batches: DataFrame, per_batch: int) -> DataFrame:
    """holes(row_start, row_end, declared_at[, cause]), widened already, batches(batch) -> batch, lo, hi, gone_at, cause: the
    rows of each batch in parts by the first hole that covers them; gone_at is null where none does."""
    cause = F.col("cause") if "cause" in holes.columns else F.lit("lost")
    each = holes.select("row_start", "row_end", "declared_at", cause.alias("cause")).withColumn("batch", F.explode(F.sequence(batch_of_row(F.greatest("row_start", F.lit(1)), per_batch), batch_of_row(F.col("row_end"), per_batch))))
    low, high = batch_rows(F.col("batch"), per_batch)
    first = F.struct("declared_at", cause_rank(F.col("cause")).alias("rank"), "cause")
    # Equal pieces of a batch become one, so that a batch has no more of them than its rows allow.
    pieces = each.select("batch", F.greatest("row_start", low).alias("a"), F.least("row_end", high).alias("b"), first.alias("h")).groupBy("batch", "a", "b").agg(F.min("h").alias("h"))
    whole = batches.select("batch").distinct().join(pieces.groupBy("batch").agg(F.collect_list(F.struct("a", "b", "h")).alias("p")), "batch", "left")
    none = F.array().cast(f"array<struct<a:bigint,b:bigint,h:{dict(pieces.dtypes)['h']}>>")
    whole = whole.select("batch", low.alias("f"), high.alias("l"), F.coalesce("p", none).alias("p"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("f", F.col("l") + 1), F.transform("p", lambda x: x["a"]), F.transform("p", lambda x: x["b"] + 1))))
    spans = whole.withColumn("c", cuts).select("batch", "p", "c", F.explode(F.sequence(F.lit(0), F.size("c") - 2)).alias("k"))
    spans = spans.select("batch", "p", F.get("c", F.col("k")).alias("lo"), (F.get("c", F.col("k") + 1) - 1).alias("hi"))
    over = F.array_min(F.transform(F.filter("p", lambda x: (x["a"] <= F.col("lo")) & (x["b"] >= F.col("hi"))), lambda x: x["h"]))
    return spans.select("batch", "lo", "hi", over.alias("h")).select("batch", "lo", "hi", F.col("h.declared_at").alias("gone_at"), F.col("h.cause").alias("cause"))


def deliveries(windows: DataFrame, arrivals: DataFrame, holes: DataFrame, size: int, step: int, context: int, rows: int, per_batch: int) -> DataFrame:
    """The parts of each window's stretch: window, batch, lo, hi, arrived_at, gone_at, cause, w and o (rows of the stretch and of the
    window itself in the part), all (rows of the stretch)."""
    stretches = stretch_batches(windows, size, step, context, rows, per_batch).select("window", "batch")
    came = arrivals.groupBy("batch").agg(F.min("arrived_at").alias("arrived_at"))
    parts = batch_parts(holes, stretches, per_batch)
    own_first, own_last = (F.col("window") - 1) * step + 1, (F.col("window") - 1) * step + size
    first, last = F.greatest(own_first - context * size, F.lit(1)), F.least(own_last + context * size, F.lit(rows))
    within = lambda a, b: F.greatest(F.least("hi", b) - F.greatest("lo", a) + 1, F.lit(0))
    met = stretches.join(parts, "batch").join(came, "batch", "left")
    return met.select("window", "batch", F.greatest("lo", first).alias("lo"), F.least("hi", last).alias("hi"), "arrived_at", "gone_at", "cause", within(first, last).alias("w"), within(own_first, own_last).alias("o"), (last - first + 1).alias("all")).where("w > 0")


def clips(settled: DataFrame, parts: DataFrame, size: int, step: int) -> DataFrame:
    """settle()'s complete windows and their deliveries() -> window, first, last: the contiguous rows around the window that were
    there at its completion; they condition it."""
    done = settled.where("complete_at IS NOT NULL").select("window", "complete_at", "completing_batch")
    there = (F.col("arrived_at") < F.col("complete_at")) | ((F.col("arrived_at") == F.col("complete_at")) & (F.col("batch") <= F.col("completing_batch")))
    held = parts.join(done, "window").where(there & (F.col("gone_at").isNull() | (F.col("gone_at") > F.col("complete_at"))))
    order = Window.partitionBy("window").orderBy("lo")  # the parts of one stretch
    marked = held.select("window", "lo", "hi", F.coalesce((F.col("lo") > F.lag("hi").over(order) + 1).cast("int"), F.lit(0)).alias("new"))
    runs = marked.withColumn("k", F.sum("new").over(order)).groupBy("window", "k").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    own = (F.col("first") <= (F.col("window") - 1) * step + 1) & (F.col("last") >= (F.col("window") - 1) * step + size)
    return runs.where(own).select("window", "first", "last")


def settle(windows: DataFrame, arrivals: DataFrame, holes: DataFrame, size: int, step: int, context: int, rows: int, per_batch: int, min_coverage: float = 1.0) -> DataFrame:
    """windows(window), arrivals(batch, arrived_at), holes as in batch_parts() -> window, complete_at, completing_batch, coverage
    (of the stretch, at that instant), dead_at, cause.

    complete_at is the first arrival after which the window's own rows are all there and ceil(min_coverage * rows) of its
    stretch, dead_at the declaration after which that can't come about any more, with the cause of its hole. A window
    has one of them or, if it still waits, neither."""
    met = deliveries(windows, arrivals, holes, size, step, context, rows, per_batch)
    lives = F.col("arrived_at").isNotNull() & (F.col("gone_at").isNull() | (F.col("arrived_at") < F.col("gone_at")))
    up = F.when(lives, F.struct(F.col("arrived_at").alias("at"), F.lit(1).alias("kind"), F.col("batch").alias("b"), F.col("w").alias("w"), F.col("o").alias("o"), F.lit(0).cast("long").alias("ew"), F.lit(0).cast("long").alias("eo"), F.lit(None).cast("string").alias("cause")))
    lost = lambda c: F.when(lives, -F.col(c)).otherwise(F.lit(0).cast("long"))
    down = F.when(F.col("gone_at").isNotNull(), F.struct(F.col("gone_at").alias("at"), F.lit(0).alias("kind"), cause_rank(F.col("cause")).cast("long").alias("b"), lost("w").alias("w"), lost("o").alias("o"), F.col("w").alias("ew"), F.col("o").alias("eo"), F.col("cause").alias("cause")))
    events = met.select("window", "all", F.explode(F.array_compact(F.array(up, down))).alias("e")).select("window", "all", "e.*")
    order = Window.partitionBy("window").orderBy("at", "kind", "b")  # the events of one stretch; peers count together
    sums = events.select("window", "all", "at", "kind", "b", "cause", *(F.sum(c).over(order).alias(c) for c in ("w", "o", "ew", "eo")))
    need = F.ceil(F.round(F.col("all") * F.lit(min_coverage), 6))
    done = (F.col("kind") == 1) & (F.col("o") == size) & (F.col("w") >= need)
    dead = (F.col("kind") == 0) & ((F.col("eo") > 0) | (F.col("ew") > F.col("all") - need))
    marked = sums.select(
        "window", F.when(done, F.struct("at", "b", (F.col("w") / F.col("all")).alias("coverage"))).alias("c"), F.when(dead, F.struct("at", "b", "cause")).alias("d")
    )
    both = marked.groupBy("window").agg(F.min("c").alias("c"), F.min("d").alias("d"))
    open_yet = F.col("c.at").isNull()  # a declaration after completion changes nothing
    found = both.select("window", F.col("c.at").alias("complete_at"), F.col("c.b").alias("completing_batch"), F.col("c.coverage").alias("coverage"), F.when(open_yet, F.col("d.at")).alias("dead_at"), F.when(open_yet, F.col("d.cause")).alias("cause"))
    return windows.select("window").join(found, "window", "left")


def _later_least(rows: DataFrame, column: str, block: int) -> DataFrame:
    """Adds `next_at`, the least value of a column over all later windows; blocks pass on their least."""
    dealt = rows.withColumn("_b", F.floor(F.col("window") / block))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    beyond = dealt.groupBy("_b").agg(F.min(column).alias("_m")).select("_b", F.min("_m").over(after).alias("_m"))
    inside = Window.partitionBy("_b").orderBy(F.desc("window")).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_i", F.min(column).over(inside)).join(beyond, "_b").withColumn("next_at", F.least("_i", "_m")).drop("_b", "_i", "_m")


def judged(settled: DataFrame, until: Column, horizon_seconds: float | None, final: bool = True, block: int = 100_000) -> DataFrame:
    """settle() of consecutive windows, with what is known up to the instant `until` -> its columns with state (scored, gap, late, or open
    where the feed isn't final) and settled_at; cause is horizon or undelivered where that settles a window."""
    kept = _later_least(settled.select("window", "complete_at", "completing_batch", "coverage", "dead_at", "cause"), "complete_at", block)
    given_up = F.lit(None).cast("timestamp") if horizon_seconds is None else F.timestamp_micros(F.unix_micros("next_at") + F.lit(round(horizon_seconds * 1e6)))
    ends = F.least(F.coalesce(given_up, until), until)
    own = F.coalesce("complete_at", "dead_at")
    in_time, over = own.isNotNull() & (own <= ends), F.coalesce(given_up <= until, F.lit(False))
    rest = F.lit("gap") if final else F.when(over, "gap").otherwise("open")
    return kept.withColumns({
        "state": F.when(in_time & F.col("complete_at").isNotNull(), "scored").when(F.col("complete_at").isNotNull() & (F.col("complete_at") > ends), "late").otherwise(F.when(in_time, "gap").otherwise(rest)),
        "settled_at": F.when(in_time, own).otherwise(ends), "cause": F.when(in_time, F.col("cause")).when(over, "horizon").otherwise("undelivered"),
    }).drop("next_at")


def ordered_commit(settled: DataFrame, end_at: Column, horizon_seconds: float | None = None, late_policy: str = "skip", block: int = 100_000) -> DataFrame:
    """settle() -> its columns with state (scored, gap, late), settled_at, release_at, cause.

    Windows are released by increasing index, each when all before it are settled. One that is neither complete nor dead holds
    back all later ones until `horizon_seconds` after the first of them is complete: then it is a gap of cause horizon. One that
    completes after that is late: skipped, or refused as a whole. At the feed's end, windows that wait are undelivered gaps."""
    refusing(late_policy)
    marked = judged(settled, end_at, horizon_seconds, True, block)
    if late_policy == "refuse":
        refuse(marked.where("state = 'late'"))
    return released(marked, block)


def refusing(late_policy: str) -> bool:
    if late_policy not in ("skip", "refuse"):
        raise ValueError(f"unknown late policy {late_policy}")
    return late_policy == "refuse"


def refuse(late: DataFrame) -> None:
    if (first := late.agg(F.min("window")).first()[0]) is not None:
        raise ValueError(f"window {first} completes beyond the horizon")


def released(marked: DataFrame, block: int, before_all: Column | None = None) -> DataFrame:
    """Adds release_at: the latest settled_at of a window and all before it, before_all being that of windows before the table."""
    dealt = marked.withColumn("_b", F.floor(F.col("window") / block))
    across = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    before = dealt.groupBy("_b").agg(F.max("settled_at").alias("_m")).select("_b", F.max("_m").over(across).alias("_m"))
    inside = Window.partitionBy("_b").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_i", F.max("settled_at").over(inside)).join(before, "_b")
    return out.withColumn("release_at", F.when(F.col("state") == "scored", F.greatest("_i", "_m", *([] if before_all is None else [before_all])))).drop("_b", "_i", "_m")


def gap_table(committed: DataFrame, block: int = 1_000_000) -> DataFrame:
    """ordered_commit() -> start, end, n, cause, settled_at: one row for each run of windows that were never scored and have one
    cause; settled_at is that of the last of them. Late windows count as gaps of their horizon."""
    from tidegauge.operators.intervals import islands

    lost = committed.where("state <> 'scored'").select(F.coalesce("cause", F.lit("horizon")).alias("cause"), "window", "settled_at")
    runs = islands(lost.select(F.col("cause").alias("series"), F.col("window").alias("idx")), block)
    cell = lambda c: F.floor(F.col(c) / F.lit(block)).cast("long")
    keyed = runs.withColumn("_b", F.explode(F.sequence(cell("start"), cell("end"))))
    met = lost.withColumn("_b", cell("window")).join(keyed, "_b").where("cause = series AND window BETWEEN start AND end")
    return met.groupBy("start", "end", "n", "cause").agg(F.max("settled_at").alias("settled_at"))

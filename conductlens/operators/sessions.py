"""Order-sensitive operators: replay dedup by high-water mark and runs of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conductlens.functions.staging import Running, global_index, running, segmented, stage

DEFAULT_ORDER = ["arrival"]
BUSY = 1_000_000  # events of a session that one task may order


def order_columns(events: DataFrame) -> list[str]:
    """``arrival`` where there is one, else time, session and position."""
    return DEFAULT_ORDER if "arrival" in events.columns else ["timestamp", "session_id", "sequence_position"]


def accept_events(events: DataFrame, hwm: DataFrame | None = None, order_cols: list[str] | None = None, busy: int = BUSY) -> DataFrame:
    """Events above their session's high-water mark, which is the largest position met before them.

    ``hwm`` holds the marks of earlier runs (agent_id, session_id, hwm).  A
    session is one window, and so one task, up to ``busy`` events; the marks of
    larger ones are carried over range partitions.
    """
    order = order_cols or order_columns(events)
    session = ["agent_id", "session_id"]
    earlier = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    by_window = lambda df: df.withColumn("_mark", F.max("sequence_position").over(earlier))
    # of the sessions only those above the bound are kept: few, whatever the number of events
    large = stage(events.groupBy(*session).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > busy).select(*session))
    if large.limit(1).count():
        large = F.broadcast(large)
        carried = segmented(events.join(large, session, "left_semi"), session, order, {"_mark": Running("max", F.col("sequence_position"))})
        marked = by_window(events.join(large, session, "left_anti")).unionByName(carried)
    else:
        marked = by_window(events)
    mark = F.col("_mark")
    if hwm is not None:
        marked = marked.join(hwm.select(*session, F.col("hwm").alias("_stored")), session, "left")
        mark = F.greatest(mark, F.col("_stored"))  # greatest skips nulls
    return marked.where(mark.isNull() | (F.col("sequence_position") > mark)).drop("_mark", "_stored").select(*events.columns)


def session_runs(
    events: DataFrame,
    scope_cols: list[str] | tuple[str, ...] = ("agent_id",),
    order_cols: list[str] | None = None,
    method: str = "rank",
) -> DataFrame:
    """Adds ``run``: equal exactly for the neighbouring rows of one session in the order of arrival.

    The run key is unique together with the scope columns and session_id.

    ``method="rank"`` numbers all rows of a scope without a window over the
    scope: with r the place in the global order and s the place within the
    session, r - s stays the same as long as a session's rows follow each other
    and grows as soon as another session comes between.  The largest window is
    then a session.  ``method="window"`` is the plain form, one window per scope.
    """
    order, scope = order_cols or order_columns(events), list(scope_cols)
    if method == "window":
        w = Window.partitionBy(*scope).orderBy(*order) if scope else Window.partitionBy(F.lit(0)).orderBy(*order)
        new = (~F.lag("session_id").over(w).eqNullSafe(F.col("session_id"))) | F.lag(F.lit(1)).over(w).isNull()
        return events.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w)).drop("_new")
    ranked = global_index(events, [*scope, *order], "_r")
    within = Window.partitionBy(*scope, "session_id").orderBy(*order)
    return ranked.withColumn("run", F.col("_r") - F.row_number().over(within)).drop("_r")


def followed_calls(calls: DataFrame, scope_cols: list[str] | tuple[str, ...], order_cols: list[str]) -> DataFrame:
    """Tool calls with ``before`` (the named call before a named one) and ``before_time`` (of the call before), each within its own kind of run.

    Both kinds of run come from one pass: with r the place among all calls (or
    among the named ones) in the order of the scope and s the place within the
    session, r - s names the run, as in ``session_runs``.
    """
    scope = list(scope_cols)
    named = F.col("tool_name").isNotNull().cast("int")
    placed = running(calls, [*scope, *order_cols], {"_r": F.lit(1), "_rn": named})
    within = Window.partitionBy(*scope, "session_id").orderBy(*order_cols)
    upto, earlier = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({"_run": F.col("_r") - F.row_number().over(within), "_named": F.col("_rn") - F.sum(named).over(upto)})
    last = F.last(F.when(named == 1, F.struct("_named", "tool_name")), ignorenulls=True).over(earlier)
    placed = placed.withColumns({"_call": F.lag(F.struct("_run", "timestamp")).over(within), "_name": last})
    return placed.withColumns(
        {
            "before": F.when((named == 1) & (F.col("_name._named") == F.col("_named")), F.col("_name.tool_name")),
            "before_time": F.when(F.col("_call._run") == F.col("_run"), F.col("_call.timestamp")),
        }
    ).drop("_r", "_rn", "_run", "_named", "_call", "_name")


def previous(column: str | Column, scope_cols: list[str] | tuple[str, ...], order_cols: list[str]) -> Column:
    """The column's value in the row before, within a run."""
    return F.lag(column).over(Window.partitionBy(*scope_cols, "session_id", "run").orderBy(*order_cols))


def rate_per_minute(now: Column, before: Column) -> Column:
    """Calls per minute from two times, by whole milliseconds; null unless time has passed."""
    micros = F.unix_micros(now) - F.unix_micros(before)
    ms = F.when(micros > 0, F.floor(micros / 1000))
    return F.when(ms > 0, 1.0 / (ms / 60000.0))

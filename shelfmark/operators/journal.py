"""Operation journals, recovery verdicts and the job queue, as queries over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TERMINAL_STATES

# The legal successors of each state.
TRANSITIONS = {
    "draft": ("planned",),
    "planned": ("preflight_passed", "conflict", "cancelled"),
    "preflight_passed": ("intent_logged", "conflict", "cancelled"),
    "intent_logged": ("executing", "recovery_needed"),
    "executing": ("published", "failed", "recovery_needed"),
    "published": ("verified", "recovery_needed"),
    "verified": ("completed", "rollback_pending"),
    "completed": ("rollback_pending",),
    "rollback_pending": ("rolled_back", "recovery_needed", "failed"),
    "recovery_needed": ("executing", "rollback_pending", "failed"),
}


def legal(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for state, successors in TRANSITIONS.items():
        out |= (before == state) & after.isin(*successors)
    return out


def illegal_steps(log: DataFrame, id_: str, *order: str) -> DataFrame:
    """Steps of a status log whose pair of states is not in the matrix."""
    last = F.lag("status").over(Window.partitionBy(id_).orderBy(*order))
    return log.withColumn("previous_status", last).where(F.col("previous_status").isNotNull() & ~legal(F.col("previous_status"), F.col("status")))


def recovery_queue(operations: DataFrame) -> DataFrame:
    return operations.where(~F.col("status").isin(*TERMINAL_STATES)).orderBy("created_at_ms", "id")


def verdict(source_matches: Column, target_matches: Column, source_exists: Column, target_exists: Column) -> Column:
    """What to do with an interrupted move."""
    return (
        F.when(source_matches & ~target_exists, "resume_from_source")
        .when(target_matches & ~source_exists, "operation_completed")
        .when(source_matches & target_matches, "remove_published_source")
        .otherwise("manual_review")
    )


def audit(items: DataFrame) -> DataFrame:
    """Status of each interrupted operation from its items' ``source_matches`` and the like."""
    untouched = F.bool_and(F.col("source_matches") & ~F.col("target_exists"))
    moved = F.bool_and(F.col("target_matches") & ~F.col("source_exists"))
    status = F.when(untouched, "failed").when(moved, "completed").otherwise("recovery_needed")
    plan = F.when(untouched, "ready").when(moved, "completed")
    return items.groupBy("operation_id").agg(status.alias("status"), plan.alias("plan_status"))


def presence_verdict(source_exists: Column, target_exists: Column) -> Column:
    """The older rule, by existence alone."""
    return F.when(target_exists & ~source_exists, "completed").when(source_exists & ~target_exists, "pending").otherwise("recovery_needed")


def execution_tally(items: DataFrame) -> DataFrame:
    done, total = F.count_if(F.col("status") == "completed"), F.count(F.lit(1))
    status = F.when(done == total, "completed").when(done > 0, "partial").otherwise("failed")
    return items.groupBy("operation_id").agg(done.alias("completed"), total.alias("total"), status.alias("outcome"))


def with_items(headers: DataFrame, items: DataFrame, key: str, *fields: str) -> DataFrame:
    """Headers with their items in order, in one join."""
    listed = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", *fields))).alias("items"))
    return headers.join(listed, headers["id"] == listed[key], "left").drop(key)


# Job queue


def expired_lease(now_ms: int) -> Column:
    return F.col("lease_expires_at_ms") < now_ms


def expire(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Jobs after leases that ran out: requests are granted, running jobs queue again."""
    after = F.when(F.col("status") == "pause_requested", "paused").when(F.col("status") == "cancel_requested", "cancelled").when(F.col("status") == "running", "queued")
    due = expired_lease(now_ms) & after.isNotNull()
    return jobs.withColumns(
        {
            "status": F.when(due, after).otherwise(F.col("status")),
            "lease_owner": F.when(~F.coalesce(due, F.lit(False)), F.col("lease_owner")),
            "lease_expires_at_ms": F.when(~F.coalesce(due, F.lit(False)), F.col("lease_expires_at_ms")),
        }
    )


def claim(jobs: DataFrame, now_ms: int) -> DataFrame:
    """The job that would be claimed: leases expire first, then priority, age and id decide."""
    return expire(jobs, now_ms).where("status = 'queued'").orderBy(F.desc("priority"), "created_at_ms", "id").limit(1)


def claim_order(jobs: DataFrame, now_ms: int, *by: str) -> DataFrame:
    """Jobs that can be claimed, with their ``place`` among those with equal ``by``."""
    order = Window.partitionBy(*by).orderBy(F.desc("priority"), "created_at_ms", "id")
    return expire(jobs, now_ms).where("status = 'queued'").withColumn("place", F.row_number().over(order))


def request(jobs: DataFrame, kind: str) -> DataFrame:
    """Jobs after a ``pause`` or ``cancel`` request: running ones are asked, waiting ones change at once."""
    final = {"pause": "paused", "cancel": "cancelled"}[kind]
    waiting = ["queued"] if kind == "pause" else ["queued", "paused"]
    status = F.when(F.col("status") == "running", f"{kind}_requested").when(F.col("status").isin(*waiting), final).otherwise(F.col("status"))
    return jobs.withColumn("status", status)


def resume(jobs: DataFrame) -> DataFrame:
    """Paused jobs queue again, from the start."""
    paused = F.col("status") == "paused"
    return jobs.withColumns(
        {
            "status": F.when(paused, "queued").otherwise(F.col("status")),
            "progress_current": F.when(paused, 0).otherwise(F.col("progress_current")),
            "progress_total": F.when(~paused, F.col("progress_total")),
        }
    )


def owned(owner: str, now_ms: int) -> Column:
    """Whether ``owner`` holds a live lease; only then may a job be changed."""
    return F.coalesce((F.col("lease_owner") == owner) & (F.col("lease_expires_at_ms") >= now_ms), F.lit(False))


def finish(jobs: DataFrame, owner: str, now_ms: int, expected: str, outcome: str) -> DataFrame:
    """Jobs after their owner says that one in state ``expected`` is ``outcome``.

    ``applied`` is false where the lease is lost or the state is another. Completing
    and failing expect ``running``; acknowledging a request expects the request.
    """
    mine = owned(owner, now_ms) & (F.col("status") == expected)
    return jobs.withColumn("applied", mine).withColumn("status", F.when(mine, outcome).otherwise(F.col("status")))


#: States in which a job belongs to its worker.
HELD = ("running", "pause_requested", "cancel_requested")


def held(owner: str, now_ms: int) -> Column:
    """Whether ``owner`` works on the job under a live lease; else a report or a renewal is lost."""
    return owned(owner, now_ms) & F.col("status").isin(*HELD)


def progress(jobs: DataFrame, owner: str, now_ms: int, current: Column, total: Column) -> DataFrame:
    """Jobs after a progress report; a total that is not given is kept. A report beyond its total changes nothing."""
    ok = held(owner, now_ms) & F.coalesce(current <= total, F.lit(True))
    return jobs.withColumns(
        {
            "progress_current": F.when(ok, current).otherwise(F.col("progress_current")),
            "progress_total": F.when(ok, F.coalesce(total, F.col("progress_total"))).otherwise(F.col("progress_total")),
        }
    )


def renew(jobs: DataFrame, owner: str, now_ms: int, duration_ms: int) -> DataFrame:
    """Jobs after their owner renews its leases, for a millisecond at least; ``renewed`` is false where that is too late."""
    ok = held(owner, now_ms)
    until = F.lit(now_ms + max(1, duration_ms)).cast("long")
    return jobs.withColumn("renewed", ok).withColumn("lease_expires_at_ms", F.when(ok, until).otherwise(F.col("lease_expires_at_ms")))


def first_events(jobs: DataFrame) -> DataFrame:
    """What enqueueing logs: one ``queued`` event for each job, with nothing done yet."""
    return jobs.select(F.col("id").alias("job_id"), F.lit("queued").alias("event"), F.col("created_at_ms"))


def event_log(events: DataFrame) -> DataFrame:
    """Events in the order they were logged, numbered for each job."""
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("created_at_ms", "event"))
    return events.withColumn("number", number)


# Bounds of an automation's interval, in seconds.
WATCH_LEAST, SCHEDULE_LEAST, INTERVAL_MOST = 10, 60, 30 * 86_400


def interval(kind: Column, seconds: Column) -> Column:
    """The interval an automation really runs at."""
    least = F.when(kind == "watch", WATCH_LEAST).otherwise(SCHEDULE_LEAST)
    return F.least(F.greatest(seconds, least), F.lit(INTERVAL_MOST))


def next_runs(automations: DataFrame, now_s: int) -> DataFrame:
    """When each enabled automation runs next: one that is due now starts over from now."""
    pace = interval(F.col("kind"), F.col("seconds"))
    due = F.col("next_run") <= now_s
    return automations.where("enabled").select("id", due.alias("due"), F.when(due, F.lit(now_s) + pace).otherwise(F.col("next_run")).cast("long").alias("next_run"))

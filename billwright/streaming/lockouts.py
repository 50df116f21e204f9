"""Account locks from a login log: five failures without a success lock for an hour.

In a stored log the locks of a user are a chain over runs of failures, found
without reading the user's logins in order. A stream keeps two numbers of
state per user.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from billwright.config import LOCK_AFTER_FAILURES, LOCK_SECONDS
from billwright.session import staged

LOCKS = "user_id bigint, locked_at_us bigint, locked_until_us bigint, failures int"
_MICROS = 1_000_000

#: Runs of failures of a user that are held in one value, and microseconds of a slot of time.
MANY_STARTS = 10_000
SLOT_US = 60 * _MICROS

# Executors get these functions with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _login(failures: int, locked_until: int, at: int, failed: bool) -> tuple[int, int, bool]:
    """(failures, locked_until, locked now) after one login; times in microseconds, 0 is unlocked."""
    if locked_until and at < locked_until:
        return failures, locked_until, False
    if locked_until:
        failures, locked_until = 0, 0
    if not failed:
        return 0, 0, False
    failures += 1
    if failures >= LOCK_AFTER_FAILURES:
        return failures, at + LOCK_SECONDS * _MICROS, True
    return failures, 0, False


def logins(access: DataFrame) -> DataFrame:
    """user_id, event_id, at_us, failed: the login rows of an access log with ``ts`` as TIMESTAMP."""
    rows = access.where(F.col("action").isin("login_failed", "login_ok"))
    return rows.select("user_id", "event_id", F.unix_micros("ts").alias("at_us"), (F.col("action") == "login_failed").alias("failed"))


def lock_starts(access: DataFrame, after: int = LOCK_AFTER_FAILURES) -> DataFrame:
    """user_id, at_us, event_id, lock_us of every login that begins ``after`` failures in a row.

    The log is sorted over all tasks, so a user's logins lie in as many parts
    as they need; the rows that follow a part are copied to it. Logins without
    a user lock nobody.
    """
    ordered = logins(access).where(F.col("user_id").isNotNull()).repartitionByRange("user_id", "at_us", "event_id").withColumn("_part", F.spark_partition_id())
    rows = staged(ordered, "logins")
    # numbered without gaps: each part has a row, so what follows lies in the next parts up to ``after``
    parts = rows.select("_part").distinct().withColumn("_number", F.row_number().over(Window.orderBy("_part")))
    placed = rows.join(F.broadcast(parts), "_part").drop("_part")  # one row a task
    rank = F.row_number().over(Window.partitionBy("_number").orderBy("user_id", "at_us", "event_id"))
    heads = placed.withColumn("_rank", rank).where(F.col("_rank") < after).drop("_rank")
    earlier = F.explode(F.sequence(F.col("_number") - (after - 1), F.col("_number") - 1))
    copies = heads.withColumn("_own", F.lit(False)).withColumn("_number", earlier)
    both = placed.withColumn("_own", F.lit(True)).unionByName(copies)
    ahead = Window.partitionBy("_number", "user_id").orderBy("at_us", "event_id")
    failures = F.sum(F.col("failed").cast("int")).over(ahead.rowsBetween(0, after - 1))
    found = both.select("*", failures.alias("_failures"), F.lead("at_us", after - 1).over(ahead).alias("lock_us"))
    return found.where(F.col("_own") & (F.col("_failures") == after)).select("user_id", "at_us", "event_id", "lock_us")


def _next_start(starts: DataFrame, lasts_us: int) -> DataFrame:
    """``starts`` with ``next``: the number of the user's first start from the end of its lock on.

    Times are cut into slots: the answer is within the slot where the lock
    ends, or it is the first start of a later slot.
    """
    start = F.struct("at_us", "event_id", "number").alias("start")
    ends = starts.select("user_id", (F.col("lock_us") + lasts_us).alias("at_us"), F.col("number").alias("asker"))
    rows = starts.select("user_id", "at_us", start).unionByName(ends, allowMissingColumns=True)
    rows = rows.withColumn("slot", F.floor(F.col("at_us") / SLOT_US).cast("long"))
    onwards = Window.partitionBy("user_id", "slot").orderBy(F.desc("at_us")).rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("user_id").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("user_id", "slot").agg(F.min("start").alias("first"))
    slots = slots.select("user_id", "slot", F.min("first").over(later).alias("following"))
    asked = rows.withColumn("inside", F.min("start").over(onwards)).where(F.col("asker").isNotNull()).join(slots, ["user_id", "slot"])
    return starts.join(asked.select(F.col("asker").alias("number"), F.coalesce("inside", "following").getField("number").alias("next")), "number")


def _chained(starts: DataFrame, lasts_us: int) -> DataFrame:
    """The starts that lock, of users with many: from the first start on to the next, in doubling steps.

    Each start maps to the one after its lock. The map is composed with itself
    round by round, so it spans 1, 2, 4, ... locks, and what is reached doubles.
    """
    starts = staged(starts.withColumn("number", F.monotonically_increasing_id()), "starts")
    steps = staged(_next_start(starts, lasts_us).where(F.col("next").isNotNull()).select("number", "next"), "steps")
    first = starts.groupBy("user_id").agg(F.min(F.struct("at_us", "event_id", "number")).alias("first"))
    reached = staged(first.select(F.col("first.number").alias("number")), "reached")
    while True:
        new = staged(reached.join(steps, "number").select(F.col("next").alias("number")), "reached")
        if new.isEmpty():
            return starts.join(reached, "number", "left_semi").select("user_id", "lock_us")
        reached = staged(reached.unionByName(new), "reached")
        onward = steps.select(F.col("number").alias("next"), F.col("next").alias("beyond"))
        steps = staged(steps.join(onward, "next").select("number", F.col("beyond").alias("next")), "steps")


def lockouts(access: DataFrame, many: int = MANY_STARTS) -> DataFrame:
    """Every lock of every user in a stored log.

    A user is locked at the fifth failure in a row, counted from the end of
    the lock before. So the locks are a chain of runs of five failures, each
    the first from the end of the lock before on. The starts of runs are found
    with all rows spread evenly. The chain of a user with up to ``many`` starts
    is followed within one value; longer ones by doubling over all tasks.
    """
    lasts = LOCK_SECONDS * _MICROS
    starts = staged(lock_starts(access), "lock-starts")
    heavy = staged(starts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select("user_id"), "many-starts")
    busy = not heavy.isEmpty()
    few = starts.join(heavy, "user_id", "left_anti") if busy else starts
    inner = F.struct(F.lit(-(1 << 62)).alias("until"), F.array().cast("array<bigint>").alias("locks"))
    follow = F.aggregate(
        F.sort_array(F.collect_list(F.struct("at_us", "event_id", "lock_us"))),
        inner,
        lambda a, x: F.when(
            x["at_us"] >= a["until"], F.struct((x["lock_us"] + lasts).alias("until"), F.array_append(a["locks"], x["lock_us"]).alias("locks"))
        ).otherwise(a),
        lambda a: a["locks"],
    )
    locks = few.groupBy("user_id").agg(follow.alias("locks")).select("user_id", F.explode("locks").alias("lock_us"))
    if busy:
        locks = locks.unionByName(_chained(starts.join(heavy, "user_id", "left_semi"), lasts))
    return locks.select(
        "user_id",
        F.col("lock_us").alias("locked_at_us"),
        (F.col("lock_us") + lasts).alias("locked_until_us"),
        F.lit(LOCK_AFTER_FAILURES).alias("failures"),
    )


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, until = state.get if state.exists else (0, 0)
    locks = []
    arrived = pd.concat(list(batches), ignore_index=True).sort_values(["at_us", "event_id"], kind="stable")
    for at, failed in zip(arrived["at_us"], arrived["failed"]):
        failures, until, locked = _login(failures, until, int(at), bool(failed))
        if locked:
            locks.append((key[0], int(at), until, failures))
    state.update((failures, until))
    yield pd.DataFrame(locks, columns=["user_id", "locked_at_us", "locked_until_us", "failures"])


def stream_lockouts(access: DataFrame) -> DataFrame:
    """Locks as they happen, for a log whose triggers arrive in time order.

    Only the rows of one trigger are sorted at a time; what went before is
    two numbers of state per user.
    """
    return (
        logins(access)
        .groupBy("user_id")
        .applyInPandasWithState(_advance, LOCKS, "failures int, until_us bigint", "append", GroupStateTimeout.NoTimeout)
    )

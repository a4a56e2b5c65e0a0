"""State, time and history as window queries over event rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds of a timestamp, with or without a zone (read in the session's, UTC here)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


TERMINAL = ("complete", "partial", "failed", "cancelled")


def latest(events: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """Latest values of each key, by aggregation: a hot key is reduced in the map tasks."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("m")).select(key, *(F.col(f"m.{v}").alias(v) for v in values))


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart, jobs that had not ended have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*TERMINAL), F.col("status")).otherwise("failed"))


def timeouts(events: DataFrame, key: str, limits: dict[str, int], stage: str = "event_type") -> DataFrame:
    """Stages that lasted beyond their limit, from each stage's row to the key's next row."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    seconds = (micros(F.lead("ts").over(w)) - micros("ts")) / 1e6
    most = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col(stage))
    return events.withColumn("seconds", F.round(seconds, 3)).withColumn("limit", most).where(F.col("seconds") > F.col("limit"))


def attempts_in_window(events: DataFrame, key: str, seconds: int = 300) -> DataFrame:
    """How many rows of the key fell within the last ``seconds``, itself included: rejected attempts count here, unlike in ``rate_limit``."""
    us = micros("ts")
    return events.withColumn("n_recent", F.count("*").over(Window.partitionBy(key).orderBy(us).rangeBetween(-seconds * 1_000_000, 0)))


def rate_limit(events: DataFrame, key: str, limit: int = 20, seconds: int = 300) -> DataFrame:
    """Sliding-window limit in which rejected attempts are not recorded.

    Whether a row counts depends on whether it was let through, which no window frame can say; each
    key's rows pass in time order through a queue of at most ``limit`` times. Rows stream through in
    sorted batches, so a hot key needs no memory of its own. Rows without a key are limited together; rows without a time
    cannot be placed and give nothing. Columns: the key, ts, event_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queue = object(), []
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    now, queue = k, []
                queue = [x for x in queue if x > t - seconds * 1_000_000]
                allowed = len(queue) < limit
                if allowed:
                    queue.append(t)
                out.append(allowed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.bool_())], [key, "event_id", "allowed"])

    rows = events.select(F.col(key).cast("long").alias(key), micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id")).where("us IS NOT NULL")
    return rows.repartition(key).sortWithinPartitions(key, "us", "event_id").mapInArrow(run, f"{key} long, event_id long, allowed boolean")


def sessions_open(logins: DataFrame, now: Column, seconds: int = 43_200) -> DataFrame:
    return logins.where(F.col("ts") + F.make_interval(secs=F.lit(seconds)) > now)


def cache_hits(requests: DataFrame, key: str, seconds: int = 1800, owner: str | None = None, entries: int = 128) -> DataFrame:
    """Would a cache whose entries live ``seconds`` from being written have answered?

    A row is written when the entry of its key has run out, and a hit does not renew it. Each ``owner`` (the key itself if none is
    given) has a cache of its own, of at most ``entries`` entries: a write beyond that drops the entry written first.
    Owners' rows pass in time order, in the same stream as above, so memory is one cache.
    """
    own = owner or key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, written = object(), {}
        for b in batches:
            out = []
            for o, k, t in zip(*(b.column(c).to_pylist() for c in range(3))):
                if o != now:
                    now, written = o, {}
                hit = k in written and t - written[k] < seconds * 1_000_000
                if not hit:
                    written.pop(k, None)
                    if len(written) >= entries:
                        written.pop(next(iter(written)))
                    written[k] = t
                out.append(hit)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array(out, pa.bool_())], [key, "event_id", "hit"])

    rows = requests.select(F.col(own).cast("string").alias("_owner"), F.col(key).cast("string").alias(key), micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id")).where("us IS NOT NULL")
    return rows.repartition("_owner").sortWithinPartitions("_owner", "us", "event_id").mapInArrow(run, f"{key} string, event_id long, hit boolean")


def journal(events: DataFrame, key: str) -> DataFrame:
    """Sequence numbers from 1 within each key."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id")))


def read_after(journal_rows: DataFrame, cursor: int) -> DataFrame:
    return journal_rows.where(F.col("seq") > cursor)


def admission(messages: DataFrame, most: int = 100) -> DataFrame:
    """Conversations that may take a message: none running, fewer than ``most``."""
    agg = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "running").alias("busy"))
    return agg.select("conv_id", "n", F.when(F.col("busy"), "running").when(F.col("n") >= most, "full").otherwise("open").alias("admission"))


def history(rows: DataFrame, owner: str, record: str, most: int = 100) -> DataFrame:
    """Latest version of each record, the newest ``most`` of each owner."""
    last = rows.groupBy(owner, record).agg(F.max(F.struct("ts", "event_id")).alias("m")).select(owner, record, F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("place") <= most)


def resumable(jobs: DataFrame, drafts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Finished jobs without a draft whose drafting task still runs."""
    return jobs.where(F.col("status").isin("complete", "partial")).join(drafts, "job", "left_anti").join(tasks.where("task_status = 'running'"), "job", "left_semi")


def warm_reuse(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a worker's next job finds the worker as the last one left it."""
    w = Window.partitionBy("worker").orderBy("ts", "event_id")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    return jobs.withColumn("reused", same & F.lag(F.lit(1)).over(w).isNotNull())

"""The URL frontier as tables: every step takes the state and gives the next one, without a lock or a loop over rows.

State: entries (url_id, url, domain, priority, job_type, retries, status, queue_side, pushed, started_at, lease_deadline, next_retry_at,
last_error) and domains (domain, ready_at).  In a domain's queue the left side comes first, last in first out; the right side follows, first in
first out.  Leases are given to all ready domains at once, one each, as a step of one lease at a time would over the same instant.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

ENTRY = (
    "url_id string, url string, domain string, priority int, job_type string, retries int, status string, queue_side string, pushed double, "
    "started_at double, lease_deadline double, next_retry_at double, last_error string"
)
NAMES = [part.split()[0] for part in ENTRY.split(", ")]


@dataclass
class Policy:
    crawl_delay: float = 2.0
    lease_seconds: float = 300.0
    max_retries: int = 3
    retry_delay: float = 30.0
    backoff: float = 2.0
    max_retry_delay: float = 300.0
    urgent: int = 3
    default_priority: int = 5
    batch: int = 100
    #: Picks the side of the queue from the columns of an entry; by default urgent entries go left.
    side: object = None
    domain_delays: dict[str, float] = field(default_factory=dict)


def _side(policy: Policy) -> Column:
    return policy.side() if policy.side else F.when(F.col("priority") <= policy.urgent, "left").otherwise("right")


def _front() -> Column:
    """The smallest of a queue is its front."""
    left = F.col("queue_side") == "left"
    return F.struct(F.when(left, 0).otherwise(1).alias("a"), F.when(left, -F.col("pushed")).otherwise(F.col("pushed")).alias("b"), F.col("url_id").alias("c"))


def add(entries: DataFrame, batch: DataFrame, now: float, policy: Policy = Policy()) -> DataFrame:
    """entries with the URLs of batch (ordinal, url, and perhaps priority and job_type) that were never seen; the first of equal ones counts.

    A URL without a host is left out.  Order in the batch is kept in the queue.
    """
    names = batch.columns
    priority = F.coalesce(F.col("priority").cast("int"), F.lit(policy.default_priority)) if "priority" in names else F.lit(policy.default_priority)
    job = F.coalesce(F.col("job_type"), F.lit("")) if "job_type" in names else F.lit("")
    new = batch.select("ordinal", urls.normalized(F.col("url")).alias("url"), priority.alias("priority"), job.alias("job_type")).where("url IS NOT NULL")
    new = new.withColumn("url_id", F.sha1(F.col("url").cast("binary")))
    new = new.groupBy("url_id").agg(F.min_by(F.struct("ordinal", "url", "priority", "job_type"), "ordinal").alias("r")).select("url_id", "r.*")
    new = new.join(entries.select("url_id"), "url_id", "left_anti").withColumn("domain", urls.host(F.col("url")))
    none = F.lit(None)
    new = new.withColumns(
        {"retries": F.lit(0), "status": F.lit("queued"), "queue_side": _side(policy), "pushed": F.lit(now) + F.col("ordinal") * 1e-6,
         "started_at": none.cast("double"), "lease_deadline": none.cast("double"), "next_retry_at": none.cast("double"), "last_error": none.cast("string")}
    )
    return entries.select(NAMES).unionByName(new.select(NAMES))


def counts(before: DataFrame, after: DataFrame, batch: DataFrame) -> DataFrame:
    """total, inserted and duplicates of a batch, one row."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(batch, "total").join(n(after, "after")).join(n(before, "before"))  # three rows of one number each
    return one.select("total", (F.col("after") - F.col("before")).alias("inserted"), (F.col("total") - F.col("after") + F.col("before")).alias("duplicates"))


def delay_of(domain: Column, policy: Policy) -> Column:
    """The domain's own delay, else the common one."""
    out = F.lit(float(policy.crawl_delay))
    for name, seconds in policy.domain_delays.items():
        out = F.when(domain == name, float(seconds)).otherwise(out)
    return out


def lease(entries: DataFrame, domains: DataFrame, now: float, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(entries, domains) after every domain that is ready has leased the front of its queue; a domain without a time is ready."""
    queued = entries.where("status = 'queued'")
    fronts = queued.groupBy("domain").agg(F.min_by("url_id", _front()).alias("front"))
    ready = fronts.join(domains, "domain", "left").where(F.coalesce("ready_at", F.lit(0.0)) <= now).select(F.col("front").alias("url_id"), F.lit(True).alias("leased"))
    out = entries.join(ready, "url_id", "left")
    on = F.coalesce("leased", F.lit(False))
    leased = out.withColumns(
        {"status": F.when(on, "inflight").otherwise(F.col("status")), "started_at": F.when(on, now).otherwise(F.col("started_at")),
         "lease_deadline": F.when(on, now + policy.lease_seconds).otherwise(F.col("lease_deadline"))}
    )
    times = leased.where("leased").select("domain", (F.lit(now) + delay_of(F.col("domain"), policy)).alias("next_at"))
    moved = domains.join(times, "domain", "full").select("domain", F.coalesce("next_at", "ready_at").alias("ready_at"))
    return leased.select(NAMES), moved


def complete(entries: DataFrame, done: DataFrame) -> DataFrame:
    """Leased entries whose url_id is in done are completed; others stay as they are."""
    hit = entries.join(done.select("url_id").distinct().withColumn("hit", F.lit(True)), "url_id", "left")
    on = F.coalesce("hit", F.lit(False)) & (F.col("status") == "inflight")
    return _changed(hit, on, {"status": F.lit("completed"), "started_at": F.lit(None), "lease_deadline": F.lit(None), "next_retry_at": F.lit(None)})


def _changed(df: DataFrame, on: Column, values: dict[str, Column]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({n: F.when(on, v.cast(kinds[n])).otherwise(F.col(n)) for n, v in values.items()}).select(NAMES)


def _failed(df: DataFrame, on: Column, error: Column, now: float, policy: Policy) -> DataFrame:
    tries = F.col("retries") + 1
    dead = tries > policy.max_retries
    wait = F.least(F.lit(policy.max_retry_delay), policy.retry_delay * F.pow(F.lit(policy.backoff), tries - 1))
    return _changed(
        df, on,
        {"retries": tries, "status": F.when(dead, "failed").otherwise("retry_scheduled"), "next_retry_at": F.when(~dead, now + wait),
         "started_at": F.lit(None), "lease_deadline": F.lit(None), "last_error": error},
    )


def fail(entries: DataFrame, failures: DataFrame, now: float, policy: Policy = Policy()) -> DataFrame:
    """Leased entries in failures (url_id, error) are tried again later, or are dead letters after too many tries."""
    hit = entries.join(failures.groupBy("url_id").agg(F.min("error").alias("error")).withColumn("hit", F.lit(True)), "url_id", "left")
    return _failed(hit, F.coalesce("hit", F.lit(False)) & (F.col("status") == "inflight"), F.col("error"), now, policy)


def dead_letters(entries: DataFrame) -> DataFrame:
    return entries.where("status = 'failed'").select("url_id", "url", "domain", "retries", "last_error")


def _first(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.orderBy(by, "url_id").limit(n).select("url_id").withColumn("hit", F.lit(True))


def promote(entries: DataFrame, now: float, policy: Policy = Policy()) -> DataFrame:
    """The retries that are due, a batch of them at most by time, go back to their side of the queue."""
    due = _first(entries.where((F.col("status") == "retry_scheduled") & (F.col("next_retry_at") <= now)), "next_retry_at", policy.batch)
    hit = entries.join(F.broadcast(due), "url_id", "left")  # a batch at most
    return _changed(hit, F.coalesce("hit", F.lit(False)), {"status": F.lit("queued"), "pushed": F.lit(now), "next_retry_at": F.lit(None)})


def recover(entries: DataFrame, now: float, policy: Policy = Policy(), error: str = "lease timeout") -> tuple[DataFrame, DataFrame]:
    """Leases past their deadline, a batch of them at most, fail; and how many were requeued and how many are dead."""
    late = _first(entries.where((F.col("status") == "inflight") & (F.col("lease_deadline") <= now)), "lease_deadline", policy.batch)
    hit = entries.join(F.broadcast(late), "url_id", "left")  # a batch at most
    on = F.coalesce("hit", F.lit(False))
    dead = F.col("retries") + 1 > policy.max_retries
    summary = hit.where(on).agg(F.count_if(~dead).alias("requeued"), F.count_if(dead).alias("failed"))
    return _failed(hit, on, F.lit(error), now, policy), summary


def waits(entries: DataFrame, domains: DataFrame, now: float, most: float = 5.0) -> DataFrame:
    """Seconds until a queued domain is ready and until a retry is due (null without any), and how long a worker sleeps, one row."""
    waiting = entries.where("status = 'queued'").select("domain").distinct().join(domains, "domain", "left")
    ready = waiting.agg(F.min(F.greatest(F.lit(0.0), F.coalesce("ready_at", F.lit(0.0)) - now)).alias("ready"))
    retry = entries.where("status = 'retry_scheduled'").agg(F.min(F.greatest(F.lit(0.0), F.col("next_retry_at") - now)).alias("retry"))
    both = ready.join(retry)  # one row each
    return both.withColumn("sleep", F.coalesce(F.least(F.lit(most), F.greatest(F.lit(0.05), F.least("ready", "retry"))), F.lit(most)))


def statuses(entries: DataFrame) -> DataFrame:
    return entries.groupBy("domain", "status").agg(F.count("*").alias("n"))


def status_of(entries: DataFrame, url_id: str) -> DataFrame:
    """All that is known of one URL; no row if there is none."""
    return entries.where(F.col("url_id") == url_id)

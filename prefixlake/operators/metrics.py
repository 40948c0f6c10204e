"""Counters and gauges from logs, and their text form."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.operators.rib import KEY

PREFIX = "prefixlake"
USER_PREFIX = "user_defined_"
SIZES = (1, 10, 100, 1000, 10000)


def counters(events: DataFrame) -> DataFrame:
    """(name, value): sums of user counters (name, amount); adding 0 makes no counter."""
    return events.filter("amount <> 0").groupBy("name").agg(F.sum("amount").alias("value"))


def gauges(events: DataFrame) -> DataFrame:
    """(name, value): the last value of each user gauge (name, seq, value)."""
    return events.groupBy("name").agg(F.max_by("value", "seq").alias("value"))


def rib_counters(log: DataFrame) -> DataFrame:
    """One row of counts over a log: announcements of new keys, further announcements (a withdrawal of a known key counts too), withdrawals, those of keys never announced, keys, prefixes, and announced less withdrawn, which may be negative."""
    rows = log.filter(F.col("op").isin("announce", "withdraw"))
    keys = rows.groupBy(*KEY).agg(F.min(F.when(F.col("op") == "announce", F.col("seq"))).alias("first_seq"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("op") == "withdraw").alias("gone"))
    early = rows.filter("op = 'withdraw'").select(*KEY, "seq").join(keys.select(*KEY, "first_seq"), list(KEY)).filter("first_seq IS NULL OR seq < first_seq").agg(F.count(F.lit(1)).alias("early"))
    known = F.col("first_seq").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    whole = keys.agg(F.count_if(known).alias("announced_new"), total(F.col("n")).alias("n"), total(F.col("gone")).alias("withdrawn"))
    prefixes = keys.filter(known).select("safi", "afi", "bits").distinct().agg(F.count(F.lit(1)).alias("unique_prefixes"))
    return whole.join(F.broadcast(early)).join(F.broadcast(prefixes)).select(
        "announced_new", (F.col("n") - F.col("announced_new") - F.col("early")).alias("modified"), "withdrawn", F.col("early").alias("withdrawn_unknown"),
        (F.col("announced_new") - F.col("withdrawn")).alias("announced_balance"), F.col("announced_new").alias("items"), "unique_prefixes",
    )


def last_delays(log: DataFrame) -> DataFrame:
    """(ingress_id, delay_ms): from receipt to processing of each ingress's last update."""
    delay = (F.unix_micros("processed_at") - F.unix_micros("received_at")) / 1000
    return log.groupBy("ingress_id").agg(F.max_by(delay, "seq").alias("delay_ms"))


def type_counts(messages: DataFrame) -> DataFrame:
    """(router_id, msg_type, n)."""
    return messages.groupBy("router_id", "msg_type").agg(F.count(F.lit(1)).alias("n"))


def event_counts(events: DataFrame, by: str, names: list[str]) -> DataFrame:
    """A column for each kind of event (kind) by a label: connections of a listener, publications of a topic and the like."""
    return events.groupBy(by).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in names))


def bmp_gauges(routers: DataFrame) -> DataFrame:
    """One row from the last state of each router (bmp_sessions.counts): routers that are connected, peers that are up, routers and ends of RIB that are awaited, unknown peers."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return routers.agg(
        F.count_if(F.col("phase").isin("dumping", "updating")).alias("connected_routers"), n(F.col("up_peers")).alias("up_peers"),
        F.count_if(F.col("pending") > 0).alias("routers_with_pending_eors"), n(F.col("pending")).alias("pending_eors"), n(F.col("unknown_peers")).alias("unknown_peers"),
    )


def rtr_session(log: DataFrame, now: Column) -> DataFrame:
    """One row from (seq, session_id, serial, received_at, n_read, n_written): the last session, serial and time, and all bytes."""
    last = F.max_by(F.struct("session_id", "serial", "received_at"), "seq")
    return log.agg(last.alias("last"), F.sum("n_read").alias("bytes_read"), F.sum("n_written").alias("bytes_written")).select(
        "last.session_id", "last.serial", F.col("last.received_at").alias("updated_at"), (F.unix_seconds(now) - F.unix_seconds("last.received_at")).alias("seconds_since_update"), "bytes_read", "bytes_written"
    )


def size_bucket(size: Column) -> Column:
    found = F.lit("leInf")
    for s in reversed(SIZES):
        found = F.when(size <= s, f"le{s}").otherwise(found)
    return found


def averages_by_size(rows: DataFrame) -> DataFrame:
    """(bucket, average, n) of value by the size it was measured at (value, size)."""
    return rows.groupBy(size_bucket(F.col("size")).alias("bucket")).agg(F.avg("value").alias("average"), F.count(F.lit(1)).alias("n"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """Lines (value, with their order) of metrics (name, kind, unit, component, value): a TYPE line and then the values of each name."""
    full = F.concat_ws("_", F.lit(PREFIX), "name", F.when(F.col("unit") != "", F.col("unit")))
    named = metrics.withColumn("full", full)
    types = named.select("full", "kind").distinct().select("full", F.lit(0).alias("line"), F.format_string("# TYPE %s %s", "full", "kind").alias("value"))
    values = named.select("full", F.lit(1).alias("line"), F.concat("full", F.lit('{component="'), "component", F.lit('"} '), F.col("value").cast("string")).alias("value"))
    return types.union(values).orderBy("full", "line", "value").select("value")


def user_prometheus(counts: DataFrame, lasts: DataFrame) -> DataFrame:
    """Lines of user metrics: counters by name, then gauges by name. TYPE lines of counters bear the prefix, those of gauges do not."""
    one = lambda df, place, kind, prefix: df.select(
        F.lit(place).alias("place"), "name", F.explode(F.array(F.format_string(f"# TYPE {prefix}%s {kind}", "name"), F.format_string(f"{USER_PREFIX}%s %s", "name", F.col("value").cast("string")))).alias("value")
    )
    both = one(counts, 0, "counter", USER_PREFIX).union(one(lasts, 1, "gauge", ""))
    return both.orderBy("place", "name", ~F.col("value").startswith("#")).select("value")

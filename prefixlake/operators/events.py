"""What filters put out: a row for each effect, beside the routes and messages that go on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOPICS = ("prefix", "community", "asn", "origin", "peerdown", "custom", "log_entry", "print")


def emitted(rows: DataFrame, topic: str, when: Column, record: Column, name: str = "mqtt") -> DataFrame:
    """(seq, name, topic, ingress_id, record) of the rows where `when` holds; what a filter later rejects is put out all the same."""
    if topic not in TOPICS:
        raise ValueError(f"no topic {topic!r}")
    rows = rows.filter(F.coalesce(when, F.lit(False)))
    if topic == "peerdown":
        rows = rows.filter("msg_type = 'peer_down'")
    return rows.select("seq", F.lit(name).alias("name"), F.lit(topic).alias("topic"), "ingress_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def prefix_record(prefix: Column) -> Column:
    return F.struct(prefix.alias("prefix"))


def asn_record(asn: Column, prefix: Column) -> Column:
    return F.struct(asn.alias("asn"), prefix.alias("prefix"))


def custom_record(one, two) -> Column:
    return F.struct(F.lit(one).cast("bigint").alias("id"), F.lit(two).cast("bigint").alias("local"))


def log_entries(messages: DataFrame, prefix: Column | None = None) -> DataFrame:
    """LogEntry rows of UPDATEs (seq, ingress_id, received_at, peer_asn, hops, origin_asn, counts): all fields, null where unset."""
    count = lambda c: F.col(c).cast("bigint") if c in messages.columns else F.lit(None).cast("bigint")
    return messages.select(
        "seq", "ingress_id", F.unix_micros("received_at").alias("timestamp"), F.col("origin_asn").alias("origin_as"), F.col("peer_asn").alias("peer_as"), F.size("hops").cast("bigint").alias("as_path_hops"),
        count("conventional_reach").alias("conventional_reach"), count("conventional_unreach").alias("conventional_unreach"), count("mp_reach").alias("mp_reach"), count("mp_unreach").alias("mp_unreach"),
        (F.lit(None).cast("string") if prefix is None else prefix).alias("custom"),
    )


def with_ingress(events: DataFrame, ingress: DataFrame) -> DataFrame:
    """Each event with body, the JSON array [ingress, record]; an ingress that is unknown is null."""
    info = ingress.select("ingress_id", F.to_json(F.struct(*(c for c in ingress.columns if c != "ingress_id"))).alias("info"))
    return events.join(info, "ingress_id", "left").withColumn("body", F.concat(F.lit("["), F.coalesce("info", F.lit("null")), F.lit(","), "record", F.lit("]"))).drop("info")


def forwarded(updates: DataFrame) -> DataFrame:
    """Of the updates that reach a table, those that go on from it: accepted routes, output and ends of streams. Session and VRP updates end there."""
    return updates.filter(F.col("op").isin("announce", "withdraw", "output", "end_of_stream"))

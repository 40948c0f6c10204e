"""Sinks: files of JSON, short JSON or CSV lines, messages by topic, and nothing at all. All work on batches and in foreachBatch."""

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from prefixlake.operators.events import with_ingress


def custom_line(timestamp: Column, text: Column) -> Column:
    """A user's own text with the time before it, unless that is the epoch."""
    stamp = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.when(F.unix_micros(timestamp) != 0, F.concat(F.lit("["), F.regexp_replace(stamp, "Z$", "+00:00"), F.lit("] "), text)).otherwise(text)


def lines(records: DataFrame, kind: str = "json") -> DataFrame:
    """One text line (value) for each row of `records`.

    json keeps null fields, json-min leaves them out, csv has no header. A column `custom` (text) with a column `timestamp`
    takes the place of the record in any of them.
    """
    fields = [c for c in records.columns if c not in ("custom", "custom_at")]
    if kind == "json":
        line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    elif kind == "json-min":
        line = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    elif kind == "csv":
        line = F.to_csv(F.struct(*(F.col(c).cast("string").alias(c) for c in fields)))
    else:
        raise ValueError(f"no format {kind!r}")
    if "custom" in records.columns:
        line = F.when(F.col("custom").isNotNull(), custom_line(F.col("custom_at"), F.col("custom"))).otherwise(line)
    return records.select(line.alias("value"))


def write_file(records: DataFrame, path: str, kind: str = "json") -> None:
    """Lines of all rows below `path`; what was there goes."""
    lines(records, kind).write.mode("overwrite").text(path)


def stream_file(records: DataFrame, path: str, checkpoint: str, kind: str = "json", seconds: int = 1):
    """A running query that writes lines at least every `seconds`."""
    return lines(records, kind).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def messages(events: DataFrame, ingress: DataFrame, component: str = "mqtt", topic_template: str = "prefixlake/{id}") -> DataFrame:
    """(seq, topic, body) of those events whose name is the component's; {id} in the template becomes the event's topic."""
    named = with_ingress(events.filter(F.col("name") == component), ingress)
    return named.select("seq", F.replace(F.lit(topic_template), F.lit("{id}"), "topic").alias("topic"), "body")


def publish(rows: DataFrame, connect: Callable[[], Callable[[str, str], None]], tries: int = 5, wait: float = 5.0) -> None:
    """Send (topic, body) of all rows in order of seq within each partition: `connect` opens a connection in each task and gives its send function.

    If that raises (a lost connection, its own timeout), the task connects anew after `wait` seconds and sends the row again, `tries` times in all, and then fails.
    At least once: a task that is run again sends its rows again.
    """

    def send(part: Iterable[Row]) -> None:
        out = None
        for r in part:
            for left in range(tries - 1, -1, -1):
                try:
                    out = out or connect()
                    out(r["topic"], r["body"])
                    break
                except (OSError, TimeoutError):
                    out = None
                    if not left:
                        raise
                    time.sleep(wait)

    rows.sortWithinPartitions("seq").select("topic", "body").foreachPartition(send)


def discard(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def cli_lines(ingress: DataFrame) -> DataFrame:
    """Ingresses as lines with tabs, numbers to the right."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return ingress.orderBy("ingress_id").select(F.concat_ws("\t", F.format_string("%6s", F.col("ingress_id").cast("string")), text("ingress_type"), text("state"), text("remote_addr"), F.format_string("%10s", text("remote_asn")), text("name")).alias("value"))


def streamed(answer: DataFrame):
    """Rows of an answer one after the other, a partition at a time on the driver."""
    return answer.toLocalIterator()

"""Exact histogram of encoded lengths; suffix sums answer questions about every context limit."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.bpe import checked_path, encoder
from prefixlake.llm.shared import written
from prefixlake.llm.spans import Texts, slices

#: Lengths whose sums one task adds up.
RANGE = 4096


def length_histogram(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many rows of `docs` have each encoded length, whole texts, null as empty (length 0).

    Each task counts its own rows first, so a shuffle carries a row for each length and task and no length is hot.
    """
    path = checked_path(vocabulary)

    def count(batches):
        seen: Counter = Counter()
        for _, texts in slices(batches):
            seen.update(np.diff(encoder(path).encode(Texts(texts))[3]).tolist())
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(seen.keys(), pa.int64()), "n_docs": pa.array(seen.values(), pa.int64())})

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit, with documents of L or more tokens counted by suffix sums.

    docs_from, tokens_from: rows and tokens of documents with L tokens or more; truncated_total: tokens left when all
    documents are cut at L; lost_tokens: tokens that the cut drops; quantile: share of documents with at most L tokens.
    Sums run within ranges of RANGE lengths, and over the ranges, so that no task gets all lengths. Empty gives empty.
    """
    h = written(histogram.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")))
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    own = Window.partitionBy("range").orderBy(F.desc("n_tokens"))
    return (
        h.withColumn("d", F.sum("n_docs").over(own))
        .withColumn("t", F.sum("tokens").over(own))
        .join(F.broadcast(ranges), "range")
        .withColumn("docs_from", F.col("d") + F.col("d_after"))
        .withColumn("tokens_from", F.col("t") + F.col("t_after"))
        .withColumn("truncated_total", F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"))
        .withColumn("lost_tokens", F.col("all_tokens") - F.col("truncated_total"))
        .withColumn("quantile", (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs"))
        .select("n_tokens", "n_docs", "docs_from", "tokens_from", "truncated_total", "lost_tokens", "quantile")
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_over) for any context limits, also ones that no document has as its length; each once.

    A limit L has the suffix sums of the least length over L that occurs: all tokens less theirs, and L for each of their
    documents. Limits are asked of a table of sums, which is joined by range of lengths; without documents the answers are 0.
    """
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    h = written(context_limits(histogram).select("n_tokens", "n_docs", "docs_from", "tokens_from", "truncated_total", "lost_tokens"))
    whole = h.agg((F.max(F.col("truncated_total") + F.col("lost_tokens"))).alias("all_tokens"))
    # The limit itself takes part as a length without documents; the next length above it has the sums.
    rows = h.select("n_tokens", "docs_from", "tokens_from", F.lit(0).alias("asked")).unionByName(asked.select(F.col("context_limit").alias("n_tokens"), F.lit(None).cast("long").alias("docs_from"), F.lit(None).cast("long").alias("tokens_from"), F.lit(1).alias("asked")))
    rows = rows.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    sums = F.when(F.col("asked") == 0, F.struct("docs_from", "tokens_from"))
    above = Window.partitionBy("range").orderBy("n_tokens", "asked").rowsBetween(1, Window.unboundedFollowing)
    own = rows.withColumn("next", F.first(sums, ignorenulls=True).over(above)).filter("asked = 1")
    firsts = h.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).groupBy("range").agg(F.min_by(F.struct("docs_from", "tokens_from"), "n_tokens").alias("first"))
    reach = asked.select(F.floor(F.col("context_limit") / RANGE).alias("range")).distinct().select("range", F.lit(None).alias("first"))
    later = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.unionByName(reach, allowMissingColumns=True).groupBy("range").agg(F.first("first", ignorenulls=True).alias("first"))
    firsts = firsts.select("range", F.first("first", ignorenulls=True).over(later).alias("after"))
    found = own.join(F.broadcast(firsts), "range").withColumn("sums", F.coalesce("next", "after")).join(F.broadcast(whole))
    docs, tokens = F.coalesce(F.col("sums.docs_from"), F.lit(0)), F.coalesce(F.col("sums.tokens_from"), F.lit(0))
    return found.select(F.col("n_tokens").alias("context_limit"), (F.coalesce("all_tokens", F.lit(0)) - tokens + docs * F.col("n_tokens")).alias("truncated_total"), docs.alias("docs_over"))

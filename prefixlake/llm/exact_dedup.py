"""Exact dedup against a persistent digest index that is bucketed and sorted by hash."""

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.llm.shared import join_counted, lowered, shared_folder, without, written


def text_digest(text):
    """SHA-256 (lowercase hex) of the text with A to Z in lower case; null counts as empty."""
    return F.sha2(lowered(text).cast("binary"), 256)


class DigestIndex:
    """Digests of all texts so far: one row each, in a table bucketed and sorted by digest, at a path that outlives the session.

    Opening a path that holds an index takes it up again; `buckets` (default: the session's shuffle partitions) counts
    for a new one only.
    """

    COLUMNS = "digest STRING, keep_id BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        buckets = self._saved_buckets() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/digests'"
        )
        self.buckets = buckets

    def _saved_buckets(self) -> int | None:
        """The number of buckets is kept beside the digests, as a one-row table, when the index gets its first rows."""
        spark = self.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/buckets")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema("buckets INT").parquet(f"{self.path}/buckets").first()[0]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, digests: DataFrame, batch: str) -> None:
        """Append those rows of (digest, keep_id), one for each digest, whose digest the index lacks: a sort-merge anti-join.

        Only the new rows move; the index is read in its buckets. Appending a batch again adds nothing.
        """
        new = digests.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        rows = new.select("digest", "keep_id", F.lit(batch).alias("batch"))
        if self._saved_buckets() is None:
            self.spark.range(1).select(F.lit(self.buckets).cast("int").alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/buckets")
        rows.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256, and `known` (the index had the text before this batch).

    Texts are equal when they are identical after lower-casing A to Z; a null text is an empty one. In a batch the row with
    the largest id stays (null ids are least; of rows that repeat an id and a text, any one); if an earlier batch had the
    text, no row stays and keep_id is that batch's. Only digests and ids move; a text that a third of the rows share
    is counted before the shuffle and joined by broadcast. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    if index is None:
        index = DigestIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    batch = batch or uuid.uuid4().hex
    staged = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    )
    top = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("rank"), "row", "doc_id"))
    groups = written(staged.groupBy("digest").agg(top.alias("top"), F.count(F.lit(1)).alias("group_size")).select("digest", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row")))
    index.append_new(groups, batch)
    before = index.rows().select("digest", F.col("keep_id").alias("indexed_id"), (F.col("batch") != batch).alias("known"))
    groups = written(groups.join(before.hint("merge"), "digest"))
    return join_counted(staged, groups, "digest", "group_size").select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("known"), F.col("indexed_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size",
        (~F.col("known") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "known",
    )


def without_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns as they are. Of rows that repeat an id and a text one stays.

    The dropped (id, digest) are taken away by an anti-join, in which only rows move whose hash is among those of the dropped
    ones (none while they are few enough for Spark to broadcast them); only rows that repeat an id and a text are grouped.
    """
    id_of = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    judged = deduplicate(docs, index, batch, id_col, text_col).groupBy(id_of.alias("__id"), F.col("text_sha256").alias("__digest"))
    judged = written(judged.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("NOT kept OR n > 1"))
    tagged = docs.withColumn("__id", id_of).withColumn("__digest", text_digest(F.col(text_col)))
    key = ["__id", "__digest"]
    out = without(tagged, judged.select(*key), key).drop(*key)
    twice = judged.filter("kept").select(*key)
    if twice.limit(1).count():
        out = out.unionByName(tagged.join(twice, key, "left_semi").dropDuplicates(key).drop(*key))
    return out.select(*docs.columns)

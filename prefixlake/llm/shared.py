"""Tables in the cluster's shared folder, and joins that survive hot keys."""

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one row in so many gets the broadcast side of a join; so there are at most this many such keys.
HEAVY_SHARE = 1000
#: Bits of the map of hashes by which rows are told apart before a join; 2 MB whatever the input.
MAP_BITS = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    Where the cluster names none, as in tests on one machine, the warehouse is used, which must be shared too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/prefixlake-{spark.sparkContext.applicationId}"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows of `df` as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables that `written` left; call it when their readers are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """All that operators leave behind in the shared folder and the session's tables of blocks goes at the end of the block: read or write results within it."""
    try:
        yield
    finally:
        drop_scratch(spark)
        for t in spark.catalog.listTables(pattern="word_blocks_*"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def join_counted(left: DataFrame, counted: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of `left` with `counted`, which has each key of `left` once and in `rows` the number of its rows there.

    Keys with over 1/HEAVY_SHARE of all rows (so at most HEAVY_SHARE of them) are broadcast and their rows stay where
    they are; the others meet in a shuffled join in which no key is large. Both inputs are read twice: pass tables.
    """
    total, most = counted.agg(F.sum(rows), F.max(rows)).first()
    cut = max((total or 0) // HEAVY_SHARE, 1000)
    if (most or 0) <= cut:
        return left.join(counted, key)
    heavy = counted.filter(F.col(rows) > cut)
    light = counted.filter(F.col(rows) <= cut)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return left.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


def split_by(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of `rows` that may have the values of a row of `keys` in `columns`, and those that surely have not.

    Told by a bitmap of the keys' hashes, MAP_BITS long, which is broadcast: so only the first, with their texts, need move in
    a join with `keys`. The columns have the same types in both; null is a value. Both inputs are read twice: pass tables.
    """
    mark = F.pmod(F.xxhash64(*columns), F.lit(MAP_BITS)) + 1
    bits = written(keys.groupBy(F.bitmap_bucket_number(mark).alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("__bits")))
    place = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("__part", F.bitmap_bucket_number(mark)).join(F.broadcast(bits), "__part", "left")
    hit = F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))
    return marked.filter(hit).select(*rows.columns), marked.filter(~hit).select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of `rows` whose `columns` are no row of `keys`, a table, which has these columns only, of the same types; nulls are equal."""
    may, rest = split_by(rows, keys, columns)
    named = keys.select(*(F.col(c).alias(f"__{c}") for c in columns))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    return may.join(named, same, "left_anti").unionByName(rest)


def lowered(text: Column) -> Column:
    """A to Z in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

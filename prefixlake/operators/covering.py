"""Joins of prefixes with what covers them, as equi-joins over exploded ancestors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.prefix import ancestors


def covering_join(inner: DataFrame, outer: DataFrame, how: str = "inner", strict: bool = False, lengths: list[int] | None = None) -> DataFrame:
    """Each row of `inner` (afi, plen, bits, ...) with each row of `outer` that covers it; outer's columns get the prefix outer_.

    A condition on starts would be a nested loop over both sides; here each inner row is exploded into its ancestors of the
    lengths that `outer` has, and met by equality. The lengths, 129 at most, are collected in the same plan and sent to all tasks
    in a row for each family, unless they are given. `strict` leaves out the prefix itself. how: inner, left, left_semi.
    """
    named = outer.select(*(F.col(c).alias(f"outer_{c}") for c in outer.columns))
    if how == "left":
        row = inner.withColumn("__row", F.monotonically_increasing_id())
        found = covering_join(row, outer, "inner", strict, lengths).select("__row", *named.columns)
        return row.join(found, "__row", "left").drop("__row")
    if lengths is None:
        held = outer.groupBy(F.col("afi").alias("__afi")).agg(F.collect_set(F.col("plen").cast("int")).alias("__lengths"))
        steps = inner.join(F.broadcast(held), F.col("afi") == F.col("__afi")).withColumn("__up", F.explode(ancestors(F.col("bits"), F.col("plen"), F.col("__lengths")))).drop("__afi", "__lengths")
    else:
        steps = inner.withColumn("__up", F.explode(ancestors(F.col("bits"), F.col("plen"), F.array(*(F.lit(int(n)) for n in lengths)).cast("array<int>"))))
    match = (F.col("__up") == F.col("outer_bits")) & (F.col("afi") == F.col("outer_afi"))
    if strict:
        match = match & (F.length("__up") < F.col("plen"))
    joined = steps.join(named, match, "left_semi" if how == "left_semi" else "inner").drop("__up")
    return joined.dropDuplicates() if how == "left_semi" else joined


def exact(df: DataFrame, afi: int, bits: str) -> DataFrame:
    return df.filter((F.col("afi") == afi) & (F.col("bits") == bits))


def more_specifics(df: DataFrame, afi: int, bits: str) -> DataFrame:
    """Strict descendants; the literal start is pushed to the scan."""
    return df.filter((F.col("afi") == afi) & F.col("bits").startswith(bits) & (F.col("plen") > len(bits)))


def less_specifics(df: DataFrame, afi: int, bits: str) -> DataFrame:
    """Strict ancestors, as a list of literals, which is pushed to the scan too."""
    return df.filter((F.col("afi") == afi) & F.col("bits").isin([bits[:n] for n in range(len(bits))] or [None]))

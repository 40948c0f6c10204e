"""Named lists of ASNs and prefixes, and membership in them."""

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.functions.prefix import parse_prefix
from prefixlake.operators.covering import covering_join

#: Lists of a kind; more are left out with a warning.
CAPACITY = 64


def _texts(spark: SparkSession, lists: dict[str, str]) -> DataFrame:
    if len(lists) > CAPACITY:
        warnings.warn(f"only the first {CAPACITY} lists count", stacklevel=3)
    rows = list(lists.items())[:CAPACITY]
    return spark.createDataFrame(rows, "name string, body string").select("name", F.explode(F.split(F.trim("body"), r"\s+")).alias("token"))


def asn_lists(spark: SparkSession, lists: dict[str, str]) -> DataFrame:
    """(name, asn) from texts of ASNs between white space, with or without AS before; what is no ASN is left out."""
    asn = F.regexp_replace("token", "^[Aa][Ss]", "").try_cast("bigint")
    return _texts(spark, lists).select("name", asn.alias("asn")).filter("asn BETWEEN 0 AND 4294967295").distinct()


def prefix_lists(spark: SparkSession, lists: dict[str, str]) -> DataFrame:
    """(name, afi, plen, bits) from texts of prefixes between white space; what is no prefix is left out."""
    parsed = _texts(spark, lists).filter(F.col("token").contains("/")).select("name", parse_prefix(F.col("token")).alias("p")).filter("p IS NOT NULL")
    return parsed.select("name", "p.*").distinct()


def with_asn_in(rows: DataFrame, lists: DataFrame, name: str, asn_col: str = "origin_asn") -> DataFrame:
    """Rows whose ASN is in a list; a null ASN and a list that doesn't exist have no rows."""
    return rows.join(lists.filter(F.col("name") == name).select(F.col("asn").alias(asn_col)), asn_col, "left_semi")


def with_prefix_in(rows: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """Rows whose prefix itself is in a list."""
    return rows.join(lists.filter(F.col("name") == name).select("afi", "plen", "bits"), ["afi", "plen", "bits"], "left_semi")


def with_prefix_covered(rows: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """Rows whose prefix is in a list or below one of its prefixes."""
    outer = lists.filter(F.col("name") == name).select("afi", "plen", "bits")
    covered = covering_join(rows.select("afi", "plen", "bits").distinct(), outer, "left_semi")
    return rows.join(covered, ["afi", "plen", "bits"], "left_semi")

"""Comparisons and overviews of peers and routers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of what a peer's routes show.
COMMUNITIES, EXT_COMMUNITIES, LARGE_COMMUNITIES, OTC, ROV_INVALID = 1, 2, 4, 8, 16


def route_counts(rib: DataFrame) -> DataFrame:
    """(ingress_id, n_prefixes): distinct prefixes of both families; default routes are not counted."""
    rows = rib.filter("plen > 0").select("ingress_id", "afi", "bits").distinct()
    return rows.groupBy("ingress_id").agg(F.count(F.lit(1)).alias("n_prefixes"))


def observed_bits(rib: DataFrame) -> DataFrame:
    """(ingress_id, observed): what any of its routes carries, as a bit mask."""
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    mask = flag(some("communities"), COMMUNITIES).bitwiseOR(flag(some("large_communities"), LARGE_COMMUNITIES)).bitwiseOR(flag(F.col("otc").isNotNull(), OTC))
    if "ext_communities" in rib.columns:
        mask = mask.bitwiseOR(flag(some("ext_communities"), EXT_COMMUNITIES))
    if "rov" in rib.columns:
        mask = mask.bitwiseOR(flag(F.col("rov") == "invalid", ROV_INVALID))
    return rib.filter("plen > 0").groupBy("ingress_id").agg(F.bit_or(mask).alias("observed"))


def peer_overview(rib: DataFrame, ingress: DataFrame) -> DataFrame:
    """All peers with their counts and masks; peers without routes have 0. ingress_id alone decides the order, being unique."""
    rows = ingress.join(route_counts(rib), "ingress_id", "left").join(observed_bits(rib), "ingress_id", "left")
    return rows.fillna(0, ["n_prefixes", "observed"])


def diff(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of two frames with side: only_a, only_b or both. One shuffle of what is distinct on each task."""
    rows = left.select(*on, F.lit(1).alias("side")).unionByName(right.select(*on, F.lit(2).alias("side")))
    sides = rows.groupBy(*on).agg(F.bit_or("side").alias("side"))
    return sides.withColumn("side", F.when(F.col("side") == 1, "only_a").when(F.col("side") == 2, "only_b").otherwise("both"))


def routes_diff(rib: DataFrame, a: int, b: int) -> DataFrame:
    """Prefixes, default routes left out, of two ingresses."""
    rows = rib.filter("plen > 0")
    return diff(rows.filter(F.col("ingress_id") == a), rows.filter(F.col("ingress_id") == b), ["afi", "plen", "bits"])


def peers_diff(ingress: DataFrame, a: int, b: int) -> DataFrame:
    """Peers (ASN, address) of two BMP routers."""
    of = lambda r: ingress.filter(F.col("parent_ingress") == r)
    return diff(of(a), of(b), ["remote_asn", "remote_addr"])


def next_hops_diff(local: Column, remote: Column) -> tuple[Column, Column, Column]:
    """Next-hop labels of the local end only, the remote end only, and both."""
    return F.array_except(local, remote), F.array_except(remote, local), F.array_intersect(local, remote)


def without_repeats(rows: DataFrame, label: str, group: list[str], order: list[str]) -> DataFrame:
    """`rows` with shown_<label>: null where it is the same as in the row before, within `group` and by `order`."""
    before = F.lag(label).over(Window.partitionBy(*group).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    return rows.withColumn(f"shown_{label}", F.when(first | ~F.col(label).eqNullSafe(before), F.col(label)))


def in_order(df: DataFrame, within: list[str], head: list, order: list) -> DataFrame:
    """`df` with place, from 1, in the order of `head` and then `order` within each of `within`.

    Rows are numbered within each value of `head` (columns with few values that lead the order, as a family and the first bits
    of a prefix), and shifted by how many stand before it: no task gets a whole list unless its head is one value.
    """
    names = [f"__h{k}" for k in range(len(head))]
    rows = df.withColumns(dict(zip(names, head, strict=True)))
    sizes = rows.groupBy(*within, *names).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*within).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = rows.withColumn("place", F.row_number().over(Window.partitionBy(*within, *names).orderBy(*order)))
    return own.join(before, [*within, *names]).withColumn("place", (F.col("place") + F.col("__before")).cast("bigint")).drop("__before", *names)

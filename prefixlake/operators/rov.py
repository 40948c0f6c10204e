"""Route origin validation (RFC 6811) and its upkeep when VRPs change."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.prefix import is_multicast
from prefixlake.operators.covering import covering_join


def current_vrps(vrp_log: DataFrame, legacy_reset: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """VRPs (afi, plen, bits, asn, maxlen) in force after a log of (seq, action, kind, ...): kind is reset for rows of a full list, else delta.

    The last action for each VRP counts. A full list (rows of one seq) replaces all before it, unless `legacy_reset`, by which
    it only adds. `by` names columns of the source (a server, a file): each has its own lists and numbers, and what any of them
    has is in force.
    """
    key = [*by, "afi", "plen", "bits", "asn", "maxlen"]
    rows = vrp_log
    if not legacy_reset:
        last = vrp_log.groupBy(*by).agg(F.max(F.when(F.col("kind") == "reset", F.col("seq"))).alias("reset_seq"))
        rows = vrp_log.join(last, list(by)) if by else vrp_log.join(F.broadcast(last))
        rows = rows.filter(F.col("seq") >= F.coalesce("reset_seq", "seq")).drop("reset_seq")
    held = rows.groupBy(*key).agg(F.max_by("action", "seq").alias("action")).filter("action = 'announce'").drop("action")
    return held.drop(*by).distinct() if by else held


def validate(routes: DataFrame, vrps: DataFrame) -> DataFrame:
    """Distinct (afi, plen, bits, origin_asn) of `routes` with rov: valid, invalid, notFound or notChecked (no origin, or multicast).

    Covered: some VRP covers the prefix. Valid: one of those has the route's origin and allows its length. Each distinct prefix
    and origin is met once with the VRPs by equality on its ancestors, and both answers are partial maxima.
    """
    return _validated(routes, {"rov": vrps})


def _validated(routes: DataFrame, by_list: dict[str, DataFrame]) -> DataFrame:
    """`validate` against several lists of VRPs in one join; each status is in the column that names its list."""
    checked = routes.select("afi", "plen", "bits", "origin_asn").distinct()
    vrps = None
    for name, held in by_list.items():
        held = held.select("afi", "plen", "bits", "asn", "maxlen", F.lit(name).alias("list"))
        vrps = held if vrps is None else vrps.unionByName(held)
    facts = covering_join(checked.filter("origin_asn IS NOT NULL"), vrps)
    valid = (F.col("outer_asn") == F.col("origin_asn")) & (F.col("plen") <= F.col("outer_maxlen"))
    found = facts.groupBy("afi", "plen", "bits", "origin_asn").agg(*(F.max(F.when(F.col("outer_list") == n, valid)).alias(f"__{n}") for n in by_list))
    joined = checked.withColumn("__origin", F.coalesce("origin_asn", F.lit(-1))).join(found.withColumnRenamed("origin_asn", "__origin"), ["afi", "plen", "bits", "__origin"], "left")
    none = F.col("origin_asn").isNull() | is_multicast(F.col("afi"), F.col("bits"))
    status = lambda c: F.when(none, "notChecked").when(F.col(c).isNull(), "notFound").when(F.col(c), "valid").otherwise("invalid")
    return joined.select("afi", "plen", "bits", "origin_asn", *(status(f"__{n}").alias(n) for n in by_list))


def with_rov(rib: DataFrame, vrps: DataFrame) -> DataFrame:
    """`rib` with rov on every row; multicast tables are not checked."""
    unicast = rib.filter("safi = 'unicast'")
    checked = validate(unicast, vrps).withColumn("__origin", F.coalesce("origin_asn", F.lit(-1))).drop("origin_asn")
    joined = rib.withColumn("__origin", F.coalesce("origin_asn", F.lit(-1))).join(checked, ["afi", "plen", "bits", "__origin"], "left").drop("__origin")
    return joined.withColumn("rov", F.when(F.col("safi") == "unicast", F.col("rov")).otherwise("notChecked"))


def affected(rib: DataFrame, changed: DataFrame) -> DataFrame:
    """Routes that a change of VRPs (afi, plen, bits) touches: unicast, not withdrawn, with an origin, at or below a changed prefix."""
    status = "status" if "status" in rib.columns else "route_status"
    rows = rib.filter((F.col("safi") == "unicast") & (F.col(status) != "withdrawn") & F.col("origin_asn").isNotNull())
    prefixes = changed.select("afi", "plen", "bits").distinct()
    touched = covering_join(rows.select("afi", "plen", "bits").distinct(), prefixes, "left_semi")
    return rows.join(touched, ["afi", "plen", "bits"], "left_semi")


def status_updates(rib: DataFrame, before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """A row for each affected route, changed or not: previous_status, current_status, has_changed."""
    rows = affected(rib, changed)
    both = _validated(rows, {"previous_status": before, "current_status": after})
    return rows.join(both, ["afi", "plen", "bits", "origin_asn"]).withColumn("has_changed", F.col("previous_status") != F.col("current_status"))


def current_set(log: DataFrame, key: list[str]) -> DataFrame:
    """Router keys, ASPAs and the like: rows of `log` (seq, action, key...) whose last action is an announcement."""
    return log.groupBy(*key).agg(F.max_by("action", "seq").alias("action")).filter("action = 'announce'").drop("action")


def duplicate_actions(log: DataFrame, key: list[str]) -> DataFrame:
    """Announcements of what was there and withdrawals of what was not: (key..., seq, action)."""
    from pyspark.sql import Window

    before = F.lag("action").over(Window.partitionBy(*key).orderBy("seq"))
    return log.withColumn("__before", F.coalesce(before, F.lit("withdraw"))).filter("action = __before").drop("__before")

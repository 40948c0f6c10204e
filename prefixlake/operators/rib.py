"""The routing table as a fold over the ordered log of updates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("safi", "afi", "plen", "bits", "ingress_id")
NOT_ATTRIBUTES = {"seq", "op", "received_at", "family_afi", "family_safi", *KEY}


def fold(log: DataFrame, keep_unannounced: bool = False) -> DataFrame:
    """One row for each (prefix, ingress): last_seq, status and the attributes of its last announcement.

    The update with the greatest seq wins; a withdrawal changes the status only. Keys that were never announced are left
    out unless asked for. One aggregation with partial sums on each task: a hot key costs nothing.
    """
    attributes = [c for c in log.columns if c not in NOT_ATTRIBUTES]
    announced = F.when(F.col("op") == "announce", F.col("seq"))
    rows = log.filter(F.col("op").isin("announce", "withdraw")).groupBy(*KEY)
    out = rows.agg(
        F.max("seq").alias("last_seq"),
        F.max_by("op", "seq").alias("last_op"),
        F.max(announced).alias("announced_seq"),
        F.max_by(F.struct(*attributes), announced).alias("last"),
    ).select(*KEY, "last_seq", "announced_seq", F.when(F.col("last_op") == "announce", "active").otherwise("withdrawn").alias("route_status"), "last.*")
    return out if keep_unannounced else out.filter("announced_seq IS NOT NULL")


def sessions(log: DataFrame) -> DataFrame:
    """(ingress_id, family_afi, family_safi, down): the last control update of each ingress and family; a null family is all four."""
    control = log.filter(F.col("op").isin("withdraw_ingress", "reappear"))
    return control.groupBy("ingress_id", "family_afi", "family_safi").agg(F.max("seq").alias("control_seq"), (F.max_by("op", "seq") == "withdraw_ingress").alias("down"))


def with_sessions(rib: DataFrame, log: DataFrame) -> DataFrame:
    """`rib` with status: withdrawn while the ingress (or its family) is, else the route's own. An ingress that comes back brings its routes back.

    Of a control update for all families and one for the route's family, the later counts. The table of sessions has a row for
    each ingress and family, not for each route.
    """
    down = sessions(log)
    by_all = down.filter("family_afi IS NULL AND family_safi IS NULL").select("ingress_id", F.col("control_seq").alias("all_seq"), F.col("down").alias("all_down"))
    by_family = down.filter("family_afi IS NOT NULL AND family_safi IS NOT NULL").select("ingress_id", F.col("family_afi").alias("afi"), F.col("family_safi").alias("safi"), F.col("control_seq").alias("own_seq"), F.col("down").alias("own_down"))
    joined = rib.join(by_all, "ingress_id", "left").join(by_family, ["ingress_id", "afi", "safi"], "left")
    later = F.coalesce(F.col("own_seq"), F.lit(-1)) > F.coalesce(F.col("all_seq"), F.lit(-1))
    is_down = F.coalesce(F.when(later, F.col("own_down")).otherwise(F.col("all_down")), F.lit(False))
    return joined.withColumn("session_down", is_down).withColumn("status", F.when(is_down, "withdrawn").otherwise(F.col("route_status"))).drop("all_seq", "all_down", "own_seq", "own_down")


def active(rib: DataFrame) -> DataFrame:
    return rib.filter((F.col("status") if "status" in rib.columns else F.col("route_status")) == "active")


def exploded(updates: DataFrame) -> DataFrame:
    """UPDATEs (seq, announced, withdrawn, attributes...) as log rows, announcements before withdrawals, so that a prefix in both ends withdrawn.

    seq becomes 2 * seq for announcements and 2 * seq + 1 for withdrawals, whose attributes are null. announced and withdrawn
    are arrays of struct(safi, afi, plen, bits); families other than the four known are dropped.
    """
    rest = [c for c in updates.columns if c not in ("announced", "withdrawn", "seq", "ingress_id")]
    one = lambda c, extra: updates.select((F.col("seq") * 2 + extra).alias("seq"), "ingress_id", *rest, F.explode(c).alias("n"))
    announced = one("announced", 0).withColumn("op", F.lit("announce"))
    withdrawn = one("withdrawn", 1).withColumn("op", F.lit("withdraw"))
    withdrawn = withdrawn.withColumns({c: F.lit(None).cast(t) for c, t in updates.select(*rest).dtypes if c != "received_at"})
    rows = announced.unionByName(withdrawn).select("seq", "ingress_id", "op", *rest, "n.*")
    return rows.filter(F.col("safi").isin("unicast", "multicast") & F.col("afi").isin(1, 2))


def attribute_projection(attributes: Column, codes: list[int] | None = None) -> Column:
    """Path attributes (array of struct with code) for output: never code 15, and only `codes` if given."""
    return F.filter(attributes, lambda a: (a["code"] != 15) & (F.lit(True) if codes is None else a["code"].isin(codes)))

"""Search of the routing table by prefix, with filters: what the query API answers."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.predicates import Filter, all_of, condition, contains_community, contains_large_community, yes
from prefixlake.operators.rov import with_rov


@dataclass(frozen=True)
class QueryFilter:
    """All that are given hold together. rib_type, peer_asn and peer_address keep routes whose ingress is unknown, and drop those whose ingress lacks the field."""

    ingress_id: int | None = None
    rib_type: str | None = None
    peer_asn: int | None = None
    peer_address: str | None = None
    function: str | Filter | None = None
    rov_status: str | None = None
    otc: int | None = None
    community: int | None = None
    large_community: tuple[int, int, int] | None = None
    origin_asn: int | None = None


def passes(routes: DataFrame, flt: QueryFilter) -> Column:
    """Does a row of `routes`, already joined with their ingress (with_ingress), hold all that the filter asks but for rov_status? Never null."""
    tests: list[Column] = [condition(routes, flt.function)]
    for value, column in ((flt.ingress_id, "ingress_id"), (flt.otc, "otc"), (flt.origin_asn, "origin_asn")):
        if value is not None:
            tests.append(yes(F.col(column) == value))
    for value, column in ((flt.rib_type, "peer_rib_type"), (flt.peer_asn, "remote_asn"), (flt.peer_address, "remote_addr")):
        if value is not None:
            tests.append(~F.col("ingress_known") | yes(F.col(column) == value))
    if flt.large_community is not None:
        tests.append(contains_large_community(F.col("large_communities"), flt.large_community))
    if flt.community is not None:
        tests.append(contains_community(F.col("communities"), flt.community))
    return all_of(*tests)


def filtered(routes: DataFrame, flt: QueryFilter) -> DataFrame:
    """`routes` already joined with their ingress (with_ingress), less what the filter drops; for a rov_status they need the column rov."""
    kept = routes.filter(passes(routes, flt))
    return kept if flt.rov_status is None else kept.filter(yes(F.col("rov") == flt.rov_status))


def with_ingress(routes: DataFrame, ingress: DataFrame) -> DataFrame:
    """Each route with its ingress's columns, null if it is unknown, and ingress_known."""
    return routes.join(ingress.withColumn("ingress_known", F.lit(True)), "ingress_id", "left").withColumn("ingress_known", F.coalesce("ingress_known", F.lit(False)))


def with_parent_router(routes: DataFrame, ingress: DataFrame) -> DataFrame:
    """Each route with router_id and router_name of its ingress's parent, if that is a BMP router."""
    parents = ingress.filter("ingress_type = 'bmp'").select(F.col("ingress_id").alias("router_id"), F.col("name").alias("router_name"))
    links = ingress.select("ingress_id", "parent_ingress")
    return routes.join(links, "ingress_id", "left").join(parents, F.col("parent_ingress") == F.col("router_id"), "left")


def search_routes(rib: DataFrame, ingress: DataFrame, afi: int, bits: str, flt: QueryFilter | None = None, include: tuple[str, ...] = (), vrps: DataFrame | None = None) -> DataFrame:
    """Matches of a prefix with column section: data (the prefix itself), moreSpecifics and lessSpecifics if included.

    Withdrawn routes never match. The unicast table answers; the multicast one only if that has nothing at all. The prefix's
    own node stays in the answer without routes (null ingress_id) when nothing of it is left; other prefixes without routes go.
    With `vrps`, the routes that the other filters leave are validated and get rov; else a rov_status needs that column.
    The table is read twice: for the answer, and for one row that says whether any unicast route matches and the node has a route.
    """
    if unknown := set(include) - {"moreSpecifics", "lessSpecifics"}:
        raise ValueError(f"cannot include {sorted(unknown)}")
    flt = flt or QueryFilter()
    status = "status" if "status" in rib.columns else "route_status"
    sections = {"data": F.col("bits") == bits}
    if "moreSpecifics" in include:
        sections["moreSpecifics"] = F.col("bits").startswith(bits) & (F.col("plen") > len(bits))
    if "lessSpecifics" in include:
        sections["lessSpecifics"] = F.col("bits").isin([bits[:n] for n in range(len(bits))] or [None])
    wanted, section = F.lit(False), F.lit(None).cast("string")
    for name, test in sections.items():
        wanted, section = wanted | test, F.when(test, name).otherwise(section)
    found = rib.filter((F.col(status) != "withdrawn") & (F.col("afi") == afi) & wanted).withColumn("section", section)
    found = with_ingress(found, ingress)
    unicast, is_data = F.col("safi") == "unicast", F.col("section") == "data"
    if vrps is None or flt.rov_status is None:
        kept = found if vrps is None else with_rov(found, vrps)
        holds = passes(kept, flt) if flt.rov_status is None else passes(kept, flt) & yes(F.col("rov") == flt.rov_status)
        flags = found.agg(F.max(unicast).alias("__any"), F.max(unicast & is_data & holds).alias("__one"), F.max(~unicast & is_data & holds).alias("__other"))
        kept = kept.filter(holds)
    else:
        kept = filtered(with_rov(found.filter(passes(found, flt)), vrps), flt)
        seen = found.agg(F.max(unicast).alias("__any"))
        flags = seen.join(F.broadcast(kept.agg(F.max(unicast & is_data).alias("__one"), F.max(~unicast & is_data).alias("__other"))))
    kept = kept.join(F.broadcast(flags.select("__any")), how="left").filter(unicast | ~F.coalesce("__any", F.lit(False))).drop("__any")
    names = ["section", "afi", "bits", "plen"]
    kept = kept.select(*names, *(c for c in kept.columns if c not in names))
    answered = F.when(F.col("__any"), F.col("__one")).otherwise(F.col("__other"))
    own = {"section": F.lit("data"), "afi": F.lit(afi), "bits": F.lit(bits), "plen": F.lit(len(bits))}
    node = flags.filter(~F.coalesce(answered, F.lit(False))).select(*(own.get(c, F.lit(None)).cast(t).alias(c) for c, t in kept.dtypes))
    return kept.unionByName(node)


def all_routes(rib: DataFrame, ingress: DataFrame, afi: int, flt: QueryFilter | None = None) -> DataFrame:
    """The whole family: the default route is data, all else moreSpecifics."""
    return search_routes(rib, ingress, afi, "", flt, ("moreSpecifics",))


def route_json(rows: DataFrame) -> Column:
    """A route as clients get it: ingress, origin, rov (if the column is there) below rpki, and the path attributes that it has, by name."""
    held = set(rows.columns)
    attributes = {"asPath": "hops", "nextHop": "next_hop", "communities": "communities", "largeCommunities": "large_communities", "otc": "otc"}
    inside = [F.col(c).alias(n) for n, c in attributes.items() if c in held]
    rpki = F.struct((F.col("rov") if "rov" in held else F.lit("notChecked")).alias("rov"))
    return F.struct("ingress_id", "origin_asn", rpki.alias("rpki"), F.struct(*inside).alias("pathAttributes"))


def error_json(status: Column, message: Column) -> Column:
    """What a client gets instead of an answer: no data, and the error's status and text."""
    return F.to_json(F.struct(F.lit(None).cast("string").alias("data"), F.struct(status.alias("status"), message.alias("message")).alias("error")), {"ignoreNullFields": "false"})


def result_json(found: DataFrame, prefix: Column, route: Column) -> DataFrame:
    """One JSON text (column value): {meta, data: {nlri, routes}, included: {section: [{nlri, routes}]}}, prefixes in tree order.

    Gathers the whole answer in one row, as the API does: for answers that a client reads, not for exports.
    """
    rows = found.withColumn("__nlri", prefix).withColumn("__route", F.when(F.col("ingress_id").isNotNull(), route))
    nodes = rows.groupBy("section", "afi", "bits").agg(F.first("__nlri").alias("nlri"), F.sort_array(F.collect_list("__route")).alias("routes"))
    listed = nodes.groupBy("section").agg(F.transform(F.sort_array(F.collect_list(F.struct("afi", "bits", "nlri", "routes"))), lambda n: F.struct(n["nlri"].alias("nlri"), n["routes"].alias("routes"))).alias("nodes"))
    pick = lambda s: F.first(F.when(F.col("section") == s, F.col("nodes")), ignorenulls=True)
    whole = listed.agg(pick("data").alias("data"), pick("moreSpecifics").alias("more"), pick("lessSpecifics").alias("less"))
    answer = F.struct(F.lit(None).cast("string").alias("meta"), F.get("data", F.lit(0)).alias("data"), F.struct(F.col("more").alias("moreSpecifics"), F.col("less").alias("lessSpecifics")).alias("included"))
    return whole.select(F.to_json(answer, {"ignoreNullFields": "false"}).alias("value"))

"""The register of ingresses: merging, finding and grouping of sessions and routers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions.peers import rib_type_order
from prefixlake.functions.predicates import yes
from prefixlake.operators.covering import covering_join

MANDATORY = ("parent_ingress", "remote_addr", "remote_asn")
OPTIONAL = ("peer_rib_type", "peer_type", "distinguisher", "vrf_name")
NEIGHBOUR_ORDER = ("bgpViaBmp", "bgp", "mrt")


def merged(updates: DataFrame) -> DataFrame:
    """One row for each ingress_id of an update log (seq, ingress_id, fields): of each field the last value that is not null."""
    fields = [c for c in updates.columns if c not in ("seq", "ingress_id")]
    return updates.groupBy("ingress_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields))


def search(ingress: DataFrame, ingress_type: str | None = None, state: str | None = None, rib_type: str | None = None, peer_address: str | None = None, peer_asn: int | None = None) -> DataFrame:
    """Ingresses for which all given fields hold; a null field equals nothing."""
    wanted = {"ingress_type": ingress_type, "state": state, "peer_rib_type": rib_type, "remote_addr": peer_address, "remote_asn": peer_asn}
    for column, value in wanted.items():
        if value is not None:
            ingress = ingress.filter(yes(F.col(column) == value))
    return ingress


def by_id(ingress: DataFrame, ingress_id: int) -> DataFrame:
    return ingress.filter(F.col("ingress_id") == ingress_id)


def children(ingress: DataFrame, parent: int) -> DataFrame:
    return ingress.filter(F.col("parent_ingress") == parent)


def connected(ingress: DataFrame, ingress_type: str) -> DataFrame:
    """Connected BGP peers (bgp) or BMP routers (bmp)."""
    return ingress.filter(yes((F.col("ingress_type") == ingress_type) & (F.col("state") == "Connected")))


def neighbours(ingress: DataFrame) -> DataFrame:
    """All BGP neighbours with place: those over BMP first, then direct ones, then those of MRT files."""
    place = F.lit(None).cast("int")
    for k, name in enumerate(NEIGHBOUR_ORDER):
        place = F.when(F.col("ingress_type") == name, k).otherwise(place)
    return ingress.withColumn("place", place).filter("place IS NOT NULL")


def find_peers(ingress: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (query_id and fields) with ingress_id of a stored peer, the least if several fit, or null.

    Parent, address and ASN must be there and equal; the optional fields must be equal or both null.
    """
    stored = ingress.select(F.col("ingress_id").alias("found_id"), *(F.col(c).alias(f"have_{c}") for c in (*MANDATORY, *OPTIONAL)))
    match = F.lit(True)
    for c in MANDATORY:
        match = match & (wanted[c] == F.col(f"have_{c}"))
    for c in OPTIONAL:
        match = match & wanted[c].eqNullSafe(F.col(f"have_{c}"))
    found = wanted.join(stored, match).groupBy("query_id").agg(F.min("found_id").alias("ingress_id"))
    return wanted.join(found, "query_id", "left")


def find_routers(ingress: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (query_id, parent_ingress, remote_addr) with ingress_id of a stored BMP router or null."""
    stored = ingress.filter("ingress_type = 'bmp'").groupBy("parent_ingress", "remote_addr").agg(F.min("ingress_id").alias("ingress_id"))
    return wanted.join(stored, ["parent_ingress", "remote_addr"], "left")


def sessions_of(ingress: DataFrame, router: int) -> DataFrame:
    """(remote_asn, remote_addr, infos): a router's sessions by peer."""
    return children(ingress, router).groupBy("remote_asn", "remote_addr").agg(_infos())


def session_tree(ingress: DataFrame) -> DataFrame:
    """(router_id, remote_asn, remote_addr, infos) for connected routers, infos in the order of RIB types."""
    routers = connected(ingress, "bmp").select(F.col("ingress_id").alias("router_id"))
    return ingress.join(routers, F.col("parent_ingress") == F.col("router_id")).groupBy("router_id", "remote_asn", "remote_addr").agg(_infos())


def _infos() -> Column:
    return F.sort_array(F.collect_list(F.struct(rib_type_order(F.col("peer_rib_type")).alias("place"), "ingress_id", "peer_rib_type"))).alias("infos")


def first_matching_peer(addresses: DataFrame, peers: DataFrame) -> DataFrame:
    """`addresses` (address_id, afi, plen, bits, asn) with the first of `peers` (peer_id, afi, plen, bits, place, asns) that covers each, in the order of place: not the longest.

    admitted: the peer's list of ASNs is empty or has the address's.
    """
    found = covering_join(addresses, peers).withColumn("__rank", F.row_number().over(Window.partitionBy("address_id").orderBy("outer_place"))).filter("__rank = 1")
    admitted = (F.size("outer_asns") == 0) | yes(F.array_contains("outer_asns", F.col("asn")))
    return found.select("address_id", F.col("outer_peer_id").alias("peer_id"), admitted.alias("admitted"))


def first_sessions(opens: DataFrame) -> DataFrame:
    """Of live sessions (seq, remote_addr, remote_asn, ...) with one peer the first stays."""
    rest = [c for c in opens.columns if c not in ("remote_addr", "remote_asn")]
    return opens.groupBy("remote_addr", "remote_asn").agg(F.min_by(F.struct(*rest), "seq").alias("first")).select("remote_addr", "remote_asn", "first.*")


def source_id(template: str, ingress: DataFrame) -> DataFrame:
    """`ingress` with source_id: the template with {sys_name}, {router_ip} and {router_port} put in."""
    text = F.replace(F.lit(template), F.lit("{router_ip}"), F.coalesce("remote_addr", F.lit("IP")))
    text = F.replace(text, F.lit("{router_port}"), F.lit("PORT"))
    return ingress.withColumn("source_id", F.replace(text, F.lit("{sys_name}"), F.coalesce("name", F.lit("unknown"))))

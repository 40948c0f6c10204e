"""What user filters can ask of a route or message, as columns that are never null: an absent attribute is a plain no.

A filter is a function from a DataFrame to such a column; `FILTERS` names those that queries may use.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Well-known communities, and a hop that is no single ASN (an AS_SET).
NO_EXPORT, NO_ADVERTISE, NO_EXPORT_SUBCONFED, NO_PEER = 0xFFFFFF01, 0xFFFFFF02, 0xFFFFFF03, 0xFFFFFF04
BLACKHOLE, GRACEFUL_SHUTDOWN = 0xFFFF029A, 0xFFFF0000
WELL_KNOWN = {
    "NO_EXPORT": NO_EXPORT, "NO_ADVERTISE": NO_ADVERTISE, "NO_EXPORT_SUBCONFED": NO_EXPORT_SUBCONFED, "NO_PEER": NO_PEER,
    "BLACKHOLE": BLACKHOLE, "GRACEFUL_SHUTDOWN": GRACEFUL_SHUTDOWN,
}
NO_ASN = -1
UNKNOWN_ASN = 0xFFFFFFFF

Filter = Callable[[DataFrame], Column]
FILTERS: dict[str, Filter] = {}


def register(name: str) -> Callable[[Filter], Filter]:
    def keep(f: Filter) -> Filter:
        FILTERS[name] = f
        return f

    return keep


def condition(df: DataFrame, name: str | Filter | None) -> Column:
    """What a filter says of each row, never null; no filter accepts all; an unknown name is an error."""
    if name is None:
        return F.lit(True)
    if isinstance(name, str) and name not in FILTERS:
        raise KeyError(f"no filter {name!r}; known: {sorted(FILTERS)}")
    return yes((FILTERS[name] if isinstance(name, str) else name)(df))


def accepted(df: DataFrame, name: str | Filter | None) -> DataFrame:
    """Rows that a filter accepts."""
    return df if name is None else df.filter(condition(df, name))


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def all_of(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def contains(array: Column, value) -> Column:
    return yes(F.array_contains(array, value))


# Routes: hops (array of bigint), origin_asn, communities, large_communities (array of struct), attr_codes, otc, bits, afi.
def prefix_matches(df: DataFrame, afi: int, bits: str) -> Column:
    return yes((df["afi"] == afi) & (df["bits"] == bits))


def aspath_contains(hops: Column, asn: int) -> Column:
    return contains(hops, F.lit(asn).cast("bigint"))


def aspath_origin(hops: Column) -> Column:
    """The right-most ASN; null if the path is empty or ends in an AS_SET."""
    return F.nullif(F.try_element_at(hops, F.lit(-1)), F.lit(NO_ASN).cast("bigint"))


def match_origin(origin: Column, asn: int) -> Column:
    return yes(origin == asn)


def contains_community(communities: Column, community: int) -> Column:
    return contains(communities, F.lit(community).cast("bigint"))


def contains_large_community(communities: Column, community: tuple[int, int, int]) -> Column:
    g, a, b = community
    return yes(F.exists(communities, lambda c: (c["g"] == g) & (c["a"] == a) & (c["b"] == b)))


def has_attribute(codes: Column, code: int) -> Column:
    return contains(codes, F.lit(code).cast("smallint"))


def announcements_count(announced: Column) -> Column:
    return F.coalesce(F.size(announced), F.lit(0)).cast("bigint")


withdrawals_count = announcements_count


def fmt_rov_status(status: Column) -> Column:
    """camelCase status as text with hyphens: not-checked, not-found, valid, invalid."""
    return F.lower(F.regexp_replace(status, "([A-Z])", "-$1"))


def fmt_aspath(hops: Column) -> Column:
    return F.array_join(F.transform(hops, lambda h: F.when(h == NO_ASN, "{}").otherwise(h.cast("string"))), " ")


def fmt_asn(asn: Column) -> Column:
    return F.concat(F.lit("AS"), asn.cast("string"))


def fmt_aspath_origin(origin: Column) -> Column:
    return F.coalesce(fmt_asn(origin), F.lit(""))


def fmt_community(community: Column) -> Column:
    """A well-known name, or high:low."""
    named = F.lit(None).cast("string")
    for name, value in WELL_KNOWN.items():
        named = F.when(community == value, name).otherwise(named)
    return F.coalesce(named, F.concat_ws(":", F.shiftright(community, 16).cast("string"), community.bitwiseAND(F.lit(0xFFFF).cast("bigint")).cast("string")))


def fmt_communities(communities: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(communities, fmt_community), ", "), F.lit(""))


def fmt_large_communities(communities: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(communities, lambda c: F.concat_ws(":", c["g"].cast("string"), c["a"].cast("string"), c["b"].cast("string"))), ", "), F.lit(""))


def fmt_pcap(message: Column) -> Column:
    return F.concat(F.lit("000000 "), F.regexp_replace(F.lower(F.hex(message)), "(..)", "$1 "))


def parse_community(text: Column) -> Column:
    """'high:low', a number or a well-known name; anything else is 0."""
    named = F.lit(None).cast("bigint")
    for name, value in WELL_KNOWN.items():
        named = F.when(F.upper(F.replace(text, F.lit("-"), F.lit("_"))) == name, F.lit(value).cast("bigint")).otherwise(named)
    parts = F.split(text, ":")
    high, low = (F.try_to_number(F.get(parts, F.lit(k)), F.lit("99999")).cast("bigint") for k in (0, 1))
    pair = F.when((F.size(parts) == 2) & (high < 65536) & (low < 65536), high * 65536 + low)
    return F.coalesce(named, pair, text.try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_large_community(text: Column) -> Column:
    """'g:a:b'; anything else is 0:0:0."""
    parts = F.split(text, ":")
    g, a, b = (F.get(parts, F.lit(k)).try_cast("bigint") for k in range(3))
    ok = (F.size(parts) == 3) & g.isNotNull() & a.isNotNull() & b.isNotNull()
    zero = F.lit(0).cast("bigint")
    return F.struct(*(F.when(ok, x).otherwise(zero).alias(n) for x, n in ((g, "g"), (a, "a"), (b, "b"))))


# Messages: pph (struct with asn), msg_type.
def is_ibgp(peer_asn: Column, asn: int) -> Column:
    return yes(peer_asn == asn)


def is_type(msg_type: Column, name: str) -> Column:
    """route_monitoring, peer_up, peer_down, statistics, initiation, termination, mirroring."""
    return yes(msg_type == name)


def peer_asn(remote_asn: Column) -> Column:
    return F.coalesce(remote_asn, F.lit(UNKNOWN_ASN))


def peer_address(remote_addr: Column) -> Column:
    return F.coalesce(remote_addr, F.lit("::"))


def fmt_vrp(prefix: Column, asn: Column, action: Column) -> Column:
    return F.concat(action, F.lit(" VRP "), prefix, F.lit(" from "), asn.cast("string"))


def fmt_rov_update(previous: Column, current: Column, prefix: Column, origin: Column, peer: Column) -> Column:
    return F.format_string("[%s] -> [%s] %s originated by %s, learned from %s", fmt_rov_status(previous), fmt_rov_status(current), prefix, fmt_asn(origin), fmt_asn(peer))


@register("hidden-hop")
def hidden_hop(df: DataFrame) -> Column:
    """The route was marked only-to-customer by an ASN that its path does not show."""
    return df["otc"].isNotNull() & df["hops"].isNotNull() & ~contains(df["hops"], df["otc"])


@register("no-export")
def carries_no_export(df: DataFrame) -> Column:
    return contains_community(df["communities"], NO_EXPORT)


def rejects_ibgp(my_asn: int) -> Filter:
    return lambda df: ~is_ibgp(df["peer_asn"], my_asn)

"""Peer roles, capabilities and types, as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of peer RIB types; BGP roles (RFC 9234); extended next-hop codes (AFI, SAFI, next-hop AFI).
RIB_TYPES = ("inPre", "inPost", "loc", "outPre", "outPost")
ROLES = {0: "Provider", 1: "RS", 2: "RS-Client", 3: "Customer", 4: "Peer"}
NEXT_HOP_CODES = {"000100010002": "v4unicast-v6nh", "000100020002": "v4multicast-v6nh", "000100040002": "v4mpls-v6nh", "000100800002": "v4vpn-v6nh", "000200010001": "v6unicast-v4nh"}


def rib_type_order(rib_type: Column) -> Column:
    found = F.lit(None).cast("int")
    for k, name in enumerate(RIB_TYPES):
        found = F.when(rib_type == name, k).otherwise(found)
    return found


def role_label(role: Column) -> Column:
    found = F.lit(None).cast("string")
    for k, name in ROLES.items():
        found = F.when(role == k, name).otherwise(found)
    return found


def roles_fit(local: Column, remote: Column) -> Column:
    """Do the two ends' roles belong together: provider and customer, RS and client, peer and peer; null unless both are known."""
    pairs = ((0, 3), (3, 0), (1, 2), (2, 1), (4, 4))
    fit = F.lit(False)
    for a, b in pairs:
        fit = fit | ((local == a) & (remote == b))
    return F.when(local.isin(*ROLES) & remote.isin(*ROLES), fit)


def next_hops(capability: Column) -> Column:
    """Labels of an extended next-hop capability: chunks of six bytes, known ones by name, others as afi/safi-nh."""
    text = F.lower(F.hex(capability))
    chunks = F.transform(F.sequence(F.lit(0), (F.length(text) / 12).cast("int") - 1), lambda i: F.substr(text, i * 12 + 1, F.lit(12)))

    def label(c: Column) -> Column:
        number = lambda at, width: F.conv(F.substr(c, F.lit(at), F.lit(width)), 16, 10)
        found = F.concat(number(1, 4), F.lit("/"), number(5, 4), F.lit("-nh"), number(9, 4))
        for code, name in NEXT_HOP_CODES.items():
            found = F.when(c == code, name).otherwise(found)
        return found

    return F.when(F.length(text) >= 12, F.transform(chunks, label)).otherwise(F.array().cast("array<string>"))

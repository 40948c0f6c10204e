"""IP prefixes as columns: (afi, plen, bits), bits being the first plen bits as text.

A covers B when B's bits start with A's bits (and afi agree), so the order of (afi, bits) is that of a prefix tree, equality is
an exact match, and a literal more-specifics search is `startswith`, which reaches the Parquet scan.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ipv4_bits(address: Column) -> Column:
    return F.array_join(F.transform(F.split(address, r"\."), lambda x: F.lpad(F.conv(x, 10, 2), 8, "0")), "")


def _ipv6_bits(address: Column) -> Column:
    """All 128 bits; '::' stands for as many zero groups as are missing; a dotted tail is two groups."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    dotted = F.regexp_extract(address, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    tail = _ipv4_bits(dotted)
    plain = F.when(dotted != "", F.concat(F.regexp_replace(address, r"\d+\.\d+\.\d+\.\d+$", ""), F.conv(F.substring(tail, 1, 16), 2, 16), F.lit(":"), F.conv(F.substring(tail, 17, 16), 2, 16))).otherwise(address)
    sides = F.split(plain, "::")
    left, right = groups(sides[0]), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    missing = F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right))
    full = F.concat(left, F.array_repeat(F.lit("0"), missing.cast("int")), right)
    return F.array_join(F.transform(full, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")


def address_bits(address: Column) -> Column:
    return F.when(address.contains(":"), _ipv6_bits(address)).otherwise(_ipv4_bits(address))


def afi_of(address: Column) -> Column:
    return F.when(address.contains(":"), F.lit(2)).otherwise(F.lit(1)).cast("smallint")


def parse_prefix(text: Column) -> Column:
    """'10.0.0.0/8' or '2001:db8::/32' as struct(afi, plen, bits); without a length the address is a host; host bits are cut; unparsable is null."""
    ok = text.rlike(r"^(\d{1,3}(\.\d{1,3}){3}(/\d{1,2})?|[0-9a-fA-F:]*:[0-9a-fA-F:.]*(/\d{1,3})?)$")
    address = F.regexp_extract(text, r"^([^/]*)", 1)
    width = F.when(address.contains(":"), 128).otherwise(32)
    plen = F.coalesce(F.nullif(F.regexp_extract(text, r"/(\d+)$", 1), F.lit("")).cast("int"), width)
    return F.when(ok & (plen <= width), F.struct(afi_of(address).alias("afi"), plen.cast("smallint").alias("plen"), F.substr(address_bits(address), F.lit(1), plen).alias("bits")))


def format_prefix(afi: Column, plen: Column, bits: Column) -> Column:
    """Text of a prefix; in IPv6 the first of the longest runs of two or more zero groups is '::'."""
    part = lambda base, width: lambda i: F.lower(F.conv(F.substr(F.rpad(bits, 128, "0"), i * width + 1, F.lit(width)), 2, base))
    v4 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), part(10, 8)), ".")
    full = F.concat(F.lit(":"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), part(16, 16)), ":"), F.lit(":"))
    v6 = F.substring(full, 2, 39)
    for n in range(2, 9):
        run = rf"^(.*?)(?::0){{{n}}}:(.*)$"
        v6 = F.when(full.rlike(run), F.concat(F.substring(F.regexp_extract(full, run, 1), 2, 39), F.lit("::"), F.regexp_extract(full, run, 2))).otherwise(v6)
    v6 = F.regexp_replace(v6, "([^:]):$", "$1")
    return F.concat(F.when(afi == 1, v4).otherwise(v6), F.lit("/"), plen.cast("string"))


def ancestors(bits: Column, plen: Column, lengths: Column | None = None) -> Column:
    """All prefixes that cover a prefix, itself included; only of the given lengths (array of int) if any are."""
    steps = F.sequence(F.lit(0), plen.cast("int")) if lengths is None else F.filter(lengths, lambda n: n <= plen)
    return F.transform(steps, lambda n: F.when(n == 0, F.lit("")).otherwise(F.substr(bits, F.lit(1), n)))


def covers(outer_afi: Column, outer_bits: Column, afi: Column, bits: Column) -> Column:
    return (outer_afi == afi) & bits.startswith(outer_bits)


def is_multicast(afi: Column, bits: Column) -> Column:
    return F.when(afi == 1, bits.startswith("1110")).otherwise(bits.startswith("11111111"))

"""A collector from a TOML text: captures, filters, the table and files, as one batch job."""

import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.functions.predicates import accepted
from prefixlake.operators import rib, rov
from prefixlake.sources import captures, sinks
from prefixlake.streaming import bmp_sessions


@dataclass(frozen=True)
class Unit:
    """A source: kind is mrt-dump, mrt-updates, bmp or rtr; `paths` a path or a list of them; `filter` the name of a registered one (of routes; VRPs have none)."""

    kind: str
    paths: str | list[str]
    filter: str | None = None


@dataclass(frozen=True)
class Target:
    """A file sink of the table."""

    path: str
    format: str = "json"
    filter: str | None = None


@dataclass(frozen=True)
class Collector:
    units: dict[str, Unit]
    targets: dict[str, Target] = field(default_factory=dict)


def _made(kind, table: dict, where: str):
    known = {f.name for f in fields(kind)}
    if unknown := table.keys() - known:
        raise ValueError(f"{where} has unknown fields {sorted(unknown)}")
    try:
        return kind(**table)
    except TypeError as e:
        raise ValueError(f"{where}: {e}") from e


def load(text: str) -> Collector:
    """A collector from TOML with [units.<name>] and [targets.<name>]; fields that nobody knows are an error."""
    found = tomllib.loads(text)
    if unknown := found.keys() - {"units", "targets"}:
        raise ValueError(f"unknown sections {sorted(unknown)}")
    return Collector({n: _made(Unit, t, f"units.{n}") for n, t in found.get("units", {}).items()}, {n: _made(Target, t, f"targets.{n}") for n, t in found.get("targets", {}).items()})


def updates_of(spark: SparkSession, unit: Unit) -> DataFrame:
    """The unit's captures as a route log, which has session updates too.

    An ingress of MRT files is named by the peer's address and ASN, so that a dump and its updates are one table; seq goes by
    time and then by place in the file, and a dump counts as of the time when it was taken. Those of BMP are named by router
    (a capture file is one) and peer header.
    """
    if unit.kind not in ("mrt-dump", "mrt-updates", "bmp"):
        raise ValueError(f"no unit {unit.kind!r}")
    source = captures.files(spark, unit.paths)
    names = list(captures.NAMES)
    in_order = lambda time: (F.coalesce(F.col(time), F.lit(0)) * (1 << 31) + F.col("number")).alias("seq")
    if unit.kind == "mrt-dump":
        rows = captures.mrt_dump(source).filter("NOT corrupt").select(in_order("taken"), F.xxhash64("peer_addr", "peer_asn").alias("ingress_id"), F.array(F.struct("safi", "afi", "plen", "bits")).alias("announced"), F.lit(None).cast(captures.PREFIXES).alias("withdrawn"), *names)
    elif unit.kind == "mrt-updates":
        rows = captures.mrt_updates(source).filter("NOT corrupt AND old_state IS NULL").select(in_order("time"), F.xxhash64("addr", "asn").alias("ingress_id"), "announced", "withdrawn", *names)
    elif unit.kind == "bmp":
        found = captures.bmp_messages(source).withColumn("router_id", F.xxhash64("path")).withColumnRenamed("number", "seq")
        results = bmp_sessions.replay(bmp_sessions.messages(found))
        ingress = F.xxhash64("router_id", "ingress").alias("ingress_id")
        routes = results.filter("op = 'routes'").select("router_id", "seq", F.get("ingress_ids", F.lit(0)).alias("ingress"))
        rows = found.join(routes, ["router_id", "seq"]).select("seq", ingress, "announced", "withdrawn", *names)
        control = results.filter(F.col("op").isin("withdraw_ingress", "reappear")).select((F.col("seq") * 2).alias("seq"), "op", "router_id", F.explode("ingress_ids").alias("ingress"))
        log = rib.exploded(accepted(rows, unit.filter))
        return log.unionByName(control.select("seq", "op", ingress), allowMissingColumns=True)
    return rib.exploded(accepted(rows, unit.filter))


def run(spark: SparkSession, collector: Collector) -> DataFrame:
    """The table of all units together, with status after session updates, and rov if there is an rtr unit; written to all targets."""
    logs = [updates_of(spark, u) for u in collector.units.values() if u.kind != "rtr"]
    if not logs:
        raise ValueError("no units of routes")
    log = logs[0]
    for other in logs[1:]:
        log = log.unionByName(other)
    log = log.withColumns({"family_afi": F.lit(None).cast("smallint"), "family_safi": F.lit(None).cast("string")})
    table = rib.with_sessions(rib.fold(log), log)
    lists = [captures.rtr_log(captures.files(spark, u.paths)) for u in collector.units.values() if u.kind == "rtr"]
    if lists:
        vrps = lists[0]
        for other in lists[1:]:
            vrps = vrps.unionByName(other)
        table = rov.with_rov(table, rov.current_vrps(vrps, by=("path",)))
    for t in collector.targets.values():
        sinks.write_file(accepted(table, t.filter), t.path, t.format)
    return table

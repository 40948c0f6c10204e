"""Captured BMP, MRT and RTR data as DataFrames: files are read as binary, a record is found by its length, each becomes a row."""

import bz2
import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixlake.sources import wire

PREFIXES = "array<struct<safi:string,afi:smallint,plen:smallint,bits:string>>"
LARGE = "array<struct<g:bigint,a:bigint,b:bigint>>"
ATTRIBUTES = f"origin_type string, hops array<bigint>, origin_asn bigint, next_hop string, communities array<bigint>, large_communities {LARGE}, otc bigint, attr_codes array<smallint>"
NAMES = ("origin_type", "hops", "origin_asn", "next_hop", "communities", "large_communities", "otc", "attr_codes")
COUNTS = ("conventional_reach", "conventional_unreach", "mp_reach", "mp_unreach")
ROWS = 2000


def files(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, content, sha256) of files, one row each; gz and bz2 are unpacked. A file is one task's work: long captures are cut into several files when they are taken."""
    reader = spark.read.format("binaryFile")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    return rows.select("path", "content", F.sha2("content", 256).alias("sha256"))


def unpacked(path: str, content: bytes) -> bytes:
    return gzip.decompress(content) if path.endswith(".gz") else bz2.decompress(content) if path.endswith(".bz2") else content


def _rows(source: DataFrame, schema: str, parse) -> DataFrame:
    """Each file through `parse`, in batches of ROWS. Where a file cannot be read on, a row with `corrupt` set ends it; others are read all the same."""
    names = [c.split(" ")[0] for c in _fields(schema)]

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                held = []
                for number, row in enumerate(_guarded(parse, path, content)):
                    held.append([path, number, *(row.get(n) for n in names[2:])])
                    if len(held) == ROWS:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return source.select("path", "content").mapInPandas(run, schema)


def _guarded(parse, path: str, content) -> Iterator[dict]:
    try:
        yield from parse(unpacked(path, bytes(content)))
    except (ValueError, IndexError, KeyError, EOFError, OSError, struct.error):
        yield {"corrupt": True}


def _fields(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:k].strip())
            last = k + 1
    return [*out, schema[last:].strip()]


def _update(fields: dict | None) -> dict:
    if fields is None:
        return {}
    out = {n: fields.get(n) for n in (*NAMES, *COUNTS, "announced", "withdrawn", "eor")}
    return out


UPDATE = f"announced {PREFIXES}, withdrawn {PREFIXES}, eor string, {', '.join(f'{c} bigint' for c in COUNTS)}, {ATTRIBUTES}"


def bmp_messages(source: DataFrame, recorded: bool = False) -> DataFrame:
    """Rows (path, number, time, corrupt, msg_type, trace_id, peer header, sys_name, sys_descr, gr_capable, UPDATE fields) of captures.

    An UPDATE that can't be read with wide ASNs is read with narrow ones (reparsed); if neither works the row stays with
    corrupt set, as does a message that is too short. `recorded`: files of the replay tool, with a time before each message.
    """
    schema = f"path string, number bigint, time bigint, corrupt boolean, reparsed boolean, msg_type string, trace_id smallint, peer_type string, flags smallint, distinguisher binary, addr string, asn bigint, bgp_id binary, gr_capable boolean, sys_name string, sys_descr string, {UPDATE}"

    def parse(data):
        for time, frame in wire.replay_frames(data) if recorded else ((None, f) for f in wire.bmp_frames(data)):
            row: dict = {"time": time, "corrupt": False, "reparsed": False}
            try:
                m = wire.bmp_message(frame)
            except (ValueError, IndexError):
                yield row | {"corrupt": True}
                continue
            row |= {"msg_type": m["msg_type"], "trace_id": m["trace_id"], "gr_capable": m["gr_capable"], **(m["pph"] or {})}
            row |= {"sys_name": dict(m["tlvs"]).get(2), "sys_descr": dict(m["tlvs"]).get(1)}
            if m["update"] is not None:
                for width in (4, 2):
                    try:
                        row |= _update(wire.bgp_update(m["update"], width)) | {"reparsed": width == 2}
                        break
                    except ValueError:
                        row["corrupt"] = width == 2
            yield row

    return _rows(source, schema, parse)


def mrt_dump(source: DataFrame) -> DataFrame:
    """Rows (path, number, corrupt, taken, time, peer_addr, peer_asn, safi, afi, plen, bits, attributes) of RIB dumps: IPv4 and IPv6 unicast, one for each entry.

    Peers are numbered in each file's index, at its start. `taken` is the time of the dump's record, `time` that of the route.
    A record that cannot be read (a peer that the index lacks, bad attributes) is one corrupt row; the next ones are read.
    """

    def parse(data):
        peers = []
        for taken, kind, sub, body in wire.mrt_records(data):
            if kind == 13 and sub == 1:
                peers = wire.peer_index(body)
            elif kind == 13 and sub in (2, 4):
                try:
                    for e in wire.rib_entries(sub, body):
                        safi, afi, plen, bits = e["prefix"]
                        addr, asn = peers[e["peer"]]
                        yield e | {"corrupt": False, "taken": taken, "peer_addr": addr, "peer_asn": asn, "safi": safi, "afi": afi, "plen": plen, "bits": bits}
                except (ValueError, IndexError, struct.error):
                    yield {"corrupt": True, "taken": taken}

    return _rows(source, f"path string, number bigint, corrupt boolean, taken bigint, time bigint, peer_addr string, peer_asn bigint, safi string, afi smallint, plen smallint, bits string, {ATTRIBUTES}", parse)


def mrt_updates(source: DataFrame) -> DataFrame:
    """Rows (path, number, time, addr, asn, old_state, new_state, UPDATE fields) of BGP4MP records: UPDATEs and changes of state; others are left out, unreadable ones are corrupt."""

    def parse(data):
        for time, kind, sub, body in wire.mrt_records(data):
            if kind not in (16, 17):
                continue
            try:
                m = wire.bgp4mp(sub, body)
            except (ValueError, IndexError, wire.struct.error):
                yield {"time": time, "corrupt": True}
                continue
            if m is not None:
                yield {"time": time, "corrupt": False} | m | _update(m["update"])

    return _rows(source, f"path string, number bigint, time bigint, corrupt boolean, addr string, asn bigint, old_state int, new_state int, {UPDATE}", parse)


def rtr_pdus(source: DataFrame) -> DataFrame:
    """All PDUs of RTR captures: kind 4 and 6 prefixes, 9 router keys, 11 ASPAs, and the marks between them."""
    schema = "path string, number bigint, corrupt boolean, version int, kind int, session_id int, serial bigint, action string, afi smallint, plen smallint, bits string, maxlen int, asn bigint, ski string, spki string, providers array<bigint>"
    return _rows(source, schema, wire.rtr_pdus)


def router_keys(source: DataFrame) -> DataFrame:
    """(path, seq, action, ski, asn, spki): log of router keys, for rov.current_set."""
    return rtr_pdus(source).filter("kind = 9").select("path", F.col("number").alias("seq"), "action", "ski", "asn", "spki")


def aspas(source: DataFrame) -> DataFrame:
    """(path, seq, action, customer_asn, providers): log of ASPAs; the last one of a customer counts."""
    return rtr_pdus(source).filter("kind = 11").select("path", F.col("number").alias("seq"), "action", F.col("asn").alias("customer_asn"), "providers")


def rtr_log(source: DataFrame) -> DataFrame:
    """VRP log (seq, kind, action, afi, plen, bits, maxlen, asn, session_id, serial) of RTR captures.

    Prefixes between a cache reset (PDU 2, or the start) and the end of data are one full list; after a serial query or
    notify they are a delta. seq counts PDUs; rows of a full list share that of its start.
    """
    rows = rtr_pdus(source)
    order = Window.partitionBy("path").orderBy("number")
    mode = F.last(F.when(F.col("kind").isin(2, 8), "reset").when(F.col("kind").isin(0, 1), "delta"), ignorenulls=True).over(order)
    start = F.last(F.when(F.col("kind").isin(0, 1, 2, 8), F.col("number")), ignorenulls=True).over(order)
    marked = rows.withColumn("mode", F.coalesce(mode, F.lit("reset"))).withColumn("start", F.coalesce(start, F.lit(0)))
    log = marked.filter("action IS NOT NULL AND bits IS NOT NULL")
    return log.select("path", F.when(F.col("mode") == "reset", F.col("start")).otherwise(F.col("number")).alias("seq"), F.col("mode").alias("kind"), "action", "afi", "plen", "bits", "maxlen", "asn", "session_id")


def mrt_state_withdrawals(updates: DataFrame, intended: bool = False) -> DataFrame:
    """Rows of sessions that fell from established (6) to idle (1). As observed these withdraw nothing; `intended` gives them for withdrawal."""
    fell = updates.filter("old_state = 6 AND new_state = 1").select("path", "number", "addr", "asn")
    return fell if intended else fell.limit(0)

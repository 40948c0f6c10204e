"""Sessions of monitored routers: from BMP messages in order to session updates, accepted routes and states."""

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Flags of a peer that name its RIB and policy; a route whose peer is unknown is tried without them.
RIB_FLAGS = 0b0101_0000
#: A running sum over a router is added up in chunks of 2^CHUNK_BITS numbers of seq, which have as many of its messages at most.
CHUNK_BITS = 16
IN = ["seq", "router_id", "msg_type", "peer", "flags", "gr_capable", "readable", "eor", "family", "sys_name"]
#: Messages whose outcome hangs on their own peer alone, once the router has begun.
PEER_KINDS = ("peer_up", "peer_down", "route_monitoring")
OUT = "seq bigint, router_id bigint, result string, op string, ingress_ids array<string>, phase string, unknown_peer boolean, pending bigint, up_peers bigint"


def messages(bmp: DataFrame) -> DataFrame:
    """Columns IN of captured messages (sources.captures.bmp_messages with seq and router_id)."""
    family = F.when(F.size("announced") > 0, F.concat_ws("/", F.col("announced")[0]["afi"].cast("string"), F.col("announced")[0]["safi"]))
    peer = F.concat_ws("|", "peer_type", F.hex("distinguisher"), "addr", F.col("asn").cast("string"), F.hex("bgp_id"))
    eor = F.concat_ws("/", F.split("eor", "/")[0], F.when(F.split("eor", "/")[1] == "1", "unicast").otherwise("multicast"))
    return bmp.select("seq", "router_id", "msg_type", peer.alias("peer"), "flags", "gr_capable", (~F.col("corrupt")).alias("readable"), F.when(F.col("eor").isNotNull(), eor).alias("eor"), family.alias("family"), "sys_name")


def new_state() -> dict:
    return {"phase": "initiating", "name": None, "peers": {}, "known": {}, "pending": 0}


def _awaited(peers: dict, key: str) -> int:
    return len(peers[key]["pending"]) if key in peers else 0


def peer_step(peers: dict, known: dict, m: dict) -> tuple[str, str | None, str, bool]:
    """A message of PEER_KINDS to a router that has begun: result, session update or routes, the peer's key (which names its ingress), and whether the peer is unknown.

    Changes `peers` and `known`, and of them only what belongs to the message's peer. Peers are keyed by peer header with flags;
    an ingress is named by router and key, so a peer that comes back has the same.
    """
    kind, flags = m["msg_type"], int(m["flags"] or 0)
    key = f"{m['peer']}|{flags}"
    if kind == "peer_up":
        if key in peers:
            return "invalid", None, key, False
        peers[key] = {"ingress": key, "eor_capable": bool(m["gr_capable"]), "pending": []}
        if key in known:
            return "routing", "reappear", key, False
        known[key] = True
        return "other", None, key, False
    if kind == "peer_down":
        return ("routing", "withdraw_ingress", key, False) if peers.pop(key, None) else ("invalid", None, key, False)
    if key not in peers:
        plain = f"{m['peer']}|{flags & ~RIB_FLAGS & 0xFF}"
        if plain not in peers:
            return "invalid", None, key, True
        peers[key] = {**peers[plain], "ingress": key, "pending": []}
        known[key] = True
    if not m["readable"]:
        return "invalid", None, key, False
    peer = peers[key]
    if m["eor"]:
        peer["pending"] = [x for x in peer["pending"] if x != m["eor"]]
    elif m["family"] and peer["eor_capable"] and m["family"] not in peer["pending"]:
        peer["pending"].append(m["family"])
    return "routing", "routes", key, False


def step(state: dict, m: dict) -> tuple[str, str | None, list[str], bool]:
    """One message of a router: what comes of it (state, other, invalid, routing), the session update or routes, their ingresses, and whether its peer is unknown. Changes `state`; its cost does not grow with the router's peers, but for those that an end withdraws."""
    kind, phase = m["msg_type"], state["phase"]
    if kind == "disconnect":  # a row that a capture's reader adds where a connection was lost
        op, ids = disconnected(state)
        return "routing" if ids else "state", op if ids else None, ids, False
    if phase == "terminated":
        return "invalid", None, [], False
    if kind == "initiation":
        state["name"] = m["sys_name"] or "no-sysname"
        if phase == "initiating":
            state["phase"] = "dumping"
            return "state", None, [], False
        return "other", None, [], False
    if phase == "initiating":
        return "invalid", None, [], False
    if kind in PEER_KINDS:
        peers, key = state["peers"], f"{m['peer']}|{int(m['flags'] or 0)}"
        before = _awaited(peers, key)
        result, op, key, unknown = peer_step(peers, state["known"], m)
        state["pending"] += _awaited(peers, key) - before
        # Any mark that leaves no peer with one to come ends the dump, also where none was to come.
        if phase == "dumping" and op == "routes" and m["eor"] and not state["pending"]:
            state["phase"] = "updating"
            return "state", None, [], False
        return result, op, [key] if op else [], unknown
    if kind == "termination":
        op, ids = disconnected(state)
        return ("routing", op, ids, False) if ids else ("state", None, [], False)
    return "other", None, [], False


def disconnected(state: dict) -> tuple[str, list[str]]:
    """What the end of a router's session or the loss of its connection withdraws: all its peers."""
    ids = sorted(x["ingress"] for x in state["peers"].values())
    state["peers"].clear()
    state["phase"], state["pending"] = "terminated", 0
    return "withdraw_ingress", ids


def _out(m: dict, state: dict, result: tuple) -> tuple:
    what, op, ids, unknown = result
    return int(m["seq"]), int(m["router_id"]), what, op, ids, state["phase"], unknown, state["pending"], len(state["peers"])


_NAMES = [c.split()[0] for c in OUT.split(", ")]


def _plain(rows: pd.DataFrame) -> Iterator[dict]:
    for r in rows.astype(object).where(rows.notna(), None).to_dict("records"):
        yield r


def _bounds(rows: DataFrame) -> DataFrame:
    """(router_id, started, ended): the seq of each router's first initiation and of what ends its session, from its control messages."""
    control = rows.filter(F.col("msg_type").isin("initiation", "termination", "disconnect")).select("router_id", "seq", "msg_type")
    at = lambda kind: F.min(F.when(F.col("msg_type") == kind, F.col("seq")))
    first = control.groupBy("router_id").agg(at("initiation").alias("started"), at("disconnect").alias("lost"))
    closed = control.filter("msg_type = 'termination'").join(first, "router_id").filter("seq > started").groupBy("router_id").agg(F.min("seq").alias("closed"))
    return first.join(closed, "router_id", "left").select("router_id", "started", F.least("lost", "closed").alias("ended"))


_ACT = "seq bigint, router_id bigint, result string, op string, ingress string, unknown_peer boolean, up bigint, awaited bigint, ends boolean"


def _by_peer(rows: DataFrame) -> DataFrame:
    """_ACT for messages of PEER_KINDS of routers that have begun: what comes of each, by how much it changes the peers that are up and the ends of RIB that are awaited, and whether it marks one.

    Each peer's messages go by seq; rows stream through, and a task holds one peer at a time.
    """
    schema = pa.schema([(c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in _ACT.split(", ")])

    def run(batches):
        whose, peers, known = None, {}, {}
        for b in batches:
            out = []
            for m in b.to_pylist():
                if (m["router_id"], m["peer"]) != whose:
                    whose, peers, known = (m["router_id"], m["peer"]), {}, {}
                key, n = f"{m['peer']}|{int(m['flags'] or 0)}", len(peers)
                before = _awaited(peers, key)
                result, op, key, unknown = peer_step(peers, known, m)
                out.append((m["seq"], m["router_id"], result, op, key, unknown, len(peers) - n, _awaited(peers, key) - before, op == "routes" and bool(m["eor"])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    needed = ["seq", "router_id", "msg_type", "peer", "flags", "gr_capable", "readable", "eor", "family"]
    return rows.select(*needed).repartition("router_id", "peer").sortWithinPartitions("router_id", "peer", "seq").mapInArrow(run, _ACT)


def replay(rows: DataFrame) -> DataFrame:
    """OUT for all messages (columns IN); those of a router have different seq and go by it.

    A router's session is between two of its control messages, and within it a message's outcome hangs on its own peer: so peers
    are replayed apart from each other. What is counted over all peers of a router is a running sum, added up in chunks of
    2^CHUNK_BITS numbers of seq, then over chunks. One row for each router is broadcast.
    """
    rows = rows.select(*IN)
    seq, kind = F.col("seq"), F.col("msg_type")
    place = F.when(seq >= F.col("ended"), "terminated").when(F.col("started").isNull() | (seq < F.col("started")), "initiating").otherwise("dumping")
    bounded = rows.join(F.broadcast(_bounds(rows)), "router_id", "left").withColumn("phase", place)
    by_peer = (F.col("phase") == "dumping") & F.coalesce(kind.isin(*PEER_KINDS), F.lit(False))

    ids, none = "ingress_ids", F.array().cast("array<string>")
    acts = _by_peer(bounded.filter(by_peer)).withColumns({"phase": F.lit("dumping"), ids: F.when(F.col("op").isNotNull(), F.array("ingress")).otherwise(none)})
    result = F.when((kind == "disconnect") | ((kind == "termination") & (seq == F.col("ended"))), "state").when(F.col("phase") != "dumping", "invalid")
    result = result.when((kind == "initiation") & (seq == F.col("started")), "state").otherwise("other")
    zero = F.lit(0).cast("bigint")
    others = bounded.filter(~by_peer).select("seq", "router_id", result.alias("result"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("ingress"), F.lit(False).alias("unknown_peer"), zero.alias("up"), zero.alias("awaited"), F.lit(False).alias("ends"), "phase", none.alias(ids), "ended")
    # The end of a session withdraws all peers that are up by then.
    up = _by_peer(bounded.filter(by_peer & F.col("ended").isNotNull())).filter("up <> 0").groupBy("router_id", "ingress").agg(F.sum("up").alias("up")).filter("up > 0")
    up = up.groupBy("router_id").agg(F.array_sort(F.collect_list("ingress")).alias("gone"))
    last = others.filter("seq = ended AND result = 'state'").join(up, "router_id", "left").withColumns({"result": F.when(F.col("gone").isNotNull(), "routing").otherwise("state"), "op": F.when(F.col("gone").isNotNull(), "withdraw_ingress"), ids: F.coalesce("gone", none)})
    steady = others.filter("NOT coalesce(seq = ended AND result = 'state', false)")
    every = acts.unionByName(steady.drop("ended")).unionByName(last.drop("ended", "gone")).withColumn("chunk", F.shiftright("seq", CHUNK_BITS))

    within = Window.partitionBy("router_id", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    here = every.withColumns({"up_peers": F.sum("up").over(within), "pending": F.sum("awaited").over(within)})
    marks = here.groupBy("router_id", "chunk", F.when(F.col("ends"), F.col("pending")).alias("pending")).agg(F.min(F.when(F.col("ends"), seq)).alias("first"), F.sum("up").alias("up"), F.sum("awaited").alias("awaited"))
    before = Window.partitionBy("router_id").orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumns({"up_before": F.coalesce(F.sum("up").over(before), zero), "pending_before": F.coalesce(F.sum("awaited").over(before), zero)})
    # Any mark that leaves no peer with one to come ends the dump, also where none was to come.
    settled = F.min(F.when(F.col("pending_before") + F.col("pending") == 0, F.col("first"))).over(Window.partitionBy("router_id"))
    chunks = marks.withColumn("settled", settled).select("router_id", "chunk", "up_before", "pending_before", "settled").distinct()

    turn = (F.col("phase") == "dumping") & F.coalesce(seq == F.col("settled"), F.lit(False))
    over = F.col("phase") == "terminated"
    return here.join(chunks, ["router_id", "chunk"]).select(
        "seq", "router_id", F.when(turn, "state").otherwise(F.col("result")).alias("result"), F.when(~turn, F.col("op")).alias("op"), F.when(turn, none).otherwise(F.col(ids)).alias(ids),
        F.when((F.col("phase") == "dumping") & (seq >= F.col("settled")), "updating").otherwise(F.col("phase")).alias("phase"), "unknown_peer",
        F.when(over, zero).otherwise(F.col("pending_before") + F.col("pending")).alias("pending"), F.when(over, zero).otherwise(F.col("up_before") + F.col("up_peers")).alias("up_peers"),
    )


class RouterSessions(StatefulProcessor):
    """State of a router between micro-batches, as JSON. Within a batch messages go by seq; batches must come in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else new_state()
        whole = pd.concat(list(rows)).sort_values("seq")
        out = [_out(m, state, step(state, m)) for m in _plain(whole)]
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def live(rows: DataFrame) -> DataFrame:
    """OUT of a stream of messages (columns IN)."""
    return rows.select(*IN).groupBy("router_id").transformWithStateInPandas(RouterSessions(), outputStructType=OUT, outputMode="Append", timeMode="None")


def log_rows(results: DataFrame) -> DataFrame:
    """Session updates among the results as rows of the route log: one for each ingress, all families."""
    ops = results.filter(F.col("op").isin("withdraw_ingress", "reappear"))
    return ops.select("seq", "op", F.explode("ingress_ids").alias("ingress"), F.lit(None).cast("smallint").alias("family_afi"), F.lit(None).cast("string").alias("family_safi"))


def counts(results: DataFrame) -> DataFrame:
    """(router_id, phase, messages, invalid, unknown_peers, up_peers, pending): the last state of each router and what came of its messages."""
    return results.groupBy("router_id").agg(
        F.max_by("phase", "seq").alias("phase"), F.count(F.lit(1)).alias("messages"), F.count_if(F.col("result") == "invalid").alias("invalid"),
        F.count_if("unknown_peer").alias("unknown_peers"), F.max_by("up_peers", "seq").alias("up_peers"), F.max_by("pending", "seq").alias("pending"),
    )

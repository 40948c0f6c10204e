"""Wire formats, sinks, sessions, and the streaming table against the batch fold."""

import bz2
import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from prefixlake.functions import predicates as p
from prefixlake.functions.prefix import format_prefix, parse_prefix
from prefixlake.operators import covering, ingress, lists, rib, rov, search
from prefixlake.plans.queries import live_of, log_of
from prefixlake.sources import captures, sinks, wire
from prefixlake.streaming import bmp_sessions, route_table


def attr(code, data, flags=0x40):
    return bytes([flags, code, len(data)]) + data


def update(announced=(), withdrawn=(), asns=(64500, 64501), wide=True, extra=b""):
    pack = lambda ps: b"".join(bytes([n]) + bytes(b[: (n + 7) // 8]) for b, n in ps)
    path = bytes([2, len(asns)]) + b"".join(struct.pack(">I" if wide else ">H", a) for a in asns)
    attributes = (attr(1, b"\0") + attr(2, path) + attr(3, bytes([192, 0, 2, 1])) + extra) if announced else extra
    gone = pack(withdrawn)
    return struct.pack(">H", len(gone)) + gone + struct.pack(">H", len(attributes)) + attributes + pack(announced)


def bgp(body, kind=2):
    return b"\xff" * 16 + struct.pack(">HB", 19 + len(body), kind) + body


def peer(flags=0, asn=64500, last=1):
    return bytes([0, flags]) + bytes(8) + bytes(12) + bytes([10, 0, 0, last]) + struct.pack(">I", asn) + bytes([1, 1, 1, last]) + bytes(8)


def bmp(kind, body):
    return bytes([3]) + struct.pack(">IB", 6 + len(body), kind) + body


def open_message(graceful):
    caps = bytes([2, 4, 64, 2, 0, 120]) if graceful else b""
    return bgp(bytes([4]) + struct.pack(">HH", 64500, 90) + bytes(4) + bytes([len(caps)]) + caps, 1)


def peer_up(flags=0, last=1, graceful=False):
    return bmp(3, peer(flags, last=last) + bytes(20) + open_message(False) + open_message(graceful))


INIT = bmp(4, struct.pack(">HH", 2, 2) + b"r1" + struct.pack(">HH", 1, 1) + b"d")
NETS = [((10, 0, 0, 0), 8), ((10, 1, 0, 0), 16)]


def test_update_fields():
    communities = attr(8, struct.pack(">II", 0xFFFFFF01, 64500 << 16 | 7), 0xC0)
    large = attr(32, struct.pack(">III", 64500, 1, 2), 0xC0)
    v6 = attr(14, struct.pack(">HBB", 2, 1, 16) + bytes(16) + b"\0" + bytes([32, 0x20, 0x01, 0x0D, 0xB8]), 0x80)
    u = wire.bgp_update(update(NETS, [((10, 2, 0, 0), 15)], extra=communities + large + attr(35, struct.pack(">I", 9)) + v6))
    assert [x[2:] for x in u["announced"]] == [(8, "00001010"), (16, "0000101000000001"), (32, "00100000000000010000110110111000")]
    assert u["withdrawn"][0][2] == 15 and u["hops"] == [64500, 64501] and u["origin_asn"] == 64501
    assert u["communities"] == [0xFFFFFF01, 64500 << 16 | 7] and u["large_communities"] == [(64500, 1, 2)] and u["otc"] == 9
    assert wire.bgp_update(update())["eor"] == "1/1" and wire.as_path(bytes([2, 1, 0, 0, 0, 5, 1, 2, 0, 0, 0, 6, 0, 0, 0, 7]), 4) == [5, -1]
    for bad in (b"", b"\0", update(NETS)[:-2], struct.pack(">HH", 0, 9) + b"x"):
        with pytest.raises(ValueError):
            wire.bgp_update(bad)


def test_bmp_capture(spark, tmp_path):
    narrow = bmp(0, peer() + bgp(update(NETS[:1], wide=False, asns=(1, 2, 3))))
    broken = bmp(0, peer() + bgp(b"\0\0\0\x09x"))
    data = INIT + peer_up() + bmp(0, peer() + bgp(update(NETS))) + narrow + broken + bmp(1, peer() + bytes(4)) + bmp(2, peer() + b"\x01") + bmp(5, b"") + b"\x03\0\0"
    (tmp_path / "a.bmp").write_bytes(data)
    rows = captures.bmp_messages(captures.files(spark, str(tmp_path))).orderBy("number").collect()
    assert [r.msg_type for r in rows] == ["initiation", "peer_up", "route_monitoring", "route_monitoring", "route_monitoring", "statistics", "peer_down", "termination"]
    assert rows[0].sys_name == "r1" and rows[1].gr_capable is False and rows[2].origin_asn == 64501 and len(rows[2].announced) == 2
    assert rows[3].reparsed and rows[3].hops == [1, 2, 3] and rows[4].corrupt and not rows[5].corrupt
    with (tmp_path / "b.rec").open("wb") as f:
        for k, m in enumerate((INIT, peer_up())):
            f.write((1000 + k).to_bytes(16, "big") + struct.pack(">Q", len(m)) + m)
    again = captures.bmp_messages(captures.files(spark, f"{tmp_path}/b.rec"), recorded=True).orderBy("number").collect()
    assert [(r.time, r.msg_type) for r in again] == [(1000, "initiation"), (1001, "peer_up")]


def mrt(kind, sub, body, time=5):
    return struct.pack(">IHHI", time, kind, sub, len(body)) + body


@pytest.mark.parametrize("suffix,pack", [("", bytes), (".gz", gzip.compress), (".bz2", bz2.compress)])
def test_mrt(spark, tmp_path, suffix, pack):
    index = bytes(4) + struct.pack(">H", 1) + b"v" + struct.pack(">H", 2) + bytes([2, 9, 9, 9, 9, 10, 0, 0, 1]) + struct.pack(">I", 64500) + bytes([3, 9, 9, 9, 8]) + bytes(15) + b"\x01" + struct.pack(">I", 64501)
    attributes = attr(1, b"\0") + attr(2, bytes([2, 1]) + struct.pack(">I", 65000))
    entry = lambda k: struct.pack(">HIH", k, 7, len(attributes)) + attributes
    dump = mrt(13, 1, index) + mrt(13, 2, bytes(4) + bytes([8, 10]) + struct.pack(">H", 2) + entry(0) + entry(1))
    head = struct.pack(">IIHH", 64500, 1, 0, 1) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    updates = mrt(16, 4, head + bgp(update(NETS, NETS[:1]))) + mrt(16, 5, head + struct.pack(">HH", 6, 1)) + mrt(16, 4, head + bgp(b"", 4)) + mrt(16, 4, head + bgp(b"\0"))
    (tmp_path / f"x.mrt{suffix}").write_bytes(pack(dump + updates))
    source = captures.files(spark, str(tmp_path))
    rows = captures.mrt_dump(source).orderBy("number").collect()
    assert [(r.peer_asn, r.plen, r.bits, r.origin_asn) for r in rows] == [(64500, 8, "00001010", 65000), (64501, 8, "00001010", 65000)]
    found = captures.mrt_updates(source).orderBy("number")
    got = found.collect()
    assert [(r.corrupt, r.old_state, len(r.announced or [])) for r in got] == [(False, None, 2), (False, 6, 0), (True, None, 0)]
    assert captures.mrt_state_withdrawals(found).count() == 0 and captures.mrt_state_withdrawals(found, intended=True).count() == 1
    log = rib.exploded(found.filter("announced IS NOT NULL").select(F.col("number").alias("seq"), F.lit(1).alias("ingress_id"), "announced", "withdrawn", "origin_asn"))
    assert {(r.bits, r.route_status) for r in rib.fold(log).collect()} == {("00001010", "withdrawn"), ("0000101000000001", "active")}


def test_rtr(spark, tmp_path):
    pdu = lambda kind, body, session=1: struct.pack(">BBHI", 2, kind, session, 8 + len(body)) + body
    vrp = lambda flag, net, plen, top, asn: pdu(4, bytes([flag, plen, top, 0]) + bytes(net) + struct.pack(">I", asn))
    data = pdu(2, b"") + vrp(1, (10, 0, 0, 0), 8, 16, 1) + vrp(1, (11, 0, 0, 0), 8, 8, 2) + pdu(7, bytes(16)) + pdu(1, struct.pack(">I", 3)) + vrp(0, (11, 0, 0, 0), 8, 8, 2) + vrp(1, (12, 0, 0, 0), 8, 9, 3)
    (tmp_path / "s.rtr").write_bytes(data)
    log = captures.rtr_log(captures.files(spark, str(tmp_path)))
    assert [r.kind for r in log.orderBy("seq").collect()] == ["reset", "reset", "delta", "delta"]
    assert {(r.bits, r.maxlen, r.asn) for r in rov.current_vrps(log).collect()} == {("00001010", 16, 1), ("00001100", 9, 3)}


ROV = [
    ([], "notFound"), ([("10.0.0.0/16", 24, 1)], "valid"), ([("10.0.0.0/16", 20, 1)], "invalid"), ([("10.0.0.0/16", 24, 2)], "invalid"),
    ([("10.0.0.0/16", 20, 1), ("10.0.0.0/8", 24, 1)], "valid"), ([("10.0.0.0/25", 25, 1)], "notFound"), ([("0.0.0.0/0", 32, 1)], "valid"),
]


@pytest.mark.parametrize("vrps,want", ROV)
def test_rov_cases(spark, vrps, want):
    table = spark.createDataFrame(vrps, "prefix string, maxlen int, asn bigint").select(parse_prefix(F.col("prefix")).alias("p"), "maxlen", "asn").select("p.*", "maxlen", "asn")
    routes = spark.createDataFrame([("10.0.0.0/24", 1), ("224.0.0.0/24", 1), ("10.0.0.0/24", None)], "prefix string, origin_asn bigint").select(parse_prefix(F.col("prefix")).alias("p"), "origin_asn").select("p.*", "origin_asn")
    got = {(r.bits[:4], r.origin_asn): r.rov for r in rov.validate(routes, table).collect()}
    assert got == {("0000", 1): want, ("1110", 1): "notChecked", ("0000", None): "notChecked"}


def test_prefix_texts(spark):
    texts = ["10.1.2.3/8", "0.0.0.0/0", "2001:db8::/32", "::/0", "::1", "1:2:3:4:5:6:7:8/128", "::ffff:1.2.3.4/128", "fe80::1:0/112", "300", "10.0.0.0/33", "x/8", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_prefix(F.col("t")).alias("p")).select("t", "p.*", F.when(F.col("p").isNotNull(), format_prefix(F.col("p.afi"), F.col("p.plen"), F.col("p.bits"))).alias("back")).collect()
    got = {r.t: r.back for r in rows}
    assert got == {
        "10.1.2.3/8": "10.0.0.0/8", "0.0.0.0/0": "0.0.0.0/0", "2001:db8::/32": "2001:db8::/32", "::/0": "::/0", "::1": "::1/128",
        "1:2:3:4:5:6:7:8/128": "1:2:3:4:5:6:7:8/128", "::ffff:1.2.3.4/128": "::ffff:102:304/128", "fe80::1:0/112": "fe80::1:0/112", "300": None, "10.0.0.0/33": None, "x/8": None, None: None,
    }


def test_covering_against_nested_loop(spark):
    rows = spark.range(400).selectExpr("CAST(1 AS SMALLINT) AS afi", "substring(lpad(bin(id * 37 % 256), 8, '0'), 1, CAST(id % 9 AS INT)) AS bits").withColumn("plen", F.length("bits").cast("smallint")).distinct()
    plain = [r.bits for r in rows.collect()]
    for strict in (False, True):
        got = sorted((r.bits, r.outer_bits) for r in covering.covering_join(rows, rows, strict=strict).collect())
        assert got == sorted((a, b) for a in plain for b in plain if a.startswith(b) and not (strict and a == b))
    assert covering.covering_join(rows, rows, lengths=list(range(9))).count() == len(got) + len(plain)
    plan = covering.covering_join(rows, rows, lengths=list(range(9)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    left = covering.covering_join(rows, rows.filter("bits = '1'"), "left")
    assert left.count() == len(plain) and left.filter("outer_bits IS NOT NULL").count() == sum(b.startswith("1") for b in plain)


def test_register(spark):
    updates = spark.createDataFrame([(1, 7, 65536, None), (2, 7, 65537, None), (3, 7, None, "loc")], "seq long, ingress_id long, local_asn long, peer_rib_type string")
    assert [(r.local_asn, r.peer_rib_type) for r in ingress.merged(updates).collect()] == [(65537, "loc")]
    schema = "ingress_id long, parent_ingress long, remote_addr string, remote_asn long, peer_rib_type string, peer_type string, distinguisher string, vrf_name string"
    wanted = lambda *row: ingress.find_peers(stored, spark.createDataFrame([row], schema.replace("ingress_id", "query_id", 1))).first().ingress_id
    stored = spark.createDataFrame([(5, 1, "1.2.3.4", 65000, None, None, None, None)], schema)
    assert wanted(0, 1, "1.2.3.4", 65000, None, None, None, None) == 5
    stored = spark.createDataFrame([(5, 1, "1.2.3.4", 65000, None, "global", "aa", None)], schema)
    assert wanted(0, 1, "1.2.3.4", 65000, None, "global", "aa", None) == 5
    assert wanted(0, 1, "1.2.3.4", 65000, None, None, "aa", None) is None
    assert wanted(0, 1, "1.2.3.4", 65000, None, "global", "bb", None) is None


def test_filters(spark):
    rows = spark.createDataFrame([(1, [1, 2], 3), (2, [1, 3], 3), (3, None, 3), (4, [1], None)], "id long, hops array<bigint>, otc bigint")
    assert [r.id for r in p.accepted(rows, "hidden-hop").collect()] == [1]
    assert p.accepted(rows, None).count() == 4
    with pytest.raises(KeyError):
        p.accepted(rows, "absent")
    with pytest.raises(ValueError):
        search.search_routes(rows, rows, 1, "", None, ("everything",))
    with pytest.warns(UserWarning):
        assert lists.asn_lists(spark, {f"l{k}": "1 x AS2" for k in range(70)}).count() == 128


def message(seq, kind, peer="p", flags=0, gr=False, readable=True, eor=None, family=None):
    return (seq, 1, kind, peer, flags, gr, readable, eor, family, "r" if kind == "initiation" else None)


SCHEMA = "seq long, router_id long, msg_type string, peer string, flags int, gr_capable boolean, readable boolean, eor string, family string, sys_name string"
CASES = {
    "initiate": ([message(0, "initiation")], [("state", "dumping")]),
    "terminate": ([message(0, "initiation"), message(1, "termination"), message(2, "peer_up")], [("state", "dumping"), ("state", "terminated"), ("invalid", "terminated")]),
    "first must be initiation": ([message(0, "peer_up")], [("invalid", "initiating")]),
    "statistics": ([message(0, "initiation"), message(1, "statistics")], [("state", "dumping"), ("other", "dumping")]),
    "twice up": ([message(0, "initiation"), message(1, "peer_up"), message(2, "peer_up")], [("state", "dumping"), ("other", "dumping"), ("invalid", "dumping")]),
    "up, routes, down, up": ([message(0, "initiation"), message(1, "peer_up"), message(2, "route_monitoring", family="f"), message(3, "peer_down"), message(4, "peer_up")], [("state", "dumping"), ("other", "dumping"), ("routing", "dumping"), ("routing", "dumping"), ("routing", "dumping")]),
    "down without up": ([message(0, "initiation"), message(1, "peer_down")], [("state", "dumping"), ("invalid", "dumping")]),
    "other peer down": ([message(0, "initiation"), message(1, "peer_up"), message(2, "peer_down", "q")], [("state", "dumping"), ("other", "dumping"), ("invalid", "dumping")]),
    "end of rib": ([message(0, "initiation"), message(1, "peer_up", gr=True), message(2, "route_monitoring", family="f"), message(3, "route_monitoring", eor="f"), message(4, "route_monitoring", family="f")], [("state", "dumping"), ("other", "dumping"), ("routing", "dumping"), ("state", "updating"), ("routing", "updating")]),
    "end of rib with none to come": ([message(0, "initiation"), message(1, "peer_up"), message(2, "route_monitoring", eor="f")], [("state", "dumping"), ("other", "dumping"), ("state", "updating")]),
    "unknown peer": ([message(0, "initiation"), message(1, "route_monitoring")], [("state", "dumping"), ("invalid", "dumping")]),
    "flags cleared": ([message(0, "initiation"), message(1, "peer_up"), message(2, "route_monitoring", flags=0x40), message(3, "termination")], [("state", "dumping"), ("other", "dumping"), ("routing", "dumping"), ("routing", "terminated")]),
}


def test_sessions(spark):
    rows = [(m[0], k, *m[2:]) for k, (ms, _) in enumerate(CASES.values()) for m in ms]
    got: dict = {}
    for r in bmp_sessions.replay(spark.createDataFrame(rows, SCHEMA)).orderBy("router_id", "seq").collect():
        got.setdefault(r.router_id, []).append((r.result, r.phase))
    for k, (name, (_, want)) in enumerate(CASES.items()):
        assert got[k] == want, name
    withdrawn = bmp_sessions.log_rows(bmp_sessions.replay(spark.createDataFrame([(m[0], 1, *m[2:]) for m in CASES["flags cleared"][0]], SCHEMA)))
    assert sorted(r.ingress for r in withdrawn.collect()) == ["p|0", "p|64"]


def test_sessions_replayed_by_peer(spark, monkeypatch):
    """Peers apart from each other and sums in chunks give what one pass over each router gives."""
    monkeypatch.setattr(bmp_sessions, "CHUNK_BITS", 4)
    draw = random.Random(5)
    kinds = ["initiation"] * 2 + ["peer_up"] * 20 + ["peer_down"] * 10 + ["route_monitoring"] * 60 + ["statistics"] * 5
    rows = []
    for router in range(12):
        names = kinds + ["termination", "disconnect"][: router % 3]
        for k in range(200):
            kind = "initiation" if k == 3 and router % 4 else draw.choice(names[:95] if k < 120 and router % 2 else names)
            eor, family = draw.choice([(None, None), (None, "f"), (None, "g"), ("f", None), ("g", None), ("f", "g")])
            rows.append((k * 3 - 50, router, kind, draw.choice("pqr"), draw.choice([0, 0x40, 0x10, 0x80, 0xC0]), draw.random() < 0.7, draw.random() < 0.9, eor, family, "r"))
    want = []
    for router in range(12):
        state = bmp_sessions.new_state()
        for r in rows:
            if r[1] == router:
                m = dict(zip(bmp_sessions.IN, r, strict=True))
                want.append(bmp_sessions._out(m, state, bmp_sessions.step(state, m)))
    got = [tuple(r) for r in bmp_sessions.replay(spark.createDataFrame(rows, SCHEMA)).orderBy("router_id", "seq").collect()]
    assert got == want
    assert {"updating", "terminated", "dumping", "initiating"} == {w[5] for w in want} and any(len(w[4]) > 1 for w in want)
    plan = bmp_sessions.replay(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert dealt and all("peer#" in line for line in dealt)


def test_sessions_step_reads_one_peer():
    class Peers(dict):
        def values(self):
            raise AssertionError("a message went through all peers")

    state = bmp_sessions.new_state()
    state["peers"] = Peers()
    for m in CASES["end of rib"][0]:
        m = dict(zip(bmp_sessions.IN, m, strict=True))
        bmp_sessions._out(m, state, bmp_sessions.step(state, m))
    assert state["phase"] == "updating" and isinstance(state["known"], dict)


def run_stream(spark, rows, path, transform, order="seq", parts=3):
    """Rows as files, one micro-batch each, through a streaming query; its rows with batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", route_table.STORE["spark.sql.streaming.stateStore.providerClass"])
    schema = rows.schema
    held = rows.orderBy(order).collect()
    step = -(-len(held) // parts)
    for k in range(parts):
        spark.createDataFrame(held[k * step : (k + 1) * step], schema).coalesce(1).write.parquet(f"{path}/in/{k}")
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    query = transform(stream).writeStream.outputMode("update" if transform is route_table.upserts else "append").foreachBatch(lambda df, k: out.extend((k, *r) for r in df.collect())).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return out


def test_stream_equals_batch(spark, tmp_path):
    log = log_of(spark, "/root/testdata/sf0.001").filter("seq < 600 OR seq % 997 = 500").withColumn("op", F.when(F.col("seq") == 450, "withdraw_ingress").otherwise(F.col("op")))
    want = {(*(r[c] for c in rib.KEY), r.last_seq, r.status, r.origin_asn) for r in rib.with_sessions(rib.fold(log), log).collect()}
    rows = run_stream(spark, log, tmp_path, route_table.upserts)
    frame = spark.createDataFrame(rows, f"batch long, {route_table.OUT}")
    last = route_table.latest(frame, "batch")
    got = {(*(r[c] for c in rib.KEY), r.last_seq, "withdrawn" if r.session_down else r.route_status, r.origin) for r in last.withColumn("origin", F.get_json_object("attributes", "$.origin_asn").cast("bigint")).collect()}
    assert got == want


def test_sessions_stream(spark, tmp_path):
    rows = spark.createDataFrame([(m[0], k, *m[2:]) for k, (ms, _) in enumerate(CASES.values()) for m in ms], SCHEMA)
    want = {tuple(map(str, r)) for r in bmp_sessions.replay(rows).collect()}
    assert {tuple(map(str, r[1:])) for r in run_stream(spark, rows, tmp_path, bmp_sessions.live)} == want


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, None), (2, "x", None), (3, None, "own")], "a long, b string, custom string").withColumn("custom_at", F.timestamp_seconds(F.lit(0)))
    text = lambda kind: sorted(r.value for r in sinks.lines(rows, kind).collect())
    assert text("json") == ["own", '{"a":1,"b":null}', '{"a":2,"b":"x"}'] and text("json-min") == ["own", '{"a":1}', '{"a":2,"b":"x"}']
    assert [r.value for r in sinks.lines(rows.withColumn("custom_at", F.timestamp_seconds(F.lit(60))).filter("a = 3")).collect()] == ["[1970-01-01T00:01:00+00:00] own"]
    with pytest.raises(ValueError):
        sinks.lines(rows, "xml")
    for kind in ("csv", "json"):
        sinks.write_file(rows, f"{tmp_path}/out", kind)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == text("json")
    sinks.discard(rows)
    target = str(tmp_path / "sent")
    sent = spark.createDataFrame([(1, "t", "one"), (2, "t", "two")], "seq long, topic string, body string").coalesce(1)
    sinks.publish(sent, lambda: lambda topic, body: open(target, "a").write(f"{topic} {body}\n"))
    assert open(target).read() == "t one\nt two\n"


def test_entry_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert live_of(spark, "/root/testdata/sf0.001").count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_collector(spark, tmp_path):
    from prefixlake.plans import collector

    head = struct.pack(">IIHH", 64500, 1, 0, 1) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    (tmp_path / "u.mrt").write_bytes(mrt(16, 4, head + bgp(update(NETS))) + mrt(16, 4, head + bgp(update((), NETS[:1]))))
    text = f'[units.a]\nkind = "mrt-updates"\npaths = "{tmp_path}/u.mrt"\n[targets.out]\npath = "{tmp_path}/out"\nformat = "json-min"\n'
    rows = collector.run(spark, collector.load(text)).collect()
    assert {(r.plen, r.route_status) for r in rows} == {(8, "withdrawn"), (16, "active")}
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    attributes = attr(1, b"\0") + attr(2, bytes([2, 1]) + struct.pack(">I", 65000))
    index = bytes(4) + struct.pack(">H", 1) + b"v" + struct.pack(">H", 1) + bytes([2, 9, 9, 9, 9, 10, 0, 0, 1]) + struct.pack(">I", 64500)
    entry = lambda k, a=attributes: struct.pack(">HIH", k, 7, len(a)) + a
    v6 = attributes + attr(14, bytes([16]) + bytes([0x20, 1, 0xD, 0xB8]) + bytes(11) + b"\x01", 0x80)
    dump = mrt(13, 1, index, 4) + mrt(13, 2, bytes(4) + bytes([8, 10]) + struct.pack(">H", 1) + entry(5), 4) + mrt(13, 2, bytes(4) + bytes([8, 10]) + struct.pack(">H", 1) + entry(0), 4)
    (tmp_path / "d.mrt").write_bytes(dump + mrt(13, 4, bytes(4) + bytes([16, 0x20, 1]) + struct.pack(">H", 1) + entry(0, v6), 4))
    got = captures.mrt_dump(captures.files(spark, f"{tmp_path}/d.mrt")).orderBy("number").collect()
    assert [(r.corrupt, r.next_hop) for r in got] == [(True, None), (False, None), (False, "2001:db8::1")]
    pdu = lambda kind, body, flags=0: struct.pack(">BBBBI", 2, kind, flags, 0, 8 + len(body)) + body
    rtr = pdu(2, b"") + pdu(4, bytes([1, 8, 16, 0, 10, 0, 0, 0]) + struct.pack(">I", 64501)) + pdu(9, b"k" * 20 + struct.pack(">I", 7) + b"pk", 1) + pdu(11, struct.pack(">III", 7, 8, 9), 1)
    (tmp_path / "s.rtr").write_bytes(rtr)
    source = captures.files(spark, f"{tmp_path}/s.rtr")
    assert [(r.asn, r.spki) for r in rov.current_set(captures.router_keys(source), ["ski", "asn", "spki"]).collect()] == [(7, b"pk".hex())]
    assert [(r.customer_asn, r.providers) for r in captures.aspas(source).collect()] == [(7, [8, 9])]
    (tmp_path / "r.bmp").write_bytes(INIT + peer_up() + bmp(0, peer() + bgp(update(NETS))) + peer_up(last=2) + bmp(0, peer(last=2) + bgp(update(NETS[1:]))) + bmp(2, peer(last=2) + b"\x01"))
    kinds = {"a": ("mrt-updates", "u.mrt"), "b": ("mrt-dump", "d.mrt"), "c": ("bmp", "r.bmp"), "d": ("rtr", "s.rtr")}
    text = "".join(f'[units.{n}]\nkind = "{k}"\npaths = "{tmp_path}/{f}"\n' for n, (k, f) in kinds.items())
    rows = collector.run(spark, collector.load(text)).collect()
    got = sorted((r.afi, r.plen, r.status, r.rov) for r in rows)
    # The dump's and the updates' 10.0.0.0/8 of one peer are one route; the second BMP peer went down.
    assert got == [(1, 8, "active", "valid"), (1, 8, "withdrawn", "valid"), (1, 16, "active", "valid"), (1, 16, "active", "valid"), (1, 16, "withdrawn", "valid"), (2, 16, "active", "notFound")]
    for bad in ("[unknown]\n", '[units.a]\nkind = "x"\npaths = "y"\nport = 1\n', '[units.a]\nkind = "x"\n'):
        with pytest.raises(ValueError):
            collector.load(bad)
    with pytest.raises(ValueError):
        collector.run(spark, collector.load('[units.a]\nkind = "tcp"\npaths = "y"\n'))

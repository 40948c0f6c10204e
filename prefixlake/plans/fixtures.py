"""Routing tables derived from the driver's tables by integer arithmetic: one SQL text that Spark and DuckDB run alike."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Views over all of events, part and supplier. Lists are texts with one blank between. Prefixes: 40 bases that all ingresses share, and 40 more for each 400 events;
#: one base in five is IPv6. Ingresses: one for each supplier, ten more in the log for each 4,000 events. VRPs: one for each part. IPv4 bits start with 1, IPv6 bits with 0.
VIEWS = """
picked AS (SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS received_at, event_type, CAST(floor(event_id / 4000) AS BIGINT) * 10 + user_id % 10 AS peer,
    CAST(floor(((event_id * 7919) % 200) / 40) AS INT) AS step,
    (event_id * 7919) % 40 + CASE WHEN CAST(floor(event_id / 200) AS BIGINT) % 2 = 0 THEN 0 ELSE 40 + CAST(floor(event_id / 400) AS BIGINT) * 40 END AS base_no,
    CAST(64512 + (event_id * 31) % 7 AS BIGINT) AS plain_origin FROM events),
base AS (SELECT *, CAST(CASE WHEN peer < 90 THEN peer + 1 ELSE peer + 911 END AS BIGINT) AS ingress_id,
    CASE WHEN base_no % 5 = 4 THEN concat('0010000000000001', lpad(bin(CAST((base_no * 2654435761) % 4294967296 AS BIGINT)), 32, '0'), '0000000000000000')
        ELSE concat('1', lpad(bin(CAST((base_no * 2654435761) % 2147483648 AS BIGINT)), 31, '0')) END AS address,
    CASE WHEN base_no % 5 = 4 THEN 24 + step * 8 ELSE 12 + step * 4 END AS width FROM picked),
route_log AS (SELECT seq, received_at, ingress_id,
    CASE WHEN seq % 53 = 0 THEN 'multicast' ELSE 'unicast' END AS safi, CAST(CASE WHEN base_no % 5 = 4 THEN 2 ELSE 1 END AS SMALLINT) AS afi,
    CAST(width AS SMALLINT) AS plen, substring(address, 1, CAST(width AS INT)) AS bits,
    CASE WHEN seq % 997 = 0 THEN 'withdraw_ingress' WHEN seq % 997 = 500 THEN 'reappear' WHEN event_type = 'error' THEN 'withdraw' ELSE 'announce' END AS op,
    CASE WHEN seq % 37 <> 0 THEN plain_origin END AS origin_asn,
    concat(CAST(64600 + ingress_id AS VARCHAR(20)), ' ', CAST(64700 + (seq * 13) % 11 AS VARCHAR(20)), ' ',
        CASE WHEN seq % 3 = 0 THEN '64800 ' ELSE '' END, CASE WHEN seq % 37 = 0 THEN '-1' ELSE CAST(plain_origin AS VARCHAR(20)) END) AS hops_text,
    trim(concat(CASE WHEN seq % 5 = 0 THEN '4294967041 ' ELSE '' END, CASE WHEN seq % 2 = 0 THEN CAST(4227858432 + seq % 100 AS VARCHAR(20)) ELSE '' END)) AS communities_text,
    CASE WHEN seq % 6 = 0 THEN concat('64512:1:', CAST(seq % 9 AS VARCHAR(20))) ELSE '' END AS large_text,
    CASE WHEN seq % 8 = 0 THEN CAST(64700 + (seq * 13 + CASE WHEN seq % 16 = 0 THEN 1 ELSE 0 END) % 11 AS BIGINT) END AS otc,
    concat(CASE WHEN base_no % 5 = 4 THEN '2001:db8::' ELSE '192.0.2.' END, CAST(ingress_id % 250 AS VARCHAR(20))) AS next_hop
    FROM base),
ingress AS (SELECT CAST(CASE WHEN s_suppkey < 90 THEN s_suppkey + 1 ELSE s_suppkey + 911 END AS BIGINT) AS ingress_id,
    CAST(CASE WHEN s_suppkey < 30 THEN 101 + s_suppkey % 3 ELSE 10000007 + CAST(floor(s_suppkey / 25) AS BIGINT) * 25 END AS BIGINT) AS parent_ingress,
    CASE WHEN s_suppkey <> 6 THEN CAST(64600 + (s_suppkey + 1) % 6 + CAST(floor(s_suppkey / 10) AS BIGINT) * 10 AS BIGINT) END AS remote_asn,
    CASE WHEN s_suppkey = 8 THEN NULL WHEN s_suppkey % 7 = 5 THEN concat('2001:db8::', CAST(s_suppkey AS VARCHAR(20)))
        ELSE concat('10.', CAST(CAST(floor(s_suppkey / 2560) AS BIGINT) % 256 AS VARCHAR(20)), '.', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) % 256 AS VARCHAR(20)), '.', CAST((s_suppkey + 1) % 6 AS VARCHAR(20))) END AS remote_addr,
    CASE s_suppkey % 4 WHEN 1 THEN 'bgp' WHEN 2 THEN 'mrt' ELSE 'bgpViaBmp' END AS ingress_type,
    CASE WHEN s_suppkey % 3 = 2 THEN 'Disconnected' ELSE 'Connected' END AS state,
    CASE s_suppkey % 6 WHEN 0 THEN 'inPre' WHEN 1 THEN 'inPost' WHEN 2 THEN 'loc' WHEN 3 THEN 'outPre' WHEN 4 THEN 'outPost' END AS peer_rib_type,
    CASE WHEN s_suppkey <> 4 THEN CAST(s_suppkey % 5 AS INT) END AS local_role, CAST((s_suppkey * 3) % 5 AS INT) AS remote_role,
    CAST(NULL AS VARCHAR(20)) AS name FROM supplier
    UNION ALL SELECT CAST(CASE WHEN s_suppkey < 3 THEN 101 + s_suppkey ELSE 10000000 + s_suppkey END AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS BIGINT), concat('172.16.0.', CAST(s_suppkey AS VARCHAR(20))),
    CASE WHEN s_suppkey % 25 <> 2 THEN 'bmp' ELSE 'mrt' END, CASE WHEN s_suppkey % 2 = 1 AND s_suppkey < 30 THEN 'Disconnected' ELSE 'Connected' END, CAST(NULL AS VARCHAR(20)), CAST(NULL AS INT), CAST(NULL AS INT),
    concat('router', CAST(s_suppkey AS VARCHAR(20))) FROM supplier WHERE s_suppkey IN (0, 1, 2) OR s_suppkey % 25 = 7),
sized AS (SELECT *, p_partkey % 5 = 4 AS v6, CAST(CASE WHEN p_partkey % 5 = 4 THEN 24 + (p_partkey % 4) * 8 ELSE 12 + (p_partkey % 4) * 4 END AS INT) AS width FROM part),
vrps AS (SELECT DISTINCT CAST(CASE WHEN v6 THEN 2 ELSE 1 END AS SMALLINT) AS afi, CAST(width AS SMALLINT) AS plen,
    substring(CASE WHEN v6 THEN concat('0010000000000001', lpad(bin(CAST((p_partkey * 2654435761) % 4294967296 AS BIGINT)), 32, '0'))
        ELSE concat('1', lpad(bin(CAST((p_partkey * 2654435761) % 2147483648 AS BIGINT)), 31, '0')) END, 1, width) AS bits,
    CAST(64512 + p_partkey % 7 AS BIGINT) AS asn, CAST(width + p_size % 9 AS INT) AS maxlen FROM sized)
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS; lists become arrays."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "part", "supplier")}
    text = VIEWS.replace("FROM events", "FROM {events}").replace("FROM part", "FROM {part}").replace("FROM supplier", "FROM {supplier}")
    df = spark.sql(f"WITH {text} SELECT * FROM {name}", **frames)
    if name != "route_log":
        return df
    numbers = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: x.cast("bigint"))
    large = F.transform(F.filter(F.split("large_text", " "), lambda x: x != ""), lambda x: F.struct(*(F.split(x, ":")[k].cast("bigint").alias(n) for k, n in enumerate("gab"))))
    codes = F.array_compact(F.array(F.lit(1), F.lit(2), F.lit(3), F.when(F.col("communities_text") != "", 8), F.when(F.col("large_text") != "", 32), F.when(F.col("otc").isNotNull(), 35)))
    return (
        df.withColumns({"hops": numbers("hops_text"), "communities": numbers("communities_text"), "large_communities": large, "attr_codes": codes.cast("array<smallint>")})
        .withColumns({"family_afi": F.lit(None).cast("smallint"), "family_safi": F.lit(None).cast("string")})
        .drop("hops_text", "communities_text", "large_text")
    )

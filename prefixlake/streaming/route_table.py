"""The routing table kept up to date from a stream of updates: the fold of operators.rib, a micro-batch at a time."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prefixlake.operators.rib import KEY, NOT_ATTRIBUTES

#: An ingress's routes are dealt to so many keys by prefix, so that one large session is not one task's work.
SALTS = 64
STATE = "last_seq bigint, status string, announced_seq bigint, plen smallint, attributes string"
OUT = "safi string, afi smallint, plen smallint, bits string, ingress_id bigint, last_seq bigint, announced_seq bigint, route_status string, session_down boolean, attributes string"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class RouteTable(StatefulProcessor):
    """State of a part of an ingress: its routes, and the last session updates by family. Rows may come in any order: the greatest seq wins."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.routes = handle.getMapState("routes", "safi string, afi smallint, bits string", STATE)
        self.sessions = handle.getMapState("sessions", "safi string, afi smallint", "seq bigint, down boolean")

    def _down(self, safi: str, afi: int) -> bool:
        found = [self.sessions.getValue(k) for k in (("", 0), (safi, afi)) if self.sessions.containsKey(k)]
        return bool(max(found)[1]) if found else False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[tuple, None] = {}
        again = False
        for part in rows:
            for r in part.sort_values("seq").to_dict("records"):
                if r["op"] in ("withdraw_ingress", "reappear"):
                    family = ("", 0) if r["family_safi"] is None or pd.isna(r["family_afi"]) else (r["family_safi"], int(r["family_afi"]))
                    if not self.sessions.containsKey(family) or self.sessions.getValue(family)[0] < r["seq"]:
                        self.sessions.updateValue(family, (int(r["seq"]), r["op"] == "withdraw_ingress"))
                        again = True
                    continue
                if r["op"] not in ("announce", "withdraw"):
                    continue
                route = (r["safi"], int(r["afi"]), r["bits"])
                last, status, announced, plen, attributes = self.routes.getValue(route) if self.routes.containsKey(route) else (-1, "", -1, int(r["plen"]), None)
                seq = int(r["seq"])
                if seq > last:
                    last, status = seq, "active" if r["op"] == "announce" else "withdrawn"
                if r["op"] == "announce" and seq > announced:
                    announced, attributes = seq, r["attributes"]
                self.routes.updateValue(route, (last, status, announced, plen, attributes))
                touched[route] = None
        if again:
            touched |= dict.fromkeys(tuple(k) for k in self.routes.keys())
        out = []
        for safi, afi, bits in touched:
            last, status, announced, plen, attributes = self.routes.getValue((safi, afi, bits))
            out.append((safi, afi, plen, bits, int(key[0]), last, announced if announced >= 0 else None, status, self._down(safi, afi), attributes))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"announced_seq": "Int64"})

    def close(self) -> None:
        pass


def with_keys(log: DataFrame) -> DataFrame:
    """Log rows with salt and attributes as JSON; session updates go to every salt."""
    names = [c for c in log.columns if c not in NOT_ATTRIBUTES]
    control = F.col("op").isin("withdraw_ingress", "reappear")
    salts = F.when(control, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.pmod(F.xxhash64("safi", "bits"), F.lit(SALTS)).cast("int")))
    kept = [*("seq", "op", "family_afi", "family_safi"), *KEY]
    return log.select(*kept, F.to_json(F.struct(*names)).alias("attributes")).withColumn("salt", F.explode(salts))


def upserts(log: DataFrame) -> DataFrame:
    """Changed rows of the table (OUT, with attributes as JSON) for each micro-batch of a streaming log (columns of operators.rib).

    The session needs the state store of STORE. Take the row with the greatest batch for each key, or write them in
    foreachBatch to a table by key.
    """
    return with_keys(log).groupBy("ingress_id", "salt").transformWithStateInPandas(RouteTable(), outputStructType=OUT, outputMode="Update", timeMode="None")


def latest(rows: DataFrame, version: str) -> DataFrame:
    """The table from all upserts so far: of each key the row with the greatest `version`, unannounced keys left out."""
    kept = [c for c in rows.columns if c not in (*KEY, version)]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*kept), version).alias("r")).select(*KEY, "r.*").filter("announced_seq IS NOT NULL")

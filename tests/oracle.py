"""A query in Spark beside its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


KINDS = {"smallint": "smallint", "integer": "int", "bigint": "bigint", "double": "double", "varchar": "string", "boolean": "boolean"}


def plain(x):
    return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x


def same(spark, query, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    want = views(sf_dir).execute(sql)
    kinds = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in want.description}
    got = dict(df.dtypes)
    if kinds != got:
        return f"columns: {got} in Spark, {kinds} in DuckDB"
    order = sorted(kinds)
    at = {d[0]: k for k, d in enumerate(want.description)}
    one = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    two = Counter(tuple(plain(r[at[c]]) for c in order) for r in want.fetchall())
    if one != two:
        return f"{sum(one.values())} rows in Spark, {sum(two.values())} in DuckDB; only in Spark {list((one - two).items())[:3]}; only in DuckDB {list((two - one).items())[:3]}"
    return None

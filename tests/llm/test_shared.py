"""Joins in which only some rows move."""

import numpy as np
import pytest

from prefixlake.llm import exact_dedup, shared


@pytest.mark.parametrize("bits", [1 << 24, 1 << 16])
def test_split_by(spark, monkeypatch, bits):
    """Whatever hashes meet, no row that has a key is told to have none; nulls are values."""
    monkeypatch.setattr(shared, "MAP_BITS", bits)
    rng = np.random.default_rng(4)
    ids = rng.integers(-(2**62), 2**62, 20_000).tolist()
    rows = spark.createDataFrame([*((i, str(i % 7)) for i in [*ids, *ids[:9]]), (None, None)], "a long, b string")
    keys = shared.written(spark.createDataFrame([(i, str(i % 7)) for i in ids[:5000]] + [(None, None)] + [(k, "x") for k in range(99)], "a long, b string"))
    may, rest = shared.split_by(rows, keys, ["a", "b"])
    found, others = {r.a for r in may.collect()}, {r.a for r in rest.collect()}
    assert found >= set(ids[:5000]) and not found & others and len(found | others) == len(set(ids)) + 1
    assert len(others) > (14_900 if bits > 1 << 20 else 10_000)
    left = shared.without(rows, keys.select("a"), ["a"])
    assert left.columns == ["a", "b"] and sorted(r.a for r in left.collect()) == sorted(ids[5000:])


def test_few_texts_move(spark, monkeypatch):
    """Where Spark broadcasts no dropped rows, only texts that may be dropped are dealt anew."""
    rows = spark.createDataFrame([(k, f"text {max(k, 40)}") for k in range(2000)], "doc_id long, text string")
    split, moved = shared.split_by, []
    monkeypatch.setattr(shared, "split_by", lambda *a: moved.append((found := split(*a))[0].count()) or found)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = exact_dedup.without_copies(rows).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.doc_id for r in kept) == list(range(40, 2000))
    assert len(moved) == 1 and 40 <= moved[0] < 60

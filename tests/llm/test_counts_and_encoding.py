"""Operators 1, 5, 7, 8 and 10 against brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefixlake.llm import encoding, exact_dedup, packing, quality, token_counts
from prefixlake.llm.bpe import Encoder
from prefixlake.llm.spans import Texts

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", " ", "\n\n's", "x's  y\n", "don't  you'll<|endoftext|>we've", "É漢字 ½ 😀!!", "\x1c\x85 a", "the " * 3000, "<|endoftext|>", " <|endoftext|> "]


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(3, "a", "x", 1), (3, "a", "x", 1), (None, "A", "y", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, row long")


def test_split_of_mixed_texts(library):
    rng = np.random.default_rng(1)
    parts = ["'s", "'t", "'re", "'", "''", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "<|endoftext|>", "漢", " ", "　", "՘", "\x1c", "\x85", "​", "'ve", "don't"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4000)]
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    _, _, ids, bounds = encoder.encode(Texts(texts))
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids, texts[k]


def test_encode_and_decode(spark, odd, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in encoding.decode(encoding.encode(docs)).collect())
    assert got == want
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in encoding.encode(docs, decoded=True).collect()) == want
    assert encoding.encode(docs.limit(0)).count() == 0
    encoding.drop_blocks(spark)
    assert not spark.catalog.listTables(pattern=f"{encoding.BLOCKS}*")


def test_histogram(spark, odd, library):
    lengths = [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()]
    h = token_counts.length_histogram(odd)
    rows = token_counts.context_limits(h).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == dict(Counter(lengths))
    for r in rows:
        assert r.docs_from == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert r.lost_tokens == sum(lengths) - r.truncated_total
        assert r.quantile == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
    asked = [0, 1, 2, 2, 100, 4095, 4096, 9000, 50_000]
    found = token_counts.at_limits(h, asked).collect()
    assert sorted(r.context_limit for r in found) == sorted(set(asked))
    assert [(r.truncated_total, r.docs_over) for r in token_counts.at_limits(h.limit(0), [7]).collect()] == [(0, 0)]
    for r in found:
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lengths)
        assert r.docs_over == sum(x > r.context_limit for x in lengths)
    assert token_counts.context_limits(token_counts.length_histogram(odd.limit(0))).count() == 0


def total_cost(places, costs, cuts, limit):
    paid, last = 0, 0
    for j in cuts:
        size = places[j] - places[last]
        assert 0 < size <= limit
        paid += costs[j] + (0 if size & (size - 1) == 0 else limit - size)
        last = j
    return paid


def test_cuts_are_least():
    rng = np.random.default_rng(2)
    for _ in range(60):
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 25))))
        costs = rng.integers(0, 12, 26)
        best = [0] + [10**9] * 25
        for j in range(1, 26):
            for i in range(j):
                size = places[j] - places[i]
                if size <= 16:
                    best[j] = min(best[j], best[i] + costs[j] + (0 if size & (size - 1) == 0 else 16 - size))
        assert total_cost(places, costs, packing.choose_cuts(places, costs, 16), 16) == best[-1]


def test_pack(spark, odd, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.filter("doc_id > 3 AND doc_id < 20").selectExpr("doc_id + 1000000 AS doc_id", "text"))
    pieces = packing.pack(docs).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for doc, own in pieces.sort_values("start").groupby("doc_id"):
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 0]
        assert b"".join(own.ids) == np.array(ids, "<u4").tobytes()
        assert (own.start == own.length.cumsum() - own.length).all() and (own.doc_tokens == len(ids)).all()
    assert set(pieces.doc_id) == set(texts)
    ordered = pieces.sort_values(["sequence_id", "offset"])
    total = ordered.groupby("sequence_id").length.sum()
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    assert total.max() <= 1024
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in total)
    assert padding < 0.02 * total.sum()
    assert packing.pack(docs.limit(0)).count() == 0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_quality_counts(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = Counter((r.doc_id, *brute_counts(r.text or "")) for r in docs.collect())
    rows = quality.rule_statistics(docs).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)


def test_quality_counts_all_labelled_rows(spark):
    """The forest's counts and those that set the threshold come from every labelled row."""
    rng = np.random.default_rng(3)
    n, k = 24_000, len(quality.SHARES)
    rows = rng.random((n, k)) * 0.1
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=list(quality.SHARES)).assign(doc_id=np.arange(n), base_failed=False))
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "quality": 1}))
    seen, calibrated, fitted = [], quality.calibrated, quality.IsolationForest.fit
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "calibrated", lambda scores, good, bad: seen.append(int(good.sum() + bad.sum())) or calibrated(scores, good, bad))
        m.setattr(quality.IsolationForest, "fit", lambda self, counts: seen.append(int(counts[0].sum())) or fitted(self, counts))
        quality.fit(frame, labels)
    assert sum(seen) == n


def test_quality_verdicts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    even = labels.filter("doc_id % 2 = 0")
    judged = quality.judge(docs, even).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r for r in judged if r.quality == 0]
    assert sum(not r.kept for r in good) <= 0.02 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    none = quality.judge(docs, labels.limit(0)).select("kept", "base_failed").collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.judge(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "word " * 80, 3)], "doc_id long, text string, kept int")
    assert quality.kept_documents(odd, labels).columns == odd.columns


def test_exact_dedup(spark, odd):
    rows = exact_dedup.deduplicate(odd).collect()
    assert len(rows) == odd.count()
    lower = {}
    for r in odd.collect():
        t = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        lower.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(r.doc_id)
    for r in rows:
        group = lower[r.text_sha256]
        assert r.group_size == len(group) and r.keep_id == max(x for x in group if x is not None)
    assert sum(r.kept for r in rows) == len(lower)
    kept = exact_dedup.without_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(lower)
    assert exact_dedup.deduplicate(odd.limit(0)).count() == 0


def test_index_persists(spark, tmp_path):
    path = f"{tmp_path}/index"
    first = spark.createDataFrame([(1, "a b"), (2, "A b"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a B"), (10, "d"), (11, "d")], "doc_id long, text string")
    run = lambda docs, batch: {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, path, 3), batch).collect()}
    assert run(first, "one") == {1: (2, False), 2: (2, True), 3: (3, True)}
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).name}")
    assert run(second, "two") == {9: (2, False), 10: (11, False), 11: (11, True)}
    assert run(second, "two") == {9: (2, False), 10: (11, False), 11: (11, True)}
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 3 and index.rows().count() == 3

"""Operators 3 and 9 against brute-force versions."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from prefixlake.llm import near_dedup, passages
from prefixlake.llm.spans import Texts, plain_words, windows

SF = "/root/testdata/sf0.001"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_spans(docs, least):
    """Words that lie in a window of `least` words which an earlier place has, by id."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        words = words_of(text)
        covered = set()
        for i in range(len(words) - least + 1):
            w = tuple(words[i : i + least])
            if w in seen:
                covered |= set(range(i, i + least))
            seen.add(w)
        out[doc] = covered
    return out


def planted(seed=3):
    """Texts of random words in which passages of 50 to 80 words repeat, and shorter ones that must stay."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short = [text(n) for n in (51, 60, 80, 52)], [text(48), text(40)]
    docs = [(0, None), (1, ""), (2, "few words only"), (3, "the " * 400)]
    for k in range(40):
        parts = [text(rng.integers(5, 90))]
        for p in rng.permutation(6)[: rng.integers(0, 3)]:
            parts += [long[p] if p < 4 else short[p - 4], text(rng.integers(1, 60))]
        docs.append((10 + k, ". ".join(parts)))
    return docs


@pytest.mark.parametrize("partitions", [1, 7])
def test_repeats_against_brute_force(spark, partitions):
    docs = planted()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = passages.repeated_passages(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = brute_spans(docs, 50)
    got = {d: set() for d, _ in docs}
    for r in rows:
        for s in r.spans:
            got[r.doc_id] |= set(range(s["start"], s["end"]))
    assert got == want
    assert sum(map(bool, want.values())) > 10


def test_small_chunks(spark, monkeypatch):
    """Seeds cut into many chunks, all of them hot: the repeats are found, all and no others."""
    monkeypatch.setattr(passages, "CHUNK", 24)
    docs = planted(9)
    want = brute_spans(docs, 50)
    got = {d: set() for d, _ in docs}
    for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        for s in r.spans:
            got[r.doc_id] |= set(range(s["start"], s["end"]))
    assert got == want


@pytest.mark.parametrize("partitions", [1, 5])
def test_nothing_lost_at_borders(spark, monkeypatch, partitions):
    """A hot seed cut into many chunks; two rows each share a window of 21 words before and after it, and many either half."""
    monkeypatch.setattr(passages, "CHUNK", 7)
    rng = np.random.default_rng(21)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    many = text(100_000)
    at = int(np.argmin(windows(plain_words(Texts([" ".join(many)]))[2], passages.SEED_WORDS)))
    seed = many[at : at + passages.SEED_WORDS]
    lefts, rights = [text(21) for _ in range(9)], [text(21) for _ in range(9)]
    docs = [(i, " ".join(text(30) + lefts[i % 9] + seed + rights[i // 9 % 9] + text(30))) for i in rng.permutation(162).tolist()]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = {d: set() for d, _ in docs}
    for r in rows:
        for x in r.spans:
            got[r.doc_id] |= set(range(x["start"], x["end"]))
    want = brute_spans(docs, 50)
    assert sum(map(bool, want.values())) == 81 and got == want


def test_cut_texts(spark):
    docs = planted(5)
    frame = spark.createDataFrame([(i, t, "k", [1], None) for i, t in docs], "doc_id long, text string, key string, spans array<int>, after string")
    cut = passages.without_repeats(frame)
    assert cut.dtypes == frame.dtypes
    rows = {r.doc_id: r.text for r in cut.collect()}
    covered = brute_spans(docs, 50)
    assert len(rows) == len(docs) and rows[0] is None
    for doc, text in docs:
        assert words_of(rows[doc]) == [w for i, w in enumerate(words_of(text)) if i not in covered[doc]]
        if not covered[doc]:
            assert rows[doc] == text
    assert passages.without_repeats(frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, docs[10][1]), (1, docs[10][1]), (None, "x " + docs[10][1])], "doc_id long, text string")
    assert passages.without_repeats(twice).count() == 3


def test_real_repeats(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_spans(docs, 50)
    got = {d: set() for d, _ in docs}
    for r in passages.repeated_passages(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        for s in r.spans:
            got[r.doc_id] |= set(range(s["start"], s["end"]))
    missed = sum(len(want[d] - got[d]) for d in want)
    extra = sum(len(got[d] - want[d]) for d in want)
    total = sum(map(len, want.values()))
    assert missed == extra == 0 < total


def test_samples_estimate_similarity():
    rng = np.random.default_rng(4)
    shingles = np.sort(rng.integers(0, 2**63, 800).astype(np.uint64))
    weights = rng.uniform(1, 2, 800).astype(np.float32)
    one, two = np.arange(800) < 700, np.arange(800) >= 100
    owner = np.concatenate((np.zeros(700, int), np.ones(700, int)))
    found = near_dedup.weighted_samples(owner, np.concatenate((shingles[one], shingles[two])), np.concatenate((weights[one], weights[two])), 2, 1500)
    want = weights[one & two].sum() / weights.sum()
    assert abs((found[0] == found[1]).mean() - want) < 0.05


def shingles_of(text):
    """Distinct runs of five words with their counts, as tuples."""
    words = words_of(text)
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


@pytest.mark.parametrize("counted", [1 << 22, 500])
def test_document_frequencies(spark, monkeypatch, counted):
    """Counts of all shingles equal those of a brute-force count; weights follow from them."""
    monkeypatch.setattr(near_dedup, "COUNTED", counted)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionByName(spark.createDataFrame([(None,), ("",), ("a b",), ("same words over and over again",)] * 30, "text string"))
    texts = [r.text for r in docs.collect()]
    df = Counter(x for t in texts for x in shingles_of(t))
    found = near_dedup.document_frequencies(docs, 1).collect()
    assert len({r.shingle for r in found}) == len(found) == len(df)
    assert Counter(r.df for r in found) == Counter(df.values())
    least = near_dedup.document_frequencies(docs, 3).collect()
    assert Counter(r.df for r in least) == Counter(n for n in df.values() if n >= 3)
    weights = near_dedup.idf_weights(docs)
    for text in texts:
        _, shingles, count, _ = near_dedup.shingle_sets(Texts([text or ""]))
        n = len(texts)
        want = sorted((1 + 0.25 * np.log(n / df[x]) / np.log(n), c) for x, c in shingles_of(text).items())
        assert np.allclose(sorted(zip(weights.of(shingles).tolist(), count.tolist(), strict=True)), want) if want else not len(shingles)


def similarity(one, two, weights):
    x, y = ({s: w for s, w in zip(s.tolist(), (weights.of(s) * c).tolist(), strict=True)} for _, s, c, _ in (near_dedup.shingle_sets(Texts([t])) for t in (one, two)))
    low = sum(min(w, y[s]) for s, w in x.items() if s in y)
    return low / (sum(x.values()) + sum(y.values()) - low)


def brute_classes(docs, weights, threshold=0.8):
    """Classes by comparing all pairs."""
    sets = {}
    for doc, text in docs:
        owner, shingles, count, _ = near_dedup.shingle_sets(Texts([text or ""]))
        sets[doc] = dict(zip(shingles.tolist(), (weights.of(shingles).astype(float) * count).tolist(), strict=True))
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y:
            low = sum(min(w, y[s]) for s, w in x.items() if s in y)
            if low >= threshold * (sum(x.values()) + sum(y.values()) - low):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {d: find(d) for d in sets}


def test_near_duplicates(spark):
    rng = np.random.default_rng(6)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = [t for _, t in docs if len(t.split()) > 150][:6]
    for k in range(60):
        words = base[k % 6].split()
        for i in rng.integers(0, len(words), max(1, len(words) * (k % 7) // 100)):
            words[i] = f"w{k}x{i}"
        docs.append((1000 + k, " ".join(words)))
    docs += [(2000, None), (2001, ""), (2002, "!!! ..."), (2003, "one two"), (2004, "One, two."), (2005, "a b c d e"), (2006, "a b c d e")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, label int")
    want = brute_classes(docs, near_dedup.idf_weights(frame))
    rows = near_dedup.near_duplicates(frame).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(docs) and got == want
    sizes = np.unique(list(want.values()), return_counts=True)
    assert {r.class_id: r.class_size for r in rows} == dict(zip(*map(np.ndarray.tolist, sizes), strict=True))
    assert sum(r.kept for r in rows) == len(sizes[0]) < len(docs) - 40
    kept = near_dedup.one_of_each(frame)
    assert kept.dtypes == frame.dtypes and kept.count() == len(sizes[0])


def edited(words, rng, share, tag):
    words = list(words)
    for i in rng.choice(len(words), max(1, int(len(words) * share)), replace=False):
        words[i] = f"{tag}x{i}"
    return " ".join(words)


def test_original_after_its_copies(spark):
    """Copies are near the original and not near each other; the original has the greatest row number."""
    rng = np.random.default_rng(8)
    original = [f"o{i}" for i in range(300)]
    docs = [(k, edited(original, rng, 0.018, f"c{k}")) for k in range(700)] + [(9999, " ".join(original))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    weights = near_dedup.idf_weights(frame)
    to_original = np.array([similarity(t, docs[-1][1], weights) for _, t in docs[:-1]])
    to_first = np.array([similarity(t, docs[0][1], weights) for _, t in docs[1:-1]])
    assert (to_original >= 0.8).mean() > 0.95 and (to_first >= 0.8).mean() < 0.05
    rows = near_dedup.near_duplicates(frame).collect()
    sizes = np.unique([r.class_id for r in rows], return_counts=True)[1]
    assert sizes.max() >= 0.97 * len(docs)


def test_all_pairs_of_a_bucket(spark, monkeypatch):
    """All texts share one bucket, whose classes lie near each other: the classes are those of all pairs."""
    rng = np.random.default_rng(11)
    common, docs = [f"s{i}" for i in range(80)], []
    for c in range(8):
        core = common + [f"k{c}w{i}" for i in range(60)]
        docs += [(100 * c + k, edited(core, rng, 0.014, f"e{c}k{k}")) for k in range(12)] + [(100 * c + 50, " ".join(core))]
    docs += [(5000 + k, edited(common, rng, 0.1, f"z{k}")) for k in range(9)]
    docs = [docs[i] for i in rng.permutation(len(docs))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    sign = near_dedup.signatures
    monkeypatch.setattr(near_dedup, "signatures", lambda d, w: sign(d, w).selectExpr("doc_id", "digest", "array(7L) AS bands"))
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "HELD", 4)
    monkeypatch.setattr(near_dedup, "LEADERS", 6)
    want = brute_classes(docs, near_dedup.idf_weights(frame))
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()} == want
    assert 8 < len(set(want.values())) < 30


def test_bucket_of_texts_apart(spark, monkeypatch):
    """Texts of one bucket that share a passage and stay apart are not each compared with each other; two that link are found."""
    rng = np.random.default_rng(12)
    passage, n = [f"s{i}" for i in range(60)], 300
    docs = [(k, " ".join(passage + [f"d{k}w{i}" for i in range(60)])) for k in range(n)]
    docs += [(n + k, edited(docs[7 * k][1].split(), rng, 0.02, f"e{k}")) for k in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    sign, units, met = near_dedup.signatures, near_dedup._units, []
    monkeypatch.setattr(near_dedup, "signatures", lambda d, w: sign(d, w).selectExpr("doc_id", "digest", "array(7L) AS bands"))
    monkeypatch.setattr(near_dedup, "_units", lambda *a: met.append((found := units(*a)).filter("NOT lead").count()) or found)
    monkeypatch.setattr(near_dedup, "HELD", 4)
    monkeypatch.setattr(near_dedup, "LEADERS", 6)
    want = brute_classes(docs, near_dedup.idf_weights(frame))
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()} == want
    assert n - 5 < len(set(want.values())) <= n and sum(met) < 4 * n


def test_texts_of_mostly_one_passage(spark, monkeypatch):
    """Texts that share so much of a passage that it lies in their prefixes, and stay apart, are not each compared with each other; those that link are found."""
    rng = np.random.default_rng(14)
    passage, n = [f"s{i}" for i in range(170)], 240
    own = [22 + 2 * (k % 4) for k in range(n)]
    own[::24] = [8 + 2 * k for k in range(10)]
    docs = [(k, " ".join(passage + [f"d{k}w{i}" for i in range(m)])) for k, m in enumerate(own)]
    docs += [(n + k, edited(docs[7 * k + 1][1].split(), rng, 0.01, f"e{k}")) for k in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    sign, units, met = near_dedup.signatures, near_dedup._units, []
    monkeypatch.setattr(near_dedup, "signatures", lambda d, w: sign(d, w).selectExpr("doc_id", "digest", "array(7L) AS bands"))
    monkeypatch.setattr(near_dedup, "_units", lambda *a: met.append((found := units(*a)).filter("NOT lead").count()) or found)
    monkeypatch.setattr(near_dedup, "HELD", 16)
    monkeypatch.setattr(near_dedup, "LEADERS", 6)
    want = brute_classes(docs, near_dedup.idf_weights(frame))
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()} == want
    assert 100 < len(set(want.values())) < n and sum(met) < 40 * n


def test_weights_of_all_common_shingles(spark, monkeypatch):
    """However many shingles are common, each has the weight of its own frequency."""
    monkeypatch.setattr(near_dedup, "MOST_COMMON", 8, raising=False)
    docs = [" ".join(f"w{i}" for i in range(k % 40 + 5)) for k in range(400)]
    weights = near_dedup.idf_weights(spark.createDataFrame([(t,) for t in docs], "text string"))
    df = Counter(int(x) for t in docs for x in near_dedup.shingle_sets(Texts([t]))[1])
    got = weights.of(np.array(list(df), np.uint64))
    assert np.allclose(got, [1 + 0.25 * np.log(400 / n) / np.log(400) for n in df.values()])


def test_near_edges(spark):
    rows = [(1, "same words in this short text"), (1, "same words in this short text"), (None, "same words in this short text"), (None, None), (5, "other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.near_duplicates(frame).collect()
    assert len(out) == 5 and sum(r.kept for r in out) == 3
    assert near_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 3), (500, 501)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100, 500: 500, 501: 500}


def test_counting_takes_little_beside_the_counted(monkeypatch):
    """Beside the array of shingles that are counted at once, counting holds a slice's arrays and a range's, not copies of all shingles."""
    import tracemalloc

    import pyarrow as pa

    class Docs:
        sparkSession = property(lambda self: self)
        conf = property(lambda self: {"spark.sql.shuffle.partitions": "50"})

        def select(self, *_):
            return self

        repartition = sortWithinPartitions = select

        def mapInArrow(self, function, _):
            steps.append(function)
            return self

    steps, counted = [], 1 << 21
    monkeypatch.setattr(near_dedup, "COUNTED", counted)
    near_dedup.document_frequencies(Docs(), 1)
    count, add = steps
    texts = (" ".join(map(str, range(i, i + 20_000))) for i in range(0, 2_500_000, 20_000))
    batches = (pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts)
    near_dedup.shingle_sets(Texts(["a b c d e f"]))
    tracemalloc.start()
    try:
        packed = [b for b in count(batches)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * counted * 3
    by_range = sorted((row for b in packed for row in b.to_pylist()), key=lambda row: row["range"])
    found = [n for b in add([pa.RecordBatch.from_pylist(by_range)]) for n in b.column("df").to_pylist()]
    assert len(found) == 125 * (20_000 - 4) and set(found) == {1}

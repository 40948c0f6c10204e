"""Texts longer than a slice (SLICE code points) against the library and brute force, and the registered digests."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_counts_and_encoding import brute_counts
from test_dedup import brute_spans
from test_licenses import brute
from tokenizers import Tokenizer

from prefixlake.llm import encoding, licenses, near_dedup, packing, passages, quality, token_counts
from prefixlake.llm.queries import QUERIES
from prefixlake.llm.spans import SLICE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def long():
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in rng.integers(0, 3000, 260_000)]
    passage = [f"p{i}" for i in range(70)]
    one = " ".join([*words[:1000], *passage, *words[1000:], "mit license", *passage]) + ".\n"
    two = one.replace(words[5], "changed", 1)
    assert len(one) > SLICE
    return [(1, one), (2, two), (3, " ".join([*passage, "and others"])), (4, "\n".join(["the same line"] * 90_000))]


def test_long_texts(spark, long, library):
    docs = spark.createDataFrame(long, "doc_id long, text string")
    texts = dict(long)
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in long}
    h = {r.n_tokens: r.n_docs for r in token_counts.length_histogram(docs).collect()}
    assert h == {n: sum(len(x) == n for x in ids.values()) for n in map(len, ids.values())}
    for r in encoding.encode(docs, decoded=True).collect():
        assert bytes(r.ids) == np.array(ids[r.doc_id], "<u4").tobytes() and r.decoded == texts[r.doc_id]
    pieces = packing.pack(docs).toPandas().sort_values(["doc_id", "start"])
    for doc, own in pieces.groupby("doc_id"):
        assert b"".join(own.ids) == np.array([*ids[doc], 0], "<u4").tobytes()
    for r in quality.rule_statistics(docs).collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute_counts(texts[r.doc_id])
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
    got = {d: set() for d in texts}
    for r in passages.repeated_passages(docs).collect():
        for s in r.spans:
            got[r.doc_id] |= set(range(s["start"], s["end"]))
    want = brute_spans(long, 50)
    assert {d: len(x) for d, x in got.items()} == {d: len(x) for d, x in want.items()} and got == want
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4}


def test_registered_digests(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op5_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in QUERIES["op7_packing"](spark, SF).collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())

"""Operator 6 against a brute-force version of the base scan, and on known notices."""

import math
import re
from collections import Counter

from prefixlake.llm import licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, x) for p, x in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(texts):
    """(labels, score) of each text: templates slid over the text's words, weighed by counts over all texts."""
    files = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    df = Counter(w for f in files for w in set(f))
    idf = lambda w: math.log((len(files) + 1) / (df[w] + 1))
    out = []
    for words in files:
        labels, score = {x for p, x in PHRASES.items() if f" {p} " in f" {' '.join(words)} "}, 0.0
        at = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        for label, text, phrase in licenses.TEMPLATES:
            if f" {phrase} " not in f" {' '.join(words)} ":
                continue
            own = text.split()
            rarest = sorted(set(own), key=lambda w: (-idf(w), w))[: licenses.TEMPLATE_WORDS]
            starts = {}
            for k, w in enumerate(own):
                if w in rarest:
                    for i in at.get(w, ()):
                        starts.setdefault(i - k, set()).add(w)
            best = max((sum(map(idf, s)) for s in starts.values()), default=0) / sum(map(idf, rarest))
            if best >= licenses.COVER - 1e-12:
                labels.add(label)
                score = max(score, min(best, 1.0))
        out.append((",".join(sorted(labels)), score))
    return out


def test_labels_against_brute_force(spark):
    notices = [t for _, t, _ in licenses.TEMPLATES]
    texts = [f"x{k} " * k + t.title() + f". y{k}" for k, t in enumerate(notices)]
    texts += [" ".join(notices[k : k + 5]) for k in range(len(notices))]
    texts += [" ".join(w for i, w in enumerate(t.split()) if i % m) + " " + p for m in (2, 3, 5, 9) for _, t, p in licenses.TEMPLATES]
    texts += [t.replace(" the ", " a new ") for t in notices] + [None, "", "mit license"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame).collect()}
    want = brute_labels(texts)
    assert len({x for x, _ in want}) > 25
    for i, (labels, score) in enumerate(want):
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9, texts[i]


def test_scan(spark):
    texts = [None, "", "...", "MIT License mit license, MIT\nlicense", "the 😀 漢字 Apache-License. x", "cc by", "CC BY-NC 4.0 cc by sa", "xmit license", "  mit license \u0085 gnu general public license", "a " * 4000 + "Apache License " * 3, "nothing here"]
    texts += [f"some words before it. {t.upper()}. and after" for _, t, _ in licenses.TEMPLATES]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, "mit license", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, words string")
    docs = frame.select("doc_id", "text").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))
    out = licenses.scan(docs).collect()
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == want
    by_id = {r.doc_id: r for r in out}
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        found = by_id[11 + k]
        assert label in found.labels.split(",") and 0.6 <= found.score <= 1
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by_id[10].labels == "" and by_id[10].score == 0
    scrambled = " ".join(sorted(licenses.TEMPLATES[0][1].split())) + " permission is hereby granted free of charge"
    again = licenses.scan(docs.limit(40).unionByName(spark.createDataFrame([(7777, scrambled)], "doc_id long, text string"))).filter("doc_id = 7777").first()
    assert again.labels == ""
    assert licenses.scan(docs.limit(0)).count() == 0


def test_all_notices_in_one_file(spark):
    texts = [" and then some other words. ".join(t for _, t, _ in licenses.TEMPLATES), *(t for _, t, _ in licenses.TEMPLATES)]
    docs = spark.createDataFrame([(i - 100, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    rows = {r.doc_id: r for r in licenses.scan(docs).filter("doc_id < 0").collect()}
    assert rows[-100].labels == ",".join(sorted({x for x, _, _ in licenses.TEMPLATES}))
    assert rows[-100].score == max(r.score for r in rows.values())


def test_native_plan(spark):
    frame = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = licenses.scan(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

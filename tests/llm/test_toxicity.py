"""The tagger's scan, its spans and its accuracy on held-out labels."""
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from coldlake.llm import toxicity

from .helpers import prose

SF = "/root/testdata/sf0.1"


def test_scan_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 1000, 4097):
        a, b, c, d = rng.random((4, n)) + 0.1
        for i in [0, *rng.integers(0, n, n // 20)]:
            a[i] = c[i] = 0
        value, want = 1.0, []
        for t in range(n):
            value = (a[t] * value + b[t]) / (c[t] * value + d[t])
            want.append(value)
        assert np.allclose(toxicity.scan(a, b, c, d), want)
    assert len(toxicity.scan(*np.zeros((4, 0)))) == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    crf = toxicity.Crf(np.zeros(1), 0.0, 0.4, np.array([-1.0, 0.3, 0.8]), np.zeros(3))
    em = rng.normal(size=9)
    first = np.zeros(9, dtype=bool)
    first[[0, 5]] = True
    got = crf.marginals(em, first)[3]
    for lo, hi in ((0, 5), (5, 9)):
        weight = np.zeros((hi - lo, 2))
        for path in np.ndindex(*(2,) * (hi - lo)):
            w = crf.start * path[0] + sum(em[lo + i] * y for i, y in enumerate(path))
            w += sum({(0, 1): crf.trans[0], (1, 0): crf.trans[1], (1, 1): crf.trans[2]}.get((x, y), 0) for x, y in zip(path, path[1:], strict=False))
            for i, y in enumerate(path):
                weight[i, y] += np.exp(w)
        assert np.allclose(got[lo:hi], weight[:, 1] / weight.sum(axis=1))


def test_held_out_accuracy_and_spans(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    crf = toxicity.fit(docs, labels)
    known = docs.join(labels, "doc_id").where(toxicity.is_held_out(F.col("doc_id"), 4, 2))
    got = toxicity.score(known, crf, ["doc_id", "toxic", "text"]).select("row.*", "score", "predicted", "spans").collect()
    hit = Counter((r["toxic"], r["predicted"]) for r in got)
    assert hit[1, 1] >= 0.8 * (hit[1, 1] + hit[1, 0]) and hit[0, 1] <= 0.02 * (hit[0, 0] + hit[0, 1])
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    found = Counter(r["text"][s["start"]:s["end"]].lower() for r in got for s in r["spans"])
    assert found["idiot"] > 10 and all(w.isalnum() for w in found)


def test_edge_rows(spark, make_docs, edge_rows):
    rows = edge_rows + [(60 + k, prose(k, 20) + (" foulword" if k % 2 else "")) for k in range(60)]
    labels = spark.createDataFrame([(60 + k, k % 2) for k in range(60)] + [(1, 1), (2, None), (None, 1), (999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    docs = make_docs(rows)
    crf = toxicity.fit(docs, labels)
    got = toxicity.score(docs, crf, docs.columns).select("row.*", F.col("score").alias("p"), "predicted").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows) and all(r["score"] == "x" and 0 <= r["p"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert all(by_id[60 + k] == k % 2 for k in range(60)) and by_id[2] == by_id[3] == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {round(r["score"], 9) for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert toxicity.score(make_docs([]), crf, ["doc_id"]).count() == 0


def test_training_in_parts_of_whole_documents(monkeypatch):
    drawn = [(" ".join([prose(k, 40), "foulword" if k % 2 else "", prose(900 + k, k)]).encode(), k % 2) for k in range(120)]
    lengths = np.array([0, 3, 0, 5, 2, 9, 0, 1])
    assert toxicity._parts(lengths, 8) == [(0, 8), (8, 10), (10, 19), (19, 20)] and toxicity._parts(lengths, 100) == [(0, 20)]
    whole, longest, marginals = toxicity.train(drawn, {0: 60, 1: 60}), [], toxicity.Crf.marginals

    def seen(self, emission, first):
        longest.append(len(emission))
        return marginals(self, emission, first)
    monkeypatch.setattr(toxicity.Crf, "marginals", seen)
    monkeypatch.setattr(toxicity._parts, "__defaults__", (400,))
    cut = toxicity.train(drawn, {0: 60, 1: 60})
    assert max(longest) <= 400
    assert np.allclose(cut.weights, whole.weights, atol=1e-6) and np.allclose(cut.platt, whole.platt, atol=1e-6)


def test_training_splits_texts_one_at_a_time(monkeypatch):
    split = []
    monkeypatch.setattr(toxicity, "words", lambda t: split.append(t) or t.split())
    taken = toxicity._without_near_copies([(prose(k, 30).encode(), k % 2) for k in range(40)], {0: 5, 1: 3})
    assert next(taken)[1] == 0 and len(split) == 1
    assert len(list(taken)) == 7 and len(split) == 8

import zlib

import numpy as np
from pyspark.sql import functions as F

from sitewright.llm.toxicity import Classifier, fit_nnpu, held_out, score, train


def auc(s, y):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(s) - n1))


def bags(rng, n, y):
    return [np.unique(np.append(rng.integers(0, 300, 20), rng.integers(300, 306, 2) if t else [])).astype(np.int64) for t in y[:n]]


def test_risk_learns_from_positives_and_unlabelled_only():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.15
    u = bags(rng, 3000, y)
    p = bags(rng, 300, np.ones(300, bool))
    w, b = fit_nnpu(p, u, 306, 0.15, decay=2e-3)
    s = np.array([w[x].sum() + b for x in u])
    assert auc(s, y) > 0.97 and ((s > 0) == y).mean() > 0.93


def make(spark, n=1500):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = list(rng.choice(vocabulary, rng.integers(5, 60)))
        if toxic:
            words[1:1] = list(rng.choice(["Nasty", "VILE", "rotten"], 2))
        rows.append((i, " ".join(words), "en", 0.5))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    rows += [(n, None, None, None), (n + 1, "", "", 0.0), (n + 2, "nasty vile " * 30_000, "", 1.0), (n + 2, "nasty vile " * 30_000, "", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4)
    return docs, spark.createDataFrame([*labels, (3, 0, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int"), {r[0]: r[1] for r in rows}


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels, text = make(spark)
    model = train(docs, labels)
    got = score(docs, model).withColumn("h", held_out(F.col("doc_id"))).collect()
    assert len(got) == len(text) + 1
    for r in got:
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["toxicity"] <= 1
    kept = [r for r in got if r["h"] and r["doc_id"] < 1500]
    y = np.array(["nasty" in r["text"].lower() or "vile" in r["text"].lower() or "rotten" in r["text"].lower() for r in kept])
    s = np.array([r["toxicity"] for r in kept])
    assert auc(s, y) > 0.97 and ((s >= 0.5) == y).mean() > 0.93
    assert {r["toxicity"] >= 0.5 for r in got if r["doc_id"] == 1502} == {True}


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = make(spark, 600)
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = train(docs, labels), train(docs, turned)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_without_examples_and_empty_tables(spark):
    docs, labels, _ = make(spark, 100)
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r["toxicity"] < 1e-6 for r in score(docs, train(docs, none)).collect()} == {True}
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0
    again = score(docs, Classifier(np.zeros(1 << 19), 0.0), name="score")
    assert again.columns == ["doc_id", "text", "lang", "score"] and {r["score"] for r in again.collect()} == {0.5}

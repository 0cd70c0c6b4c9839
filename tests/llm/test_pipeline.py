import re

import numpy as np
import pytest

import corpus_pipeline as P
from sitewright.llm.tokens import encoder
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_neardup import brute as brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts of invented words; toxic words, near copies, benchmark passages and odd rows planted."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 2000)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)]
    docs, labels = [], []
    for i in range(900):
        w = [word() for _ in range(int(rng.integers(20, 80)))]
        toxic = i % 6 == 0
        if toxic:
            w[2:2] = list(rng.choice(["vile", "nasty", "rotten", "foul"], 3))
        elif i % 50 == 1:
            w[5:5] = items[i % 6][1].upper().split()
        elif i % 50 in (2, 3) and i > 10:
            w = docs[i - 1 if i % 50 == 3 else i - 2][1].split() + ["tail"] * (i % 50 == 3)
        docs.append((i, " ".join(w), "en", "s", 1))
        if i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    docs += [(2000, None, None, None, None), (2001, "", "", "", 0), (2002, "long " * 4000, "en", "s", 1), (2003, "solo", "en", "s", 4), (2003, "solo", "en", "s", 4), (None, "no id", "en", "s", 5)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("x", "x").selectExpr("*", "1 AS toxicity", "'k' AS contamination").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def test_stages(spark, folder):
    path, docs, items = folder
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "packing"]
    df = spark.read.parquet(f"{path}/documents.parquet")
    insult = re.compile(r"\b(vile|nasty|rotten|foul)\b")

    first = P.toxicity(spark, df, path).cache()
    assert first.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in first.collect()]
    bad = [d for d in docs if d[1] and insult.search(d[1])]
    assert sum(bool(insult.search(t or "")) for _, t in kept) <= 0.05 * len(bad)
    assert len(kept) >= 0.98 * (len(docs) - len(bad))

    second = P.near_dedup(spark, first, path).cache()
    assert second.columns == df.columns
    want = {i for i, _, c in brute_groups([k for k in kept if k[0] is not None], 5, 80) if i == c}
    got = [r["doc_id"] for r in second.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1

    third = P.decontamination(spark, second, path).cache()
    assert third.columns == df.columns
    clean = []
    for r in second.collect():
        n, hit, _ = brute_hits(r["text"], items)
        if not (hit and 20 * len(hit) >= n):
            clean.append(r["doc_id"])
    assert sorted(map(str, clean)) == sorted(str(r["doc_id"]) for r in third.collect()) and len(clean) < second.count()

    pieces = P.packing(spark, third, path).collect()
    length = {}
    for r in pieces:
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= 1024
    assert length == {r["doc_id"]: len(encoder().ids((r["text"] or "").encode())) + 1 for r in third.collect()}


def test_run_and_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    assert P.run(spark, path).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0

import re

import numpy as np
import pytest

from sitewright.llm.decontamination import FMIndex, cut_spans, contaminated, Phrases, find_phrases, hit_words, search_shard, suffix_array

WORDS = [f"w{i}" for i in range(9)]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        q = words(t)
        for p in [q[a : a + 13] for a in range(max(1, len(q) - 12))] if q else []:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    found.add(str(i))
    return len(w), hit, sorted(found)


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        seq = np.append(rng.integers(0, 4, rng.integers(1, 80)), 0)
        order = suffix_array(seq)
        assert order.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
        index = FMIndex(seq, sample=5)
        phrases = np.array([[1, 2, 0], [3, 3, 3], [1, 1, 2], [2, 9, 0]])
        lengths = np.array([2, 3, 3, 1])
        phrases[3, 0] = 2
        lo, hi = index.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, lo, hi, strict=True):
            want = [i for i in range(len(seq) - n + 1) if seq[i : i + n].tolist() == p[:n].tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def make():
    rng = np.random.default_rng(7)
    items = [(i, " ".join(rng.choice(WORDS, n))) for i, n in enumerate([13, 20, 5, 2, 40, 1])] + [(10, ""), (11, None), (12, "..."), (13, "Ünï Ⅷ")]
    texts = [None, "", "...", "W1 w2", "ünï Ⅷ end", "zz " * 300]
    for i in range(60):
        parts = list(rng.choice(WORDS, rng.integers(1, 60)))
        t = items[rng.integers(0, 6)][1]
        parts.insert(rng.integers(0, len(parts) + 1), t.upper() if i % 2 else t)
        texts.append(("-" if i % 3 else " ").join(parts))
    return items, texts + texts[-3:]


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 40}, {"block_chars": 100}])
def test_search_equals_brute_force(spark, how):
    items, texts = make()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, item_id string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_phrases(docs, bench, **how)
    rows = {r["doc_id"]: r for r in out.withColumns({"h": hit_words(), "c": contaminated()}).collect()}
    assert len(rows) == len(texts) and out.columns == [*docs.columns, "contamination"]
    for i, t in enumerate(texts):
        n, hit, found = brute(t, items)
        c = rows[i]["contamination"]
        covered = {w for s in c["spans"] for w in range(s["start"], s["end"])}
        assert (c["n_words"], covered, c["items"], rows[i]["h"]) == (n, hit, found, len(hit)), (i, t)
        assert rows[i]["c"] == (bool(hit) and 20 * len(hit) >= n)
        left = cut_spans(t or "", c["spans"])
        assert words(left.replace("\n", " ")) == [w for k, w in enumerate(words(t)) if k not in hit] or hit


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert find_phrases(docs.limit(0), bench).count() == 0
    assert find_phrases(docs, bench.limit(0)).first()["contamination"]["spans"] == []


def test_many_items_that_share_a_short_window_on_many_places():
    items = [(str(i), "the") for i in range(800)] + [("x", "absent")]
    words, spans, found = search_shard([b"the " * 20_000], Phrases(items))[0]
    assert words == 20_000 and [s[:2] for s in spans] == [(0, 20_000)] and found == set(range(800))

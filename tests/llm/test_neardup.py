import itertools
import re

import numpy as np
import pytest

from sitewright.llm import neardup
from sitewright.llm.common import connected_components
from sitewright.llm.neardup import least_sketch_overlap, list_length, near_duplicates, verify_block


def shingle_set(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(pairs, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def brute(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    pairs = [(i, j) for (i, s), (j, t) in itertools.combinations(sets, 2) if s and t and 100 * len(s & t) >= percent * len(s | t)]
    up = components(pairs, {i for i, _ in rows})
    return sorted((i, len(s), up[i]) for i, s in sets)


def corpus(seed, families=12, copies=14):
    """Texts of 3 to 400 words; copies with a few words changed, dropped or added, around the threshold; a passage that many hold."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 5000)}"
    passage = [word() for _ in range(50)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c", "A  b\nc", "a b c d", "x " * 40, "x " * 41]
    for f in range(families):
        base = [word() for _ in range(int(rng.integers(3, 400)))]
        if f % 3 == 0:
            base[1:1] = passage
        for c in range(copies):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, len(w) // 30)))):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(0, 2))] = [word()] if rng.random() < 0.7 else []
            texts.append(" ".join(w) if c % 4 else "  ".join(w).upper())
    order = rng.permutation(len(texts))
    return [(int(i), texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("size", "percent", "k", "block"), [(4, 80, 128, 512), (5, 80, 32, 5), (1, 90, 128, 512)])
def test_equals_brute_force(spark, monkeypatch, size, percent, k, block):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    rows = corpus(size)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n long").repartition(3)
    got = near_duplicates(df, size=size, percent=percent, k=k).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (7, "other words stand here now"), (3, "other words stand here now"), (9, None), (9, None), (None, "a b c d e f"), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = near_duplicates(df).collect()
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)] * 2
    got = sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None)
    assert got == [(3, 3), (3, 3), (5, 3), (5, 3), (7, 3), (9, 9), (9, 9)]
    assert near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(df, percent=40)


def test_bounds():
    assert list_length(0, 128, 80) == 0 and list_length(10, 128, 80) == 3 and list_length(100, 128, 80) == 21
    assert 65 < least_sketch_overlap(128, 800) < 85
    rng = np.random.default_rng(0)
    draws = rng.binomial(128, 0.8, 200_000)
    assert draws.min() >= least_sketch_overlap(128, 800)


def test_block_returns_a_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 300, 8)), rng.integers(0, 1 << 60, 8).astype(np.uint64)])) for _ in range(60)]
    links = verify_block(sets, np.zeros(60, int), 128, 80)
    assert len(links) == 59 and len(set(components(links, range(60)).values())) == 1
    side = np.arange(60) % 2
    assert all(side[a] != side[b] for a, b in verify_block(sets, side, 128, 80))


def test_components(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2001 + i) for i in range(300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    ids = {x for p in pairs for x in p}
    assert got == components(pairs, ids)
    assert connected_components(df.limit(0)).count() == 0

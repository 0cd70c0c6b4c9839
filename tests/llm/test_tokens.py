import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm.packing import CAPACITY, OpenWindows, pack, plan
from sitewright.llm.tokens import allocate, attribute_tokens, encoder, vocabulary_file

TEXTS = [None, "", " ", "one", "Title here\nFirst sentence. Second one!  Third?\n\nEnd", "žluťoučký 漢字 🙂 text. Next", "word " * 5000, "a\n" * 900, "<|endoftext|> is text", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, length long").repartition(3)


def test_ids_equal_the_vocabulary_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in TEXTS:
        assert encoder().ids((text or "").encode()).tolist() == t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_allocation_against_brute_force(rule):
    rng = np.random.default_rng(3)
    for _ in range(200):
        cuts = np.sort(rng.choice(40, size=2 * rng.integers(0, 6), replace=False))
        ss, se = cuts[::2], cuts[1::2]
        bounds = np.unique(np.concatenate([[0], rng.integers(1, 40, 8), [40]]))
        ts, te = bounds[:-1], bounds[1:]
        pick, crossing = allocate(ts, te, ss, se, rule)
        for a, b, p, x in zip(ts, te, pick, crossing, strict=True):
            shared = [min(b, e) - max(a, s) for s, e in zip(ss, se, strict=True)]
            touched = [i for i, n in enumerate(shared) if n > 0]
            want = -1 if not touched else {"first": touched[0], "last": touched[-1], "most": max(touched, key=lambda i: (shared[i], -i))}[rule]
            assert p == want
            assert x == bool(touched and not any(s <= a and b <= e for s, e in zip(ss, se, strict=True)))


def test_attribution_sums_to_whole_texts(docs):
    rows = {r["doc_id"]: r for r in attribute_tokens(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert r["n_tokens"] == len(encoder().ids((t or "").encode()))
        assert r["n_outside"] + sum(f["n_tokens"] for f in r["fields"]) == r["n_tokens"]
    assert {f["field"]: f["n_sections"] for f in rows[4]["fields"]} == {"title": 1, "body": 4}
    assert rows[4]["n_crossing"] > 0


def test_given_sections_and_bad_rule(spark, docs):
    s = docs.where("doc_id = 3").withColumn("s", F.expr("array(named_struct('field', 'b', 'start', 1L, 'end', 9L), named_struct('field', 'a', 'start', 0L, 'end', 1L), null)"))
    r = attribute_tokens(s, sections="s").first()
    assert [(f["field"], f["n_tokens"]) for f in r["fields"]] == [("a", 0), ("b", 1)] and r["n_crossing"] == 1
    with pytest.raises(ValueError):
        attribute_tokens(docs, rule="half")
    assert attribute_tokens(docs.limit(0)).count() == 0


def brute_bins(lengths, capacity):
    """Best-fit decreasing, one item after another."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            best = min(fit)
            rooms.remove(best)
        else:
            best = capacity
        rooms.append(best - n)
    return sorted(rooms)


def test_plan_equals_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for capacity in (7, 30, 64):
        for _ in range(60):
            lengths = rng.integers(1, capacity + 1, rng.integers(0, 120)).tolist()
            histogram = {n: lengths.count(n) for n in set(lengths)}
            used, ranks = {}, {}
            for n, rank, first, each, offset in sorted(plan(histogram, capacity)):
                assert ranks.get(n, 0) == rank
                stop = min([r for m, r, *_ in plan(histogram, capacity) if m == n and r > rank], default=histogram[n])
                for i in range(stop - rank):
                    used.setdefault(first + i // each, []).append((offset + i % each * n, n))
                ranks[n] = stop
            for pieces in used.values():
                at = 0
                for o, n in sorted(pieces):
                    assert o == at
                    at += n
                assert at <= capacity
            assert ranks == histogram and sorted(used) == list(range(len(used)))
            assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == brute_bins(lengths, capacity)


def test_segment_tree():
    w = OpenWindows(10)
    assert w.tightest(1) is None
    w.add(4, 0, 1), w.add(9, 1, 2)
    assert (w.tightest(3), w.tightest(4), w.tightest(5), w.tightest(10)) == (4, 4, 9, None)
    w.take(9)
    assert w.tightest(5) is None


def test_packing_round_trip(docs):
    rows = pack(docs).collect()
    streams, windows = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        streams.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        ids = np.frombuffer(b"".join(b for _, b in sorted(streams[i])), "<u4")
        assert ids.tolist() == [*encoder().ids((t or "").encode()).tolist(), 0]
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= CAPACITY
    crc = pack(docs, content="crc32").select("doc_id", "start", "ids_crc32").collect()
    assert {(r[0], r[1], r[2]) for r in crc} == {(r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"]))) for r in rows}
    assert pack(docs.limit(0)).count() == 0
    assert pack(docs.union(docs)).count() == 2 * len(rows)


def test_queries_read_added_tokens_as_the_library_does_by_default(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from sitewright.llm.queries import QUERIES

    t = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "漢 <|endoftext|><|endoftext|>", "<|endoftext|>", "<|endoftext| >", "plain. <|endoftext|>\nMore of it."]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[2] == [50256]
    assert [encoder(special=True).ids(x.encode()).tolist() for x in texts] == want
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op3_token_counts"](spark, str(tmp_path)).collect()}
    assert counts == {i: len(x) for i, x in enumerate(want)}
    crcs = {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(want)}
    for got in (QUERIES["op10_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        assert {r["doc_id"]: r["ids_crc32"] for r in got.collect()} == crcs

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm.sharding import assign, hilbert_index, ranges


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_curve_is_a_walk_through_all_cells(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
    place = hilbert_index(list(grid), bits)
    assert sorted(place.tolist()) == list(range((1 << bits) ** dims))
    walk = grid[:, np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def make(spark, n):
    rows = [(i, None if i % 11 == 0 else ("é" * (i * 7 % 50) if i % 3 else "copy"), f"l{i % 4}" if i % 9 else None, f"src{i % 3 and i % 17}", (i * 7919) % 1000 if i % 5 else None, "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").repartition(3)


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("n", [0, 1, 5, 8, 403])
def test_laws(spark, law, n):
    rows, df = make(spark, n)
    got = assign(df, ("lang", "source", "n_chars"), 8, law=law).collect()
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    shards = {}
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]))
        shards.setdefault(r["shard"], []).append(r)
    order = []
    for s in sorted(shards):
        assert 0 <= s < 8 and sorted(r["slot"] for r in shards[s]) == list(range(len(shards[s])))
        order += [(r["curve"], r["doc_id"]) for r in sorted(shards[s], key=lambda r: r["slot"])]
    assert order == sorted(order)
    if law == "rows":
        counts = [len(shards.get(s, [])) for s in range(8)]
        assert max(counts) - min(counts) <= 1
    elif n > 8:
        sizes = [sum(r["size"] for r in shards.get(s, [])) for s in range(8)]
        assert max(abs(x - sum(sizes) / 8) for x in sizes) <= max(r["size"] for r in got)


def test_repeated_rows_and_pruning(spark):
    rows, df = make(spark, 300)
    same = spark.createDataFrame([rows[1]] * 400, df.schema)
    got = assign(df.union(same), ("lang", "source", "n_chars"), 7).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert {r["n"] for r in got} == {100} and {r["m"] for r in got} == {99}
    stats = ranges(df, assign(df, ("lang", "source", "n_chars"), 8), ("lang", "source", "n_chars")).collect()
    assert sum(r["rows"] for r in stats) == 300
    assert sum(r["min_source"] != "src0" or r["max_source"] != "src2" for r in stats) >= 2
    with pytest.raises(ValueError):
        assign(df, ("lang",), 8, law="key")


def test_texts_with_a_common_start_are_told_apart(spark):
    rows = [(i, "x", None if i % 50 == 0 else f"https://common.example.org/source_{i * 7919 % 320:03d}") for i in range(640)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    placed = assign(df, ("source",), 8)
    assert placed.select("curve").distinct().count() > 8
    stats = sorted(ranges(df, placed, ("source",)).collect(), key=lambda r: r["shard"])
    assert [r["rows"] for r in stats] == [80] * 8
    # one dimension is sorted by whole values, cut into cells: shards meet in a cell at most
    width = [int(r["max_source"][-3:]) - int(r["min_source"][-3:]) for r in stats]
    assert max(width) <= 60

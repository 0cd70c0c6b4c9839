"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts train a linear classifier in numpy. The risk is corrected by the class prior p:
R = p E+[loss(f, +1)] + max(0, E_u[loss(f, -1)] - p E+[loss(f, -1)]); where the second part would fall below zero, its gradient
is followed upwards instead. Features are the distinct words of the whole text and their first bytes,
hashed to buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import ALNUM_WORDS, others, quoted, runs, text_buffers, word_hashes, written

BITS = 19
PREFIXES = (4, 5, 6)  # bytes: words of one stem share these features
FEATURES, LEAST_GAP = 4096, 2.5  # buckets that the classifier uses: those that set the samples apart most, in standard errors
#: bounds of the training sample: rows confirmed toxic, rows taken as unlabelled
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 14_000
BATCH_BYTES = 2 << 20
STEPS, RATE, DECAY = 250, 0.05, 1e-4


def word_buckets(raw: np.ndarray, off: np.ndarray, use: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: index of the first, and (text within the run, bucket) of their distinct words, sorted; ``use`` masks buckets."""
    for a, b in runs(np.diff(off), BATCH_BYTES):
        part = np.frombuffer(b"\n".join(raw[off[i] : off[i + 1]].tobytes() for i in range(a, b)), np.uint8)
        start, _, *hashes = word_hashes(part, ALNUM_WORDS, PREFIXES)
        first = np.searchsorted(start, off[a : b + 1] - off[a] + np.arange(b - a + 1))
        line = np.repeat(np.arange(b - a), np.diff(first))
        keys = []
        for h in hashes:
            bucket = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
            keys.append((line << BITS | bucket) if use is None else line[use[bucket]] << BITS | bucket[use[bucket]])
        both = np.unique(np.concatenate(keys))
        yield a, both >> BITS, both & ((1 << BITS) - 1)


class Classifier:
    """Linear scores over chosen buckets; ``weights`` is 0 elsewhere."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, self.bias)
        used = self.weights != 0
        for first, line, bucket in word_buckets(raw, off, used):
            if len(line):
                total = np.bincount(line, weights=self.weights[bucket])
                out[first : first + len(total)] += total
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias from the feature indices of both samples: Adam on the non-negative risk with logistic loss."""
    rows = [*positive, *unlabelled]
    line = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    is_p = np.arange(len(rows)) < len(positive)
    n_p, n_u = len(positive), len(unlabelled)
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        f = np.bincount(line, weights=w[column], minlength=len(rows)) + w[-1]
        sig = 1 / (1 + np.exp(-np.clip(f, -500, 500)))  # derivative of loss(f, -1); that of loss(f, +1) is sig - 1
        negative = np.logaddexp(0, f)
        rest = negative[~is_p].mean() - prior * negative[is_p].mean()
        part = np.where(is_p, -prior * sig / n_p, sig / n_u)
        g = np.where(is_p, prior * (sig - 1) / n_p, 0.0) + part if rest >= 0 else -part
        grad = np.append(np.bincount(column, weights=g[line], minlength=width) + decay * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(key):
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    """Fit on the texts of labelled rows that are not held out.

    Rows labelled 1 are the confirmed examples; all labelled rows, their labels hidden, are the unlabelled text; the share of
    ones among them, counted over all, is the class prior. At most about ``max_positive`` and ``max_unlabelled`` rows are used,
    chosen by a hash of the key. Repeated labels of a key count once, as 1 if any is; null labels do not count. Without both
    kinds of rows the classifier gives every text the score 0.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not ones:
        return Classifier(np.zeros(1 << BITS), -500.0)
    prior = min(max(ones / n, 1e-6), 1 - 1e-6)
    parts = 1 << 20
    place = F.pmod(F.xxhash64("k"), F.lit(parts))
    sample = known.select(
        "k", ((F.col("y") == 1) & (place < parts * min(1.0, max_positive / ones))).alias("p"), (place >= parts - parts * min(1.0, max_unlabelled / n)).alias("u")
    ).where("p or u")
    bound = F.broadcast(sample)  # by its filters max_positive + max_unlabelled rows, give or take chance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b""] * b.num_rows
            for first, line, bucket in word_buckets(*text_buffers(b.column(3))):
                cut = np.searchsorted(line, np.arange(line[-1] + 2)) if len(line) else [0]
                for i in range(len(cut) - 1):
                    out[first + i] = bucket[cut[i] : cut[i + 1]].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["k", "p", "u", "buckets"])

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("k"), F.col(text).alias("__text")).join(bound, "k").select("k", "p", "u", "__text")
    bags = chosen.mapInArrow(run, f"k {kind}, p boolean, u boolean, buckets binary")
    bags = written(bags.repartition(1 + (max_positive + max_unlabelled) // 5_000), "bags")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, u = (np.array(b.column(i).to_pylist(), dtype=np.int64) for i in (0, 1))
            bag = [np.frombuffer(x, "<i4") for x in b.column(2).to_pylist()]
            every, line = np.concatenate([*bag, np.zeros(0, np.int32)]), np.repeat(np.arange(len(bag)), [len(x) for x in bag])
            counts = [np.bincount(every, weights=y[line], minlength=1 << BITS) for y in (p, u)]
            there = np.flatnonzero(counts[0] + counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(c[there].astype(np.int64)) for c in counts)], ["bucket", "in_p", "in_u"])

    counts = bags.select("p", "u", "buckets").mapInArrow(spread, "bucket bigint, in_p bigint, in_u bigint").groupBy("bucket").agg(
        F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")
    ).toPandas()  # one row per bucket at most
    n_p, n_u = bags.agg(F.count(F.when(F.col("p"), 1)), F.count(F.when(F.col("u"), 1))).first()
    if not n_p or not n_u:
        return Classifier(np.zeros(1 << BITS), -500.0)
    share_p, share_u = counts["in_p"] / n_p, counts["in_u"] / n_u
    both = (counts["in_p"] + counts["in_u"]) / (n_p + n_u)
    gap = (share_p - share_u).abs() / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n_p + 1 / n_u))
    counts = counts.assign(gap=gap)[((counts["in_p"] + counts["in_u"]) >= 3) & (gap >= LEAST_GAP)].sort_values(["gap", "bucket"], ascending=[False, True]).head(FEATURES)
    columns = np.sort(counts["bucket"].to_numpy(np.int64))
    place_of = np.full(1 << BITS, -1)
    place_of[columns] = np.arange(len(columns))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(c := place_of[np.frombuffer(x, "<i4")])[c >= 0].astype("<i2").tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(kept, pa.binary())], ["k", "p", "u", "buckets"])

    rows = sorted(bags.mapInArrow(narrow, f"k {kind}, p boolean, u boolean, buckets binary").collect(), key=lambda r: (r["k"], bytes(r["buckets"])))
    bag = [np.frombuffer(r["buckets"], "<i2") for r in rows]
    w, bias = fit_nnpu([x for x, r in zip(bag, rows, strict=True) if r["p"]], [x for x, r in zip(bag, rows, strict=True) if r["u"]], len(columns), prior)
    weights = np.zeros(1 << BITS)
    weights[columns] = w
    return Classifier(weights, bias)


def score(docs: DataFrame, classifier: Classifier, text: str = "text", keep: tuple[str, ...] | None = None, name: str = "toxicity") -> DataFrame:
    """Adds column ``name``: 0 to 1, higher where the text is likelier toxic.

    Null and empty texts get the score of a text without words. Repeated rows get equal scores; every text is read whole;
    nothing is shuffled. ``keep`` names the columns to return (all); an older column ``name`` is replaced.
    """
    keep = others(docs, keep, name)
    model = docs.sparkSession.sparkContext.broadcast(classifier)  # 4 MB

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.scores(*text_buffers(texts)), pa.float64())

    return docs.select(*map(quoted, keep), scores(F.col(text)).alias(name))

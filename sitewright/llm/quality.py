"""Quality rules: text statistics, base rules, and robust multivariate outliers per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import mix, quoted, text_buffers, word_hashes, written

# ---- statistics of one text ----------------------------------------------------------------------------------------

#: byte 0 is told apart from separators by the value of one of them
_WORDS = np.arange(256, dtype=np.uint8)
_WORDS[[0x20, *range(0x09, 0x0E)]] = 0
_WORDS[0] = 0x20
_LINES = np.arange(256, dtype=np.uint8)
_LINES[0x0A] = 0
_LINES[0] = 0x0A
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """How many words stand in a window of so many words that occurs twice or more; ``words``: their hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = mix(h) + words[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    if not len(at):
        return 0
    return int(window + np.minimum(np.diff(at), window).sum())


def text_statistics(raw: np.ndarray) -> tuple[int, ...]:
    """``STATS`` of a text's UTF-8 bytes. Lines are those that hold a word."""
    start, end, words = word_hashes(raw, _WORDS)
    if not len(start):
        return 0, 0, int(_SYMBOL[raw].sum()), 0, 0, 0
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first, last, lines = word_hashes(raw, _LINES)
    lines = lines[np.searchsorted(start, last) > np.searchsorted(start, first)]
    return len(start), int((begun[end] - begun[start]).sum()), int(_SYMBOL[raw].sum()), len(lines), len(lines) - len(np.unique(lines)), repeated_words(words)


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The ``keep`` columns and ``STATS`` (long) of every row's whole text; a null text is empty."""
    source = docs.select(*[F.col(quoted(k)) for k in keep], F.col(quoted(text)).cast("string").alias("__text"))
    schema = ", ".join([f"{quoted(k)} {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"{s} bigint" for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffers(b.column(len(keep)))
            rows = np.array([text_statistics(raw[off[i] : off[i + 1]]) for i in range(b.num_rows)], dtype=np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(rows[:, i]) for i in range(len(STATS))]], [*keep, *STATS])

    return source.mapInArrow(run, schema)


# ---- minimum covariance determinant --------------------------------------------------------------------------------

DIMENSIONS = ("word_length", "symbols", "dup_lines", "repeats")
#: a statistic's spread counts as this much at least: logarithm of the mean word length, then square roots of shares
SPREAD = (0.1, 0.08, 0.15, 0.15)
SHARE = 0.75  # of a group's rows that the covariance is taken over
REJECT = 43.0  # squared distance; a normal vector of four dimensions lies beyond it once in 100 million
REWEIGHT = 11.143  # 0.975 quantile of the same distribution
LEAST_GROUP = 200  # rows; smaller groups of a language are taken together
STEPS = 12
UNIT = 1024  # statistics are whole multiples of 1/1024, so that sums are exact in whatever order
PER_OCTAVE = 32  # bins of the squared distance
P = len(DIMENSIONS)
_UPPER = [(i, j) for i in range(P) for j in range(i, P)]


def share_within(x: float, p: int) -> float:
    """Probability that a chi-squared variable of ``p`` (even) degrees of freedom is at most ``x``."""
    term = total = 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return 1 - np.exp(-x / 2) * total


def quantile(share: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        lo, hi = ((lo + hi) / 2, hi) if share_within((lo + hi) / 2, p) < share else (lo, (lo + hi) / 2)
    return hi


def consistency(share: float) -> float:
    """Factor that makes the covariance of the central ``share`` of a normal distribution that of the whole."""
    return share / max(share_within(quantile(share, P), P + 2), 1e-9) if share < 1 else 1.0


def transformed() -> list:
    """Statistics as whole multiples of 1/UNIT."""
    c = {s: F.col(s).cast("double") for s in STATS}
    over = lambda a, b: F.least(c[a] / F.greatest(c[b], F.lit(1.0)), F.lit(1.0))
    values = [
        F.log(F.greatest(c["word_chars"], F.lit(1.0)) / F.greatest(c["n_words"], F.lit(1.0))),
        F.sqrt(over("n_symbols", "word_chars")), F.sqrt(over("n_dup_lines", "n_lines")), F.sqrt(over("n_repeat_words", "n_words")),
    ]
    return [F.round(v * UNIT).cast("bigint").alias(f"q{i}") for i, v in enumerate(values)]


def _distance(center: str = "center", inverse: str = "inverse"):
    """Squared Mahalanobis distance of q0 .. q3 from a row's own center."""
    d = [F.col(f"q{i}") / UNIT - F.col(center)[i] for i in range(P)]
    total = None
    for i, j in _UPPER:
        term = d[i] * d[j] * F.col(inverse)[P * i + j] * (1 if i == j else 2)
        total = term if total is None else total + term
    return F.greatest(total, F.lit(0.0))


def _bin(d2: float) -> int:
    return int(np.floor(PER_OCTAVE * np.log2(1 + d2)))


ESTIMATE = "g string, start int, center array<double>, inverse array<double>, logdet double"


def _estimate(g: str, start: int, n: int, sums: np.ndarray, crossed: np.ndarray, factor: float) -> dict:
    """Center and inverse covariance from a subset's exact sums; each statistic gets its least spread on top."""
    mean = sums / n
    cov = np.zeros((P, P))
    for (i, j), s in zip(_UPPER, crossed, strict=True):
        cov[i, j] = cov[j, i] = float(s / n - mean[i] * mean[j])
    cov = factor * cov / UNIT**2 + np.diag(np.square(SPREAD))
    return {"g": g, "start": start, "center": (mean / UNIT).astype(float), "inverse": np.linalg.inv(cov).ravel(), "logdet": float(np.linalg.slogdet(cov)[1])}


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """First estimates of a group from its statistics' histograms: medians, and spreads by median deviations, then by interquartile ranges."""
    center, mad, iqr = [], [], []
    for i in range(P):
        h = rows[rows.i == i].sort_values("q")
        q, n = h.q.to_numpy(np.int64), h.n.to_numpy(np.int64)
        at = lambda v, w, share: v[np.searchsorted(np.cumsum(w), share * w.sum())]
        m = at(q, n, 0.5)
        off = np.abs(q - m)
        order = np.argsort(off, kind="stable")
        center.append(m / UNIT)
        mad.append(1.4826 * at(off[order], n[order], 0.5) / UNIT)
        iqr.append((at(q, n, 0.75) - at(q, n, 0.25)) / 1.349 / UNIT)
    out = []
    for k, spread in enumerate((mad, iqr, [s * 2 for s in SPREAD])):
        var = np.square(spread) + np.square(SPREAD)
        out.append({"g": rows.g.iloc[0], "start": k, "center": np.array(center), "inverse": np.diag(1 / var).ravel(), "logdet": float(np.log(var).sum())})
    return pd.DataFrame(out)


def _stepped(share: float | None):
    """New estimate of a (group, start) from the exact sums per bin of distance: over the fewest central bins that hold ``share`` of
    the rows, or over all rows within REWEIGHT."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        n = rows.n.to_numpy(np.int64)
        if share is None:
            last = max(int(np.searchsorted(rows.bin.to_numpy(), _bin(REWEIGHT), side="right")) - 1, 0)
            factor = consistency(0.975)
        else:
            last = int(np.searchsorted(np.cumsum(n), np.ceil(share * n.sum())))
            factor = consistency(n[: last + 1].sum() / n.sum())
        total = lambda name: sum(map(int, rows[name].iloc[: last + 1]))  # noqa: E731 - whole numbers of any size
        return pd.DataFrame([_estimate(
            rows.g.iloc[0], int(rows.start.iloc[0]), int(n[: last + 1].sum()), np.array([total(f"s{i}") for i in range(P)], dtype=np.float64),
            np.array([total(f"s{i}{j}") for i, j in _UPPER], dtype=np.float64), factor,
        )])

    return step


def _next(rows: DataFrame, estimates: DataFrame, share: float | None) -> DataFrame:
    d2 = rows.join(estimates.drop("logdet"), "g").withColumn("bin", F.floor(F.log2(1 + _distance()) * PER_OCTAVE).cast("int"))
    sums = [F.sum(f"q{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"s{i}{j}") for i, j in _UPPER]
    return d2.groupBy("g", "start", "bin").agg(F.count("*").alias("n"), *sums).groupBy("g", "start").applyInPandas(_stepped(share), ESTIMATE)


def center_and_scatter(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Minimum covariance determinant of every group: (g, center, inverse).

    ``rows``: (g, q0 .. q3). Starts from medians with three kinds of spread; a concentration step takes the ``share`` of rows nearest to the
    estimate and estimates anew, for all groups and starts at once. A step is one aggregation to exact whole sums per bin of distance
    (at most some thousand per group and start, combined before the shuffle), from which the group's own task picks the nearest
    bins; all rows of the last bin go in. So nothing depends on the order of rows or on how they are partitioned. Of the starts, the least
    determinant stays, and a last step takes all rows within the 0.975 quantile of its distances.
    """
    values = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"q{i}").alias("q")) for i in range(P)])).alias("x"))
    now = written(values.groupBy("g", "x.i", "x.q").agg(F.count("*").alias("n")).groupBy("g").applyInPandas(_starts, ESTIMATE), "starts")
    before = None
    for _ in range(steps):
        now = written(_next(rows, now, share), "step")
        state = now.agg(F.count("*"), F.sum(F.round(F.col("logdet") * 1e6).cast("bigint"))).first()
        if state == before:
            break
        before = state
    best = now.groupBy("g").agg(F.min_by(F.struct("start", "center", "inverse", "logdet"), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
    return written(_next(rows, best, None), "scatter").select("g", "center", "inverse")


def base_failed():
    """Fewer than 20 words, or over 30 of 100 words inside windows that repeat."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(
    docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), by: tuple[str, str] = ("lang", "source"), share: float = SHARE, reject: float = REJECT,
    least_group: int = LEAST_GROUP,
) -> DataFrame:
    """Statistics and verdict of every row's whole text.

    Base rules fail a text by :func:`base_failed`. Of the others, per language and source (``by``), center and covariance of the vector
    (logarithm of the mean word length; square roots of the shares of symbols in word characters, of lines equal to an earlier one, of words in
    repeated windows) are estimated by :func:`center_and_scatter`, and a text whose squared distance exceeds ``reject`` is not kept. Groups of fewer than
    ``least_group`` such rows go together per language; where these are too few as well, nothing is rejected.

    One row per input row with the ``keys`` columns, ``STATS``, base_failed, distance (null where there is no estimate) and kept. A null text
    has no words and fails; null languages and sources are values of their own; repeated rows stay and count apiece; an empty table gives
    an empty one. Other columns are not read.
    """
    named = {k: f"k{i}" for i, k in enumerate(keys)}
    picked = docs.select(*[F.col(quoted(k)).alias(n) for k, n in named.items()], *[F.col(quoted(b)).alias(f"b{i}") for i, b in enumerate(by)], F.col(quoted(text)).alias("t"))
    told = with_statistics(picked, "t", (*named.values(), "b0", "b1")).withColumn("base_failed", base_failed())
    group = [F.to_json(F.struct(*[f"b{i}" for i in range(n)])) for n in (2, 1)]
    told = written(told.select(*named.values(), *STATS, "base_failed", group[0].alias("own"), group[1].alias("wide"), *transformed()), "statistics")
    counts = told.where("not base_failed").groupBy("own", "wide").agg(F.count("*").alias("n"))
    small = counts.where(F.col("n") < least_group).groupBy("wide").agg(F.sum("n").alias("wide_n"))
    g = F.when(F.col("n") >= least_group, F.col("own")).when(F.col("wide_n") >= least_group, F.concat(F.lit("*"), F.col("wide")))
    groups = written(counts.join(small, "wide", "left").select("own", g.alias("g")).where("g is not null"), "groups")
    placed = told.join(groups, "own", "left")
    if groups.isEmpty():
        out = placed.withColumn("distance", F.lit(None).cast("double"))
    else:
        placed = written(placed.drop("own", "wide"), "placed")
        estimates = center_and_scatter(placed.where("not base_failed and g is not null").select("g", *[f"q{i}" for i in range(P)]), share)
        out = placed.join(estimates, "g", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > reject, F.lit(False))
    return out.select(*[F.col(n).alias(k) for k, n in named.items()], *STATS, "base_failed", "distance", kept.alias("kept"))

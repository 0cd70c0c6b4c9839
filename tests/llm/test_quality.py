import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import quality
from sitewright.llm.quality import P, SPREAD, UNIT, center_and_scatter, consistency, judged, quantile, share_within, with_statistics


def brute(text):
    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a\x00b a\x01b \x00", "same line\nsame line\n\nsame line \n  \n  ", "Case case\nCase\ncase", "x " * 40, "žluťoučký 漢字 🙂 <b>&amp;</b> # * $ % |",
    "one two three four five six seven eight nine one two three four five six seven eight ten", "l\r\nl\r\nl", "word" * 5000, "no end of line ", "a b c d e f g h " * 2,
]


def test_statistics_against_brute_force(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["a ", "b ", "a\n", "c#", "é\t", "\n", "b\n"]) for _ in range(rng.randint(0, 200))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in with_statistics(df, keep=("doc_id",)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_chi_squared():
    x = np.random.default_rng(1).chisquare(4, 200_000)
    assert abs(share_within(9.0, 4) - (x <= 9).mean()) < 0.005 and abs(quantile(0.975, 4) - 11.143) < 0.001
    z = np.random.default_rng(2).normal(size=(200_000, P))
    d2 = (z**2).sum(1)
    inner = z[d2 <= np.quantile(d2, 0.75)]
    assert abs(consistency(0.75) * inner.var() - 1) < 0.02


def plain(q, share=0.75, steps=200):
    """The same estimate by sorting, from many random starts besides; exact nearest rows instead of whole bins."""
    x, rng, best = q / UNIT, np.random.default_rng(0), None
    h = int(np.ceil(share * len(x)))
    for _ in range(30):
        part = x[rng.choice(len(x), P + 1, replace=False)]
        for _ in range(steps):
            cov = np.cov(part.T, bias=True) * consistency(share) + np.diag(np.square(SPREAD))
            d = np.einsum("ij,jk,ik->i", x - part.mean(0), np.linalg.inv(cov), x - part.mean(0))
            new = x[np.argsort(d, kind="stable")[:h]]
            if np.array_equal(new, part):
                break
            part = new
        det = np.linalg.det(np.cov(part.T, bias=True) * consistency(share) + np.diag(np.square(SPREAD)))
        if best is None or det < best[0]:
            best = det, part
    part = best[1]
    cov = np.cov(part.T, bias=True) * consistency(share) + np.diag(np.square(SPREAD))
    d = np.einsum("ij,jk,ik->i", x - part.mean(0), np.linalg.inv(cov), x - part.mean(0))
    part = x[d <= quality.REWEIGHT]
    return part.mean(0), np.cov(part.T, bias=True) * consistency(0.975) + np.diag(np.square(SPREAD))


def test_scatter_against_plain_estimate(spark):
    rng = np.random.default_rng(7)
    groups, want = [], {}
    for g, mean in (("a", [1.6, 0.1, 0.2, 0.1]), ("b", [3.0, 0.5, 0.0, 0.4])):
        mix = rng.normal(size=(P, P)) * 0.5
        x = np.array(mean) + rng.normal(size=(1500, P)) @ mix
        x[:300] = np.array(mean) + 20 + rng.normal(size=(300, P))  # a fifth lies far away, in one place
        q = np.round(x * UNIT).astype(np.int64)
        want[g] = plain(q)
        groups += [(g, *map(int, r)) for r in q]
    df = spark.createDataFrame(groups, "g string, q0 long, q1 long, q2 long, q3 long")
    got = {r["g"]: r for r in center_and_scatter(df.repartition(5)).collect()}
    for g, (center, cov) in want.items():
        c, s = np.array(got[g]["center"]), np.linalg.inv(np.array(got[g]["inverse"]).reshape(P, P))
        sd = np.sqrt(np.diag(cov))
        assert np.all(np.abs(c - center) < 0.06 * sd) and np.all(np.abs(s - cov) < 0.1 * np.outer(sd, sd))
    again = {r["g"]: r for r in center_and_scatter(df.repartition(2)).collect()}
    assert again == got  # exact sums: the order of rows is nothing


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(700):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 200)))
        if i % 10 == 0:
            text = " ".join(w + rng.choice(["***", "###", "$$$"]) for w in text.split())
        rows.append((i, text, "en", "big" if i < 400 else f"s{i % 9}" if i < 690 else None))
    rows += [(1000 + i, t, None, "x") for i, t in enumerate(TEXTS)]
    rows += [(1100, "w*** " * 30, "xx", "tiny"), (0, rows[0][1], "en", "big")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("g", F.lit(1)).withColumn("q0", F.lit("x")).repartition(4)


def test_verdicts(docs):
    rows, df = docs
    got = judged(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, text, _, _ in rows:
        n, chars, symbols, _, dup, rep = brute(text)
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        if i < 700:
            assert r["kept"] == (i % 10 > 0) and r["distance"] is not None
        elif not r["base_failed"]:
            assert r["kept"] and r["distance"] is None  # too few for an estimate
    assert sum(r["doc_id"] == 0 for r in got) == 2


def test_verdicts_do_not_depend_on_partitions(docs):
    _, df = docs
    assert Counter(map(str, judged(df.repartition(1)).collect())) == Counter(map(str, judged(df.repartition(7)).collect()))


def test_empty_table(docs):
    assert judged(docs[1].where("false")).count() == 0

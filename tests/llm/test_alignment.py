import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitewright.llm.alignment import align, common_ends, link_statistics
from sitewright.llm.tokens import vocabulary_file

TEXTS = [
    None, "", " ", "a", "one two  three\n\tfour", "žluťoučký 漢字 🙂 text", "word " * 3000, "<|endoftext|> and <s> </s> <unk>", "marked ▁ letter", "same same", "same same", "\x00\x01 control\r\n", "ﬁ ligature é",
    "zzzzqqqqxxxx" * 200, "naïve café 東京 tokenization's unbelievable", " lead", "trail ", "0123456789" * 40,
]


def test_common_ends_against_sets():
    rng = np.random.default_rng(4)
    for trial in range(400):
        n = int(rng.integers(1, 400))
        density = rng.choice([0.02, 0.3, 0.9])
        a, b = (np.unique(np.append(np.flatnonzero(rng.random(n) < d), n)) for d in (density, rng.choice([0.02, 0.5, 1.0])))
        if trial % 3 == 0:  # long stretches without a common end
            stretch = (n // 4 < b) & (b < 3 * n // 4) & np.isin(b, a)
            b = b[~stretch]
        assert common_ends(a, b).tolist() == np.flatnonzero(np.isin(a, b)).tolist()
    assert common_ends(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_common_ends_of_long_stretches_take_no_quadratic_time():
    n = 400_000
    even, odd = np.arange(2, n + 1, 2), np.arange(1, n, 2)
    assert common_ends(even, np.append(odd, n)).tolist() == [len(even) - 1]
    assert len(common_ends(even, even)) == len(even)
    half = np.concatenate([odd[: n // 4], even[n // 4 :]])
    assert common_ends(even, np.unique(np.append(half, n))).tolist() == np.flatnonzero(np.isin(even, np.append(half, n))).tolist()


def letters():
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            out[chr(0x100 + n)] = b
            n += 1
    return out


def tokens(text, full, sp, letter):
    if not text:
        return None
    a = [(i, bytes(letter[c] for c in full.id_to_token(i))) for i in full.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    full, sp, letter = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json")), SentencePieceProcessor(model_file=vocabulary_file("piece_bpe_32k.model")), letters()
    full.encode_special_tokens = True
    links, groups, counts = [], [], Counter()
    for t in texts:
        two = tokens(t, full, sp, letter)
        if two is None:
            links.append(None)
            groups.append(None)
            continue
        a, b = map(spans, two)
        links.append([(x, y) for x, s, e in a for y, u, v in b if s < v and u < e])
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups.append([([x for x, _, e in a if lo < e <= hi], [y for y, _, e in b if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)])
        counts.update(set(links[-1]))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for t, l, g in zip(texts, links, groups, strict=True):
        if l is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(l), sum(counts[p] == top[p[0]] for p in l), sum(counts[p] for p in l), hashlib.sha256(line.encode()).hexdigest()))
    return out, groups


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, block string").repartition(3)


@pytest.mark.parametrize("block", [1, 1 << 22])
def test_statistics_against_all_pairs_of_tokens(docs, block):
    want, _ = brute(TEXTS)
    got = {r[0]: tuple(r[1:]) for r in link_statistics(docs, block_bytes=block, portion_bytes=min(block, 1 << 17)).collect()}
    assert got == dict(enumerate(want))
    assert want[8] == want[0] == (0, 0, 0, 0, 0, 0, "") and want[7][0] > 0


def test_groups_against_sets_of_ends(docs):
    _, want = brute(TEXTS)
    for r in align(docs).collect():
        got = r["groups"]
        assert [(g["a"], g["b"]) for g in got] == (want[r["doc_id"]] or [])
        if got:
            assert got[-1]["end"] == len((" " + TEXTS[r["doc_id"]]).encode())


def test_random_texts_in_many_blocks(spark):
    rng = random.Random(8)
    words = ["the", "un", "able", "é", "ß", "token", "  ", "\n", "x9", "東", "'s", "re"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    want, _ = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r[0]: tuple(r[1:]) for r in link_statistics(df, block_bytes=900, portion_bytes=300).collect()} == dict(enumerate(want))


def test_empty_table_and_null_keys(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two")], "doc_id long, text string")
    rows = link_statistics(df).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["count_sum"] == 2 * rows[0]["n_links"] == 2 * rows[0]["n_best"]
    assert link_statistics(df.where("false")).count() == 0 and align(df.where("false")).count() == 0

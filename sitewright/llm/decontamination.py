"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of documents of bounded size. Its words become symbols, its suffixes are sorted, the Burrows-Wheeler transform
is held in a wavelet matrix. All phrases are searched backward at once by rank queries; occurrences are located by walking
to the nearest sampled suffix position; overlapping occurrences merge into removal spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import ALNUM_WORDS, others, quoted, runs, text_buffers, word_hashes

WINDOW = 13
SHARD_BYTES = 4 << 20  # text of one index; a longer document is indexed in pieces that overlap by a phrase
BLOCK_CHARS = 16 << 20  # phrases' text held at once; more phrases are searched block after block
SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``seq`` (symbols >= 0); a suffix that is a prefix of another comes first."""
    n = len(seq)
    bits = int(seq.max() + 1).bit_length() if n else 1
    per = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(per):
        key <<= bits
        key[: max(n - j, 0)] |= seq[j:] + 1
    order = np.argsort(key)
    key = key[order]
    fresh = np.empty(n, bool)
    fresh[:1] = True
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = per
    while True:
        alone = fresh & np.append(fresh[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return order
        at = order[rows]
        after = at + step
        inside = after < n
        key = rank[at] * (n + 1)
        key[inside] += rank[after[inside]] + 1
        o = np.argsort(key)
        at, key = at[o], key[o]
        order[rows] = at
        new = np.empty(len(rows), bool)
        new[:1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        fresh[rows] = new
        rank[at] = np.maximum.accumulate(np.where(new, rows, 0))
        step *= 2


class Bits:
    """Bit vector with constant-time rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for b in range(bits - 1, -1, -1):
            one = ((seq >> b) & 1).astype(bool)
            zeros = len(seq) - int(np.count_nonzero(one))
            self.levels.append((b, Bits(one), zeros))
            seq = np.concatenate([seq[~one], seq[one]])

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of the first ``i`` entries' ``symbol`` run end; the difference of two places is a rank."""
        for b, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i

    def follow(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at ``i`` and their places at the bottom."""
        symbol = np.zeros(len(i), np.int64)
        for b, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.ones(i)
            symbol |= one.astype(np.int64) << b
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i


class FMIndex:
    """Index of ``seq``: symbols 1.. with 0 after every document, the last symbol included."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE) -> None:
        self.n, top = len(seq), int(seq.max()) if len(seq) else 0
        order = suffix_array(seq)
        self.wavelet = WaveletMatrix(seq[order - 1], max(1, top.bit_length()))
        symbols = np.arange(top + 1)
        first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))[:-1]])
        self.shift = first - self.wavelet.down(symbols, np.zeros(top + 1, np.int64))
        keep = (order % sample == 0) | (seq[order - 1] == 0)  # document starts too: no walk leaves a document
        self.sampled, self.places = Bits(keep), order[keep]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases (symbols, one per line, left-aligned); symbols outside the alphabet occur nowhere."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        wide = np.arange(phrases.shape[1])[None, :] < lengths[:, None]
        live = np.flatnonzero((lengths > 0) & ~(((phrases < 1) | (phrases >= len(self.shift))) & wide).any(axis=1))
        hi[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = phrases[live, lengths[live] - back]
            both = self.wavelet.down(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.shift[c] + both[: len(live)], self.shift[c] + both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            here = self.sampled.get(at)
            out[todo[here]] = self.places[self.sampled.ones(at[here])] + walked[todo[here]]
            todo, at = todo[~here], at[~here]
            walked[todo] += 1
            symbol, place = self.wavelet.follow(at)
            at = self.shift[symbol] + place
        return out


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """Word hashes of all windows of a text, one per line, filled with 0; a shorter text is one window."""
    h = word_hashes(np.frombuffer(text.encode(), np.uint8), ALNUM_WORDS)[2]
    if len(h) < size:
        return np.concatenate([h, np.zeros(size - len(h), np.uint64)])[None, :] if len(h) else np.zeros((0, size), np.uint64)
    return np.lib.stride_tricks.sliding_window_view(h, size)


class Phrases:
    """Distinct windows of benchmark items and the items of each."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW) -> None:
        per = [windows(t, size) for _, t in items]
        owner = np.repeat(np.arange(len(items)), [len(w) for w in per])
        every = np.concatenate([*per, np.zeros((0, size), np.uint64)])
        self.names = [i for i, _ in items]
        self.hashes, line = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, np.int64))
        pairs = np.unique(np.stack([line.reshape(-1), owner]), axis=1)
        self.owners, self.begins = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.hashes) + 1))
        self.lengths = np.zeros(len(self.hashes), np.int64)
        for j in range(size):
            self.lengths[self.hashes[:, j] != 0] = j + 1


def search_shard(texts: list[bytes], phrases: Phrases, size: int = WINDOW) -> list[tuple[int, list[tuple[int, int, int, int]], set[int]]]:
    """Per text: number of words, merged spans (first word, end word, first byte, end byte), items found. Equal texts are indexed once."""
    distinct = list(dict.fromkeys(texts))
    raw = np.frombuffer(b"\n".join(distinct), np.uint8)
    start, end, h = word_hashes(raw, ALNUM_WORDS)
    begin = np.cumsum([0] + [len(t) + 1 for t in distinct])
    first = np.searchsorted(start, begin)  # first word of each text
    number = np.diff(first)
    found: list[tuple[int, list, set]] = [(int(k), [], set()) for k in number]
    vocabulary, symbol = np.unique(h, return_inverse=True)
    at = np.searchsorted(vocabulary, phrases.hashes)
    known = at < len(vocabulary)
    known &= vocabulary[np.minimum(at, max(len(vocabulary) - 1, 0))] == phrases.hashes if len(vocabulary) else False
    wanted = np.where(known & (phrases.hashes != 0), at + 1, -1)
    doc = np.repeat(np.arange(len(distinct)), number)
    seq = np.zeros(len(h) + len(distinct), np.int64)
    seq[np.arange(len(h)) + doc] = symbol + 1
    if len(h) and len(wanted):
        index = FMIndex(seq)
        lo, hi = index.search(wanted, phrases.lengths)
        hits = hi - lo
        which = np.repeat(np.arange(len(hits)), hits)
        rows = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
        place = index.locate(rows)
        d = np.searchsorted(first[:-1] + np.arange(len(distinct)), place, side="right") - 1
        # items of each document: its distinct phrases first, so that neither places nor items multiply
        once = np.unique(d * len(hits) + which)
        for k, w in zip((once // len(hits)).tolist(), (once % len(hits)).tolist(), strict=True):
            found[k][2].update(phrases.owners[phrases.begins[w] : phrases.begins[w + 1]].tolist())
        # words covered
        cover = np.zeros(len(seq) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + phrases.lengths[which], -1)
        edge = np.diff((np.cumsum(cover) > 0).view(np.int8), prepend=np.int8(0))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            k = int(np.searchsorted(first[:-1] + np.arange(len(distinct)), a, side="right") - 1)
            wa, wb = a - k, b - k  # words of the shard
            found[k][1].append((int(wa - first[k]), int(wb - first[k]), int(start[wa] - begin[k]), int(end[wb - 1] - begin[k])))
    at_text = {t: i for i, t in enumerate(distinct)}
    return [found[at_text[t]] for t in texts]


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans in order, those that meet or overlap as one."""
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], s[1]), last[2], max(last[3], s[3]))
        else:
            out.append(tuple(s))
    return out


def search_long(text: bytes, phrases: Phrases, size: int, piece: int) -> tuple[int, list, set]:
    """A text beyond the shard size, in pieces that share ``size - 1`` words."""
    start, end, _ = word_hashes(np.frombuffer(text, np.uint8), ALNUM_WORDS)
    total, spans, items, a = len(start), [], set(), 0
    while a < total:
        b = max(int(np.searchsorted(end, start[a] + piece, side="right")), min(a + size, total))
        byte = int(start[a])
        _, s, i = search_shard([text[byte : int(end[b - 1])]], phrases, size)[0]
        spans += [(x + a, y + a, p + byte, q + byte) for x, y, p, q in s]
        items |= i
        if b >= total:
            break
        a = b - size + 1
    return total, merged(spans), items


SPAN_FIELDS = ("start", "end", "from_byte", "to_byte")
SPAN = pa.struct([(k, pa.int64()) for k in SPAN_FIELDS])
FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
FOUND_TYPE = "struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint, from_byte: bigint, to_byte: bigint>>, items: array<string>>"


def _search_functions(shared, size: int, shard_bytes: int):
    """Column functions that search one block of phrases: in texts, and in texts with what earlier blocks have found."""

    def search(texts: pa.Array, before: pa.Array | None) -> pa.Array:
        phrases = shared.value
        raw, off = text_buffers(texts)
        known = before.to_pylist() if before is not None else [None] * len(texts)
        rows = []
        for a, b in runs(np.diff(off), shard_bytes):
            part = [raw[off[i] : off[i + 1]].tobytes() for i in range(a, b)]
            rows += [search_long(part[0], phrases, size, shard_bytes)] if b - a == 1 and len(part[0]) > shard_bytes else search_shard(part, phrases, size)
        made = []
        for (words, spans, items), old in zip(rows, known, strict=True):
            names = {phrases.names[i] for i in items}
            if old is not None:
                spans = merged(spans + [tuple(s[k] for k in SPAN_FIELDS) for s in old["spans"]])
                names |= set(old["items"])
            made.append({"n_words": words, "spans": [dict(zip(SPAN_FIELDS, s, strict=True)) for s in spans], "items": sorted(names)})
        return pa.array(made, FOUND)

    @F.arrow_udf(FOUND_TYPE)
    def first(texts: pa.Array) -> pa.Array:
        return search(texts, None)

    @F.arrow_udf(FOUND_TYPE)
    def further(texts: pa.Array, before: pa.Array) -> pa.Array:
        return search(texts, before)

    return first, further


def find_phrases(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, item: str = "item_id", item_text: str = "text",
    size: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_chars: int = BLOCK_CHARS, name: str = "contamination",
) -> DataFrame:
    """Adds struct column ``name``: n_words, spans (half-open, in words and in UTF-8 bytes), items (ids as strings, sorted).

    A phrase is a window of ``size`` consecutive words of an item; an item with fewer words, but not none, is one phrase. Words
    are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased. ``keep`` names the columns to return (all); an older
    column ``name`` is replaced.
    Null and empty texts have 0 words and no spans; null item texts and items without words are not searched; repeated rows
    are each answered; an empty benchmark finds nothing. Nothing is shuffled: phrases go to the documents in blocks of bounded
    size (only one item's text must fit), the index of a shard lives in its task.
    """
    keep = others(docs, keep, name)
    sc = docs.sparkSession.sparkContext
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    found = F.lit(None).cast(FOUND_TYPE)
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().collect()
        first, further = _search_functions(sc.broadcast(Phrases([(r["i"], r["t"]) for r in mine], size)), size, shard_bytes)
        found = first(F.col(text)) if block == 0 else further(F.col(text), found)
    return docs.select(*map(quoted, keep), found.alias(name))


def hit_words(found=None):
    """Words inside any span of a ``contamination`` column."""
    found = F.col("contamination") if found is None else found
    return F.aggregate(found["spans"], F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])


def contaminated(found=None, share: int = 20):
    """The rule of the contract: some word is hit, and at least one in ``share`` words."""
    found = F.col("contamination") if found is None else found
    return (hit_words(found) > 0) & (hit_words(found) * share >= found["n_words"])


def cut_spans(text: str, spans: list) -> str:
    """The text without its removal spans."""
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["from_byte"]])
        at = s["to_byte"]
    return b"".join([*out, raw[at:]]).decode()

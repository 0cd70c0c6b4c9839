"""Cross-tokenizer alignment: groups between common token ends, found by divide and conquer, and statistics of linked id pairs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sitewright.llm.common import quoted, runs, text_buffers, written
from sitewright.llm.tokens import RANKS, VOCABULARY, encoder, vocabulary_file

PIECES = "piece_bpe_32k.model"
NEAR = 16  # ends on either side of the middle that are tried one by one before whole windows are
PORTION_BYTES = 1 << 17  # bytes of text that are aligned at once
BLOCK_BYTES = 1 << 22  # bytes of text whose linked pairs are looked up together

# ---- common ends ---------------------------------------------------------------------------------------------------


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in ``a`` of the ends that ``b`` has too; both sorted, without repeats, with the same last end.

    Divide and conquer: each interval looks for a common end near its middle, by bisect of ends of ``a`` in ``b`` from the middle
    outwards, and falls into the two halves beside it; an interval without one is a leaf. All intervals of a level go together. An
    interval is bisected in ``b`` only between its own bounds. The nearest common end bounds a stretch without any, so
    each such stretch is read three times at most and the whole takes O(n log n).
    """
    if not len(a):
        return np.zeros(0, np.int64)
    found = [np.array([len(a) - 1])]
    lo, hi = np.array([0]), np.array([len(a) - 1])  # ends lo .. hi - 1 are open
    while len(lo):
        wide = lo < hi
        lo, hi = lo[wide], hi[wide]
        cut = np.full(len(lo), -1)
        middle, open_ = (lo + hi) // 2, np.arange(len(lo))
        for step in range(NEAR):
            for at in (middle[open_] + step, middle[open_] - step - 1):
                inside = (lo[open_] <= at) & (at < hi[open_]) & (cut[open_] < 0)
                i = open_[inside]
                at = at[inside]
                same = b[np.searchsorted(b, a[at])] == a[at]
                cut[i[same]] = at[same]
            open_ = open_[cut[open_] < 0]
            open_ = open_[(middle[open_] + step + 1 < hi[open_]) | (middle[open_] - step - 2 >= lo[open_])]
            if not len(open_):
                break
        for i in open_:  # few: long stretches without a common end
            cut[i] = _nearest(a, b, int(lo[i]), int(hi[i]), int(middle[i]))
        split = cut >= 0
        found.append(cut[split])
        lo, hi = np.stack([lo[split], cut[split] + 1], 1).ravel(), np.stack([cut[split], hi[split]], 1).ravel()  # in order: neighbours in memory
    return np.sort(np.concatenate(found))


def _nearest(a: np.ndarray, b: np.ndarray, lo: int, hi: int, middle: int) -> int:
    """The common end in [lo, hi) nearest to ``middle``, looked for in windows that double; -1: none."""
    done, width = NEAR, NEAR
    while middle + done < hi or middle - done > lo:
        right = np.arange(middle + done, min(middle + done + width, hi))
        left = np.arange(max(middle - done - width, lo), max(middle - done, lo))
        r, k = (x[b[np.searchsorted(b, a[x])] == a[x]] for x in (right, left))
        if len(r) or len(k):
            return int(min([*r[:1], *k[-1:]], key=lambda x: abs(int(x) - middle)))
        done, width = done + width, 2 * width
    return -1


# ---- two tokenizers ------------------------------------------------------------------------------------------------


class Pair:
    """Both tokenizers: ids of a text and the bytes each id stands for. A reads a space and the text, B adds that space itself."""

    def __init__(self, vocabulary: str, ranks: str | None, pieces: str) -> None:
        import sentencepiece

        self.a = encoder(vocabulary, ranks, False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(pieces))
        self.bytes_a, self.bytes_b = self._bytes_a(), self._bytes_b()
        self._flat: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def _bytes_a(self) -> list[bytes]:
        """Byte letters back to bytes: printable Latin-1 stands for itself, all other bytes in order for U+0100 and on."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
        full = self.a.full
        out = [b""] * full.get_vocab_size(with_added_tokens=True)
        for token, i in full.get_vocab(with_added_tokens=False).items():
            out[i] = bytes(letter[c] for c in token)
        for i, t in full.get_added_tokens_decoder().items():
            out[i] = t.content.encode()
        return out

    def _bytes_b(self) -> list[bytes]:
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        return [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for p in names]

    def tables(self, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids of a side one after the other, and where each id's begin."""
        if side not in self._flat:
            t = self.bytes_a if side == "a" else self.bytes_b
            self._flat[side] = np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])[:-1]
        return self._flat[side]


_PAIRS: dict[tuple, Pair] = {}


def pair(vocabulary: str = VOCABULARY, ranks: str | None = RANKS, pieces: str = PIECES) -> Pair:
    """One per Python worker."""
    key = (vocabulary, ranks, pieces)
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


def spelled(flat: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bytes of these ids one after the other."""
    n = length[ids]
    ends = np.cumsum(n)
    return flat[np.repeat(start[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Portion:
    """Several texts aligned at once: their tokens stand one after the other, and every text's end is a common end."""

    def __init__(self, two: Pair, texts: list[bytes]) -> None:
        raws = [b" " + t if t else b"" for t in texts]
        a = [two.a.ids(r) for r in raws]
        b = [np.array(x, dtype=np.uint32) for x in two.b.encode([t.decode() for t in texts], num_threads=1)]
        sizes = np.array([len(r) for r in raws], np.int64)
        good = sizes > 0
        for ids, length, side in ((a, two.length_a, "a"), (b, two.length_b, "b")):  # tokens' bytes must be a space and the text
            good &= np.array([int(length[x].sum()) for x in ids], np.int64) == sizes
            at = np.flatnonzero(good)
            if len(at):
                same = spelled(*two.tables(side), length, np.concatenate([ids[k] for k in at])) == np.frombuffer(b"".join(raws[k] for k in at), np.uint8)
                good[at] = np.logical_and.reduceat(same, np.cumsum(sizes[at]) - sizes[at])
        none = np.zeros(0, np.uint32)
        a, b = ([x if g else none for x, g in zip(ids, good, strict=True)] for ids in (a, b))
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate(ids).astype(np.int64) for ids in (a, b))
        self.end_a, self.end_b = np.cumsum(two.length_a[self.a]), np.cumsum(two.length_b[self.b])
        size = int(self.end_a[-1]) + 1 if len(self.a) else 1
        self.mark_a, self.mark_b = np.zeros(size, bool), np.zeros(size, bool)
        self.mark_a[self.end_a] = self.mark_b[self.end_b] = True
        self.upto_a, self.upto_b = np.cumsum(self.mark_a), np.cumsum(self.mark_b)
        self.last_a = common_ends(self.end_a, self.end_b)  # last token of each group
        self.last_b = self.upto_b[self.end_a[self.last_a]] - 1
        self.stop_a = np.cumsum(self.n_a)  # tokens up to the end of each text
        self.n_groups = np.diff(np.searchsorted(self.last_a, self.stop_a), prepend=0)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in A, in B and the text of every pair of overlapping tokens: one for each stretch between neighbouring ends of either."""
        ends = np.flatnonzero(self.mark_a | self.mark_b)
        i, j = self.upto_a[ends] - self.mark_a[ends], self.upto_b[ends] - self.mark_b[ends]
        return i, j, np.repeat(np.arange(len(self.n_a)), self.n_a)[i]

    def written_out(self, names: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text; ``names``: see :func:`marked_ids`."""
        n = len(names[1]) // 4
        out = np.empty(len(self.a) + len(self.b), np.int64)
        first_a, first_b = (np.concatenate([[0], x[:-1] + 1]) if len(x) else x for x in (self.last_a, self.last_b))
        size_a, size_b = self.last_a - first_a + 1, self.last_b - first_b + 1
        mark_a, mark_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        mark_a[self.last_a], mark_b[self.last_b] = 1, 2
        mark_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3
        out[np.arange(len(self.a)) + np.repeat(first_b, size_a)] = self.a + n * mark_a
        out[np.arange(len(self.b)) + np.repeat(self.last_a + 1, size_b)] = self.b + n * mark_b
        letters, width = names
        lines = iter(letters[out][np.arange(letters.shape[1]) < width[out][:, None]].tobytes().split(b"\n"))
        return [next(lines) if k else b"" for k in self.n_a]

    def groups(self) -> list[list[dict]]:
        """Groups of each text: ids of both sides and the byte of space + text at which the group ends."""
        a, b = np.split(self.a, self.last_a[:-1] + 1), np.split(self.b, self.last_b[:-1] + 1)
        ends, texts = self.end_a[self.last_a], np.repeat(np.arange(len(self.n_a)), self.n_groups)
        base = np.concatenate([[0], self.end_a])[self.stop_a - self.n_a]
        out: list[list[dict]] = [[] for _ in self.n_a]
        for k, x, y, end in zip(texts.tolist(), a, b, (ends - base[texts]).tolist()):  # empty arrays split into one empty part
            out[k].append({"a": x.tolist(), "b": y.tolist(), "end": end})
        return out


def marked_ids(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids below ``n`` followed by , then | then ; then a line end: letters in rows, and how many of each row count."""
    names = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";", b"\n") for i in range(n)]
    width = np.array([len(x) for x in names])
    return np.array(names, dtype=f"S{width.max()}").view(np.uint8).reshape(len(names), -1), width


def _portions(batches: Iterator[pa.RecordBatch], two: Pair, size: int) -> Iterator[tuple[pa.RecordBatch, Portion, int]]:
    """Rows, the alignment of their texts (the last column) and the texts' bytes, about ``size`` bytes at a time; a longer text goes alone."""
    for batch in batches:
        raw, off = text_buffers(batch.column(batch.num_columns - 1))
        for i, k in runs(np.diff(off), size):
            yield batch.slice(i, k - i), Portion(two, [raw[off[n] : off[n + 1]].tobytes() for n in range(i, k)]), int(off[k] - off[i])


def _picked(docs: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    return docs.select(*[F.col(quoted(k)) for k in keys], F.col(quoted(text)).cast("string").alias("__text"))


def align(
    docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, ranks: str | None = RANKS, pieces: str = PIECES,
    portion_bytes: int = PORTION_BYTES,
) -> DataFrame:
    """Groups of every text: the ``keys`` columns and groups array<struct<a: ids, b: ids, end: byte of space + text>>.

    A group is a smallest run of tokens of both sides that covers the same bytes. The cases are those of :func:`link_statistics`.
    """
    schema = ", ".join([f"{quoted(k)} {docs.schema[k].dataType.simpleString()}" for k in keys] + ["groups array<struct<a: array<int>, b: array<int>, `end`: bigint>>"])
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, portion, _ in _portions(batches, pair(vocabulary, ranks, pieces), portion_bytes):
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], pa.array(portion.groups(), kind)], [*keys, "groups"])

    return _picked(docs, text, keys).mapInArrow(run, schema)


# ---- statistics of linked pairs ------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    small = next(t for t in (np.uint8, np.uint16, np.uint32) if not len(x) or x.max() <= np.iinfo(t).max)
    return np.dtype(small).char.encode() + zlib.compress(x.astype(small).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[1:]), np.dtype(x[:1].decode())).astype(np.int64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _linked(docs: DataFrame, text: str, keys: tuple[str, ...], vocabulary: str, ranks: str | None, pieces: str, block_bytes: int, portion_bytes: int) -> DataFrame:
    """One row per block of texts: its texts' columns and counts, the distinct id pairs linked in it with the number of texts that hold
    each, and for every text the places of its pairs among those and how often it links them."""
    source = _picked(docs, text, keys)
    named = [f"k{i}" for i in range(len(keys))]
    inner = ", ".join([f"{n}: {docs.schema[k].dataType.simpleString()}" for n, k in zip(named, keys, strict=True)] + [f"{n}: bigint" for n in (*COUNTS, "n_pairs")] + ["groups_sha256: string"])
    key_fields = to_arrow_schema(source.select(*[F.col(quoted(k)).alias(n) for n, k in zip(named, keys, strict=True)]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = pair(vocabulary, ranks, pieces)
        n_ids_a, n_ids_b = len(two.bytes_a), len(two.bytes_b)
        names = marked_ids(max(n_ids_a, n_ids_b))
        fields = [*key_fields, *[pa.field(n, pa.int64()) for n in (*COUNTS, "n_pairs")], pa.field("groups_sha256", pa.string())]
        told, pairs, often, number, size = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            texts = pa.concat_arrays(told)
            distinct, place, n_texts = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (texts, pa.array(distinct.astype(np.int64)), pa.array(n_texts.astype(np.int64)))]
            packed = [pa.array([_packed(x)], pa.binary()) for x in (np.diff(place, prepend=0) % max(len(distinct), 1), np.concatenate(often))]
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | number]), *lists, *packed], ["block", "texts", "pairs", "n_texts", "places", "times"])

        for rows, portion, n_bytes in _portions(batches, two, portion_bytes):
            if told and size + n_bytes > block_bytes:
                yield block()
                told, pairs, often, number, size = [], [], [], number + 1, 0
            i, j, text_no = portion.links()
            linked, times = np.unique((text_no * n_ids_a + portion.a[i]) * n_ids_b + portion.b[j], return_counts=True)
            text_no, linked = np.divmod(linked, n_ids_a * n_ids_b)
            sha = [hashlib.sha256(x).hexdigest() if x else "" for x in portion.written_out(names)]
            n_links = np.where(portion.n_a > 0, portion.n_a + portion.n_b - portion.n_groups, 0)
            per = [portion.n_a, portion.n_b, portion.n_groups, n_links, np.bincount(text_no, minlength=rows.num_rows)]
            told.append(pa.StructArray.from_arrays([*[c.cast(f.type) for c, f in zip(rows.columns, key_fields)], *map(pa.array, per), pa.array(sha, pa.string())], fields=fields))
            pairs.append(linked)
            often.append(times)
            size += n_bytes
        if told:
            yield block()

    return written(source.mapInArrow(run, f"block bigint, texts array<struct<{inner}>>, pairs array<bigint>, n_texts array<bigint>, places binary, times binary"), "linked")


def link_statistics(
    docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, ranks: str | None = RANKS, pieces: str = PIECES,
    block_bytes: int = BLOCK_BYTES, portion_bytes: int = PORTION_BYTES,
) -> DataFrame:
    """How two tokenizers agree on every text.

    A encodes a space and the text, B the text, to which it adds that space; strings of special tokens are ordinary text. The
    bytes at which tokens of both end cut them into groups; every two tokens with a common byte are linked. The count of an id pair is the
    number of rows in which it is linked at least once.

    One row per input row, with the ``keys`` columns and: n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest
    that their A id has anywhere, ties included), count_sum (sum of the links' counts), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``). A null
    or empty text, or one whose tokens' bytes are not a space and the text, has zeros and an empty string. Repeated rows stay and count
    apiece; other columns are not read; a text is encoded whole, however long.

    Texts are encoded once. What they link is kept per block of about ``block_bytes`` of text, and only a block's distinct pairs meet the
    corpus-wide counts: a common pair is one row per block, so that a join partition of a hot pair can be split, and what comes back to a
    block is bounded by it.
    """
    blocks = _linked(docs, text, keys, vocabulary, ranks, pieces, block_bytes, portion_bytes)
    asked = blocks.select("block", F.explode(F.arrays_zip("pairs", "n_texts")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.n_texts").alias("n"))
    n_ids_b = pair(vocabulary, ranks, pieces).b.get_piece_size()
    totals = asked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {n_ids_b}"))
    highest = F.max("n").over(Window.partitionBy("a"))  # an A id has at most as many pairs as B has ids
    totals = totals.select("pair", F.col("n").alias("count"), (F.col("n") == highest).alias("best"))
    told = asked.select("block", "pair").join(totals, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "count", "best"))).alias("t"))
    told = told.select("block", F.col("t.count").alias("count"), F.col("t.best").alias("best"))
    joined = blocks.select("block", "texts", "places", "times").join(told, "block", "left")
    names = [*COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join([f"{quoted(k)} {docs.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} bigint" for n in names[:-1]] + ["groups_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                texts = row.column("texts").flatten().flatten()
                n_pairs = np.asarray(texts[len(keys) + len(COUNTS)])
                times = _unpacked(row.column("times")[0].as_py())
                count = np.asarray(row.column("count").flatten(), dtype=np.int64)
                best = np.asarray(row.column("best").flatten().cast(pa.int64()), dtype=np.int64)
                place = np.cumsum(_unpacked(row.column("places")[0].as_py())) % max(len(count), 1)
                ends = np.cumsum(n_pairs)
                sums = [np.concatenate([[0], np.cumsum(times * x[place])]) if len(times) else np.zeros(1, np.int64) for x in (best, count)]
                n_best, count_sum = (pa.array(s[ends] - s[ends - n_pairs]) for s in sums)
                yield pa.RecordBatch.from_arrays([*texts[: len(keys) + len(COUNTS)], n_best, count_sum, texts[-1]], [*keys, *names])

    return joined.mapInArrow(run, schema)

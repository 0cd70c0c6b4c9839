"""Token ids of whole texts, and token counts per field or section by offset-mapped attribution."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import text_buffers

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
RULES = ("most", "first", "last")


def vocabulary_file(name: str) -> str:
    """A path as it is; a bare name is looked up among the installed public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of the byte-level vocabulary ``vocabulary``.

    ``ranks`` names the same vocabulary as a rank file; texts up to U+023F go through it, as both libraries split those alike
    and it is four times as fast. All other texts go through the vocabulary's own library. Without ``ranks`` all do.
    Strings of special tokens are ordinary text, or with ``special`` single ids, as the library reads them by default; texts that
    hold one then go through the library.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, special: bool = False) -> None:
        self.vocabulary, self._full, self.fast, self.special = vocabulary, None, None, special
        self._added: tuple[bytes, ...] | None = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(vocabulary_file(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @property
    def full(self):
        """The vocabulary's own library, loaded when a text first needs it."""
        if self._full is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(vocabulary_file(self.vocabulary))
            self._full.encode_special_tokens = not self.special
        return self._full

    @property
    def added(self) -> tuple[bytes, ...]:
        """Strings that are single ids wherever they stand."""
        if self._added is None:
            self._added = ()
            if self.special:  # from the file, as most workers never need the library
                with open(vocabulary_file(self.vocabulary), "rb") as f:
                    self._added = tuple(t["content"].encode() for t in json.load(f)["added_tokens"])
        return self._added

    def ids(self, raw: bytes) -> np.ndarray:
        if not raw:
            return np.zeros(0, np.uint32)
        if self.fast is not None and np.frombuffer(raw, np.uint8).max() <= 0xC8 and not any(t in raw for t in self.added):
            return np.asarray(self.fast.encode_to_numpy(raw.decode(), disallowed_special=()), dtype=np.uint32)
        return np.asarray(self.full.encode(raw.decode(), add_special_tokens=False).ids, dtype=np.uint32)

    def byte_lengths(self) -> np.ndarray:
        """Bytes that each id stands for: in a byte-level vocabulary every character of a token is one byte."""
        out = np.zeros(self.full.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, i in self.full.get_vocab(with_added_tokens=True).items():
            out[i] = len(token)
        for i, t in self.full.get_added_tokens_decoder().items():
            out[i] = len(t.content.encode())  # added tokens are text, not byte letters
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY, ranks: str | None = RANKS, special: bool = False) -> Encoder:
    """One encoder per Python worker."""
    key = (vocabulary, ranks, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def char_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of consecutive tokens with these byte lengths; a token with part of a character covers it whole."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    begun = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return begun[starts] - 1, begun[ends - 1]


def allocate(token_start, token_end, section_start, section_end, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with sorted, disjoint section spans.

    Returns each token's section (-1: touches none) and whether it crosses a boundary, that is, is not wholly inside one
    section or wholly outside all. A crossing token counts once, whole: for the section that holds most of its characters
    (``most``; ties to the earlier one), or for the ``first`` or ``last`` section it touches.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    first = np.searchsorted(section_end, token_start, side="right")
    last = np.searchsorted(section_start, token_end, side="left") - 1
    n = last - first + 1
    touches = n > 0
    pick = np.where(touches, first, -1)
    safe = np.minimum(first, max(len(section_start) - 1, 0))
    inside = touches & (n == 1)
    if len(section_start):
        inside &= (section_start[safe] <= token_start) & (token_end <= section_end[safe])
    crossing = touches & ~inside
    if rule == "last":
        pick = np.where(touches, last, -1)
    elif rule == "most" and (several := np.flatnonzero(n > 1)).size:
        counts = n[several]
        base = np.cumsum(counts) - counts
        section = np.repeat(first[several] - base, counts) + np.arange(counts.sum())
        shared = np.minimum(np.repeat(token_end[several], counts), section_end[section]) - np.maximum(
            np.repeat(token_start[several], counts), section_start[section]
        )
        best = np.repeat(np.maximum.reduceat(shared, base), counts)
        where = np.where(shared == best, section, np.iinfo(np.int64).max)
        pick[several] = np.minimum.reduceat(where, base)
    return pick, crossing


def sentence_sections(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Sections of a text: its sentences, cut at line ends and at a space after . ! or ?, without those separators.

    Field ``title`` holds the sentences of the first line where more lines follow, else all are ``body``.
    """
    b = np.frombuffer(raw, np.uint8)
    begun = np.cumsum((b & 0xC0) != 0x80)
    stop = np.isin(b, [ord("."), ord("!"), ord("?")])
    gap = b == 10
    gap[1:] |= (b[1:] == 32) & stop[:-1]
    edge = np.diff((~gap).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.flatnonzero(b == 10)
    field = np.ones(len(start), np.int64)
    if len(line) and len(start) and start[-1] > line[0]:
        field[start < line[0]] = 0
    return begun[start] - 1, begun[end - 1], field, ["title", "body"]


SCHEMA = "n_tokens bigint, n_sections bigint, n_crossing bigint, n_outside bigint, fields array<struct<field: string, n_sections: bigint, n_tokens: bigint>>"


def attribute_tokens(
    docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), sections: str | None = None, rule: str = "most",
    sectioner: Callable = sentence_sections, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, special: bool = False,
) -> DataFrame:
    """Tokens per field of every row's text.

    The whole text is encoded once; its tokens' character spans are joined with the sections' spans. ``sections`` names a
    column array<struct<field: string, start: bigint, end: bigint>> (half-open character spans, disjoint, in any order; null
    and empty spans are left out); without it ``sectioner`` cuts the text. One row per input row, with the ``keys`` columns
    and: n_tokens, n_sections, n_crossing, n_outside (tokens that touch no section), fields (per field, by name: sections,
    tokens). The tokens of all fields and n_outside sum to n_tokens. A null or empty text has 0 tokens and no sections but
    those given. Repeated rows stay; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    cols = [F.col(k) for k in keys] + [F.col(text).alias("__text")] + ([F.col(sections).alias("__sections")] if sections else [])
    source = docs.select(*cols)
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys] + [SCHEMA])
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks, special)
        lengths = enc.byte_lengths()
        out_type = None
        for batch in batches:
            raw, off = text_buffers(batch.column(len(names)))
            given = batch.column(len(names) + 1).to_pylist() if sections else None
            rows = []
            for i in range(batch.num_rows):
                one = raw[off[i] : off[i + 1]].tobytes()
                ids = enc.ids(one)
                ts, te = char_spans(one, lengths[ids]) if len(ids) else (np.zeros(0, np.int64),) * 2
                if given is None:
                    ss, se, fi, labels = sectioner(one)
                else:
                    spans = sorted(
                        (s["start"], s["end"], s["field"] or "") for s in given[i] or []
                        if s is not None and s["start"] is not None and s["end"] is not None and s["start"] < s["end"]
                    )
                    labels = sorted({s[2] for s in spans})
                    at = {x: j for j, x in enumerate(labels)}
                    ss, se = (np.array([s[k] for s in spans], dtype=np.int64) for k in (0, 1))
                    fi = np.array([at[s[2]] for s in spans], dtype=np.int64)
                pick, crossing = allocate(ts, te, ss, se, rule)
                tokens = np.bincount(fi[pick[pick >= 0]], minlength=len(labels)) if len(ss) else np.zeros(len(labels), np.int64)
                per = np.bincount(fi, minlength=len(labels)) if len(ss) else tokens
                rows.append({
                    "n_tokens": len(ids), "n_sections": len(ss), "n_crossing": int(crossing.sum()), "n_outside": int((pick < 0).sum()),
                    "fields": [{"field": f, "n_sections": int(a), "n_tokens": int(b)} for f, a, b in sorted(zip(labels, per, tokens, strict=True)) if a],
                })
            out_type = out_type or pa.schema([
                ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("n_outside", pa.int64()),
                ("fields", pa.list_(pa.struct([("field", pa.string()), ("n_sections", pa.int64()), ("n_tokens", pa.int64())]))),
            ])
            new = pa.RecordBatch.from_pylist(rows, schema=out_type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new.columns], [*names, *new.schema.names])

    return source.mapInArrow(run, schema)

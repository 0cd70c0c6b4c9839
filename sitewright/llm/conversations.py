"""Conversation structure repair: dynamic programming over grammar-compressed role and fault sequences.

A conversation is a sequence of letters, one per row: its role and its first fault. Re-Pair rules, learned over all sequences, name
letter pairs that come again and again. Each rule has one min-plus transfer matrix between the four states of a conversation, with
the audit (the edits' initials) of each entry as a rope; rules are evaluated bottom-up from their two parts, once per worker, and serve
every conversation.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import written

CHUNK_BITS = 12  # a chunk holds up to 4096 consecutive rows of one conversation
ROUNDS, RULES_PER_ROUND = 8, 64  # bounds the grammar: at most 512 rules, whatever the input
MEMO = 1 << 16  # sequences whose matrices a worker remembers

#: states: nothing yet, after a system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
#: letters: role s, u, a or other (x), upper case where truncated; b blank and d duplicate must go whatever their role
LETTERS = "suaxSUAXbd"
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
STEP = {"u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
#: what a conversation may still need at its end, per state
TAIL = ("", "II", "I", "")
FAR = 1 << 60

# ---- ropes ---------------------------------------------------------------------------------------------------------

SHORT = 256


def joined(a, b):
    """Concatenation: short ropes are plain strings, long ones (length, left, right)."""
    if type(a) is str and type(b) is str and len(a) + len(b) <= SHORT:
        return a + b
    if not a or not b:
        return a or b
    return (size(a) + size(b), a, b)


def size(rope) -> int:
    return len(rope) if type(rope) is str else rope[0]


def pieces(rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        r = stack.pop()
        if type(r) is str:
            yield r
        else:
            stack += (r[2], r[1])


def before(a, b) -> bool:
    """Whether rope ``a`` comes before rope ``b`` in ASCII order. Shared parts at the same place are not read."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if type(x) is not str and (type(y) is str or x[0] >= y[0]):
            left += (x[2], x[1])
            right.append(y)
        elif type(y) is not str:
            right += (y[2], y[1])
            left.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if len(x) > n:
                left.append(x[n:])
            if len(y) > n:
                right.append(y[n:])
    return any(size(r) for r in right) and not any(size(r) for r in left)


# ---- transfer matrices ---------------------------------------------------------------------------------------------

Matrix = list  # 16 entries, row-major from state to state: (cost, rope) or None


def better(a, b):
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def letter_matrix(letter: str) -> Matrix:
    """Insertions in front of one row, then its own edit; so an audit always ends with the edit of a row."""
    out: Matrix = [None] * 16
    low, must_go = letter.lower(), letter in "bd"
    late = TRUNCATED if letter.isupper() else 0

    def put(p: int, q: int, cost: int, audit: str) -> None:
        out[4 * p + q] = better(out[4 * p + q], (cost, audit))

    for p in range(4):
        at, inserted = p, 0
        while inserted < 4:  # four insertions lead back to a state seen before
            cost, audit = COST["I"] * inserted, "I" * inserted
            put(p, at, cost + COST["D"], audit + "D")
            if not must_go:
                if low == "s" and at == START:
                    put(p, SYSTEM, cost + COST["K"] + late, audit + "K")
                for role, step in STEP.items():
                    if at in step:
                        if low == role:
                            put(p, step[at], cost + COST["K"] + late, audit + "K")
                        put(p, step[at], cost + COST["R"] + late, audit + "R")
            at, inserted = (ASSISTANT if at == USER else USER), inserted + 1
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; equal costs go to the ASCII-least audit.

    No audit of one sequence is a proper prefix of another of equal cost (it would lack insertions only, and those cost), so the
    least audit of the whole is made of least parts.
    """
    out: Matrix = [None] * 16
    for p in range(4):
        for q in range(4):
            best = None
            for k in range(4):
                x, y = a[4 * p + k], b[4 * k + q]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost < best[0]:
                    best = (cost, joined(x[1], y[1]))
                elif cost == best[0]:
                    best = better(best, (cost, joined(x[1], y[1])))
            out[4 * p + q] = best
    return out


class Grammar:
    """Rules in rounds: {(left, right): symbol}; symbols below ``len(LETTERS)`` are letters. One matrix per symbol, made when first needed."""

    def __init__(self, rounds: Sequence[dict[tuple[int, int], int]] = ()) -> None:
        self.rounds = list(rounds)
        self.parts = {n: pair for r in rounds for pair, n in r.items()}
        self._matrix: dict[int, Matrix] = {}
        self._whole: dict[str, Matrix] = {}

    def symbols(self, letters: str) -> list[int]:
        """The sequence with every rule applied, round by round, from the left."""
        s = [LETTERS.index(c) for c in letters]
        for rules in self.rounds:
            out, i, n = [], 0, len(s)
            while i < n:
                new = rules.get((s[i], s[i + 1])) if i + 1 < n else None
                out.append(s[i] if new is None else new)
                i += 1 if new is None else 2
            s = out
        return s

    def matrix(self, symbol: int) -> Matrix:
        todo = [symbol]
        while todo:  # bottom-up: parts before the rule
            n = todo[-1]
            if n in self._matrix:
                todo.pop()
            elif n < len(LETTERS):
                self._matrix[n] = letter_matrix(LETTERS[n])
            else:
                missing = [p for p in self.parts[n] if p not in self._matrix]
                if missing:
                    todo += missing
                else:
                    self._matrix[n] = product(*(self._matrix[p] for p in self.parts[n]))
        return self._matrix[symbol]

    def whole(self, letters: str) -> Matrix:
        """Matrix of a whole sequence of at least one letter; rows with the same sequence share it."""
        m = self._whole.get(letters)
        if m is None:
            level = [self.matrix(n) for n in self.symbols(letters)]
            while len(level) > 1:  # neighbours first, so that ropes stay flat
                level = [product(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            m = level[0]
            if len(self._whole) >= MEMO:
                self._whole.clear()
            self._whole[letters] = m
        return m


def next_rules(pairs: dict[tuple[int, int], int], first: int, at_most: int) -> dict[tuple[int, int], int]:
    """Rules for the commonest pairs such that no two occurrences can overlap: no symbol is the left part of one and the right part of another.

    A symbol may pair with itself if it stands in no other rule; such runs are paired from the left.
    """
    left, right, twin, out = set(), set(), set(), {}
    for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if n < 2 or len(out) == at_most:
            break
        if a == b:
            if a in left or a in right or a in twin:
                continue
            twin.add(a)
        elif a in right or b in left or {a, b} & twin:
            continue
        else:
            left.add(a)
            right.add(b)
        out[a, b] = first + len(out)
    return out


def learn(sequences: DataFrame, letters: str = "letters", n: str = "n", rounds: int = ROUNDS, per_round: int = RULES_PER_ROUND) -> Grammar:
    """Re-Pair over all rows (letters, n: how often), in rounds that replace many pairs at once.

    Each round counts the neighbours in the sequences as they are compressed so far, combined in the tasks before the shuffle. There are
    at most len(LETTERS) + rounds * per_round symbols, which bounds the pairs that come to the driver.
    """
    source, found = sequences.select(letters, n), []
    for _ in range(rounds):
        grammar = Grammar(found)

        def count(batches: Iterator[pa.RecordBatch], grammar=grammar) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for b in batches:
                for text, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    s, last = grammar.symbols(text), None
                    for i, pair in enumerate(zip(s, s[1:])):
                        if pair == last and pair[0] == pair[1]:
                            last = None  # the middle of a run counts for one pair only
                            continue
                        total[pair] += times
                        last = pair
            if total:
                yield pa.RecordBatch.from_pydict({"a": [p[0] for p in total], "b": [p[1] for p in total], "n": list(total.values())}, schema=pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

        pairs = source.mapInArrow(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n >= 2")
        new = next_rules({(r["a"], r["b"]): r["n"] for r in pairs.collect()}, len(LETTERS) + len(grammar.parts), per_round)
        if not new:
            break
        found.append(new)
    return Grammar(found)


# ---- rows to letters -----------------------------------------------------------------------------------------------

_SPACE = " \t\n\x0b\x0c\r"


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults by crc32(``conv:turn``) % 20: 0 drops the row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes its
    role user. Nulls of role and text, and of conv and turn in the checksum, count as one space. Returns those four columns."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    told = F.when(kind == 1, "").when(kind == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return df.select(
        conv, turn, F.when(kind == 4, "user").otherwise(space(role)).alias(role), told.alias(text), F.explode(F.array_repeat(F.lit(0), times)).alias("_")
    ).drop("_")


def _keyed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with short fixed names; ties of ``turn`` are ordered by role, then by a digest of the row."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    c = F.col(conv).cast("string")
    return df.select(
        F.col(conv).alias("c"), F.col(turn).cast("bigint").alias("turn"), r.alias("role"), t.alias("text"),
        F.md5(F.concat(F.coalesce(F.concat(F.lit("+"), F.length(c).cast("string"), F.lit(":"), c), F.lit("-")), F.lit("|"), F.length(r).cast("string"), F.lit(":"), r, F.lit("|"), t)).alias("digest"),
    )


def sequences(rows: DataFrame) -> DataFrame:
    """Chunks (c, chunk, turn, role, digest of the first row, letters) of at most 4096 consecutive rows of a conversation.

    Rows without texts are range-partitioned by conversation and order, so a conversation of any length lies over many tasks; a row's
    place in its partition is its position. Rows that repeat an earlier one of their conversation are found by an aggregation on the
    digest of (conversation, role, text), joined back for digests that occur more than once.
    """
    ends = F.rtrim(F.col("text"), F.lit(_SPACE))
    who = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    letter = F.when(ends == "", "b").when(F.substring(ends, -1, 1).isin(".", "!", "?"), who).otherwise(F.upper(who))
    keys = rows.select("c", "turn", "role", "digest", letter.alias("letter"))
    order = [F.col("c").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = keys.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    placed = written(placed, "turns")
    copies = placed.where("letter <> 'b'").groupBy("digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = placed.join(copies, "digest", "left").withColumn("letter", F.when(F.col("pos") > F.col("first"), "d").otherwise(F.col("letter")))
    chunk = marked.groupBy("c", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "letter", "turn", "role", "digest"))).alias("x"))
    head = F.col("x")[0]
    return chunk.select("c", "chunk", head["turn"].alias("turn"), head["role"].alias("role"), head["digest"].alias("digest"), F.array_join(F.col("x.letter"), "").alias("letters"))


def _routes(chunks: DataFrame, grammar: Grammar) -> DataFrame:
    """For each chunk and each state before it: the state after it and the edits on the cheapest way to the end, and that way's cost.

    A conversation's chunks come from its end to its start through one task, 4096 rows at a time and with nothing kept but four costs.
    """
    c = chunks.select("c", "chunk", "letters", "turn", "role", "digest").repartition("c").sortWithinPartitions(F.col("c").asc_nulls_first(), F.col("chunk").desc())
    kinds = chunks.schema
    schema = f"c {kinds['c'].dataType.simpleString()}, chunk bigint, letters string, turn bigint, role string, digest string, after array<int>, audits array<string>, costs array<bigint>"
    rounds = grammar.rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, now, ahead = Grammar(rounds), _NONE, None
        for b in batches:
            after, audits, costs = [], [], []
            for conv, letters in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if conv != now or now is _NONE:
                    now, ahead = conv, [COST["I"] * len(t) for t in TAIL]
                m, step = rules.whole(letters), []
                for p in range(4):
                    best, to = None, None
                    for q in range(4):
                        e = m[4 * p + q]
                        if e is not None and ahead[q] < FAR:
                            e = (e[0] + ahead[q], e[1])
                            if better(best, e) is e:
                                best, to = e, q
                    step.append((best, to))
                after.append([q for _, q in step])
                audits.append([None if e is None else "".join(pieces(e[1])) for e, _ in step])
                ahead = [FAR if e is None else e[0] for e, _ in step]
                costs.append(ahead)
            new = [pa.array(after, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string())), pa.array(costs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "after", "audits", "costs"])

    return c.mapInArrow(run, schema)


_NONE = object()


def _stream(rows: DataFrame, routes: DataFrame, known: DataFrame) -> DataFrame:
    """One sorted stream per conversation: a mark, then its rows, each chunk's route in front of the chunk's first row."""
    lines = rows.select("c", F.lit(1).alias("level"), "turn", "role", "digest", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("chunk"), "text", F.lit(None).cast("string").alias("letters"), *[F.lit(None).cast(t).alias(n) for n, t in _ROUTE])
    marks = known.select("c", F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("turn"), *[F.lit(None).cast("string").alias(n) for n in ("role", "digest")], F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("chunk"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("letters"), *[F.lit(None).cast(t).alias(n) for n, t in _ROUTE])
    ways = routes.select("c", F.lit(1).alias("level"), "turn", "role", "digest", F.lit(0).alias("kind"), "chunk", F.lit(None).cast("string").alias("text"), "letters", *[n for n, _ in _ROUTE])
    order = [F.col("c").asc_nulls_first(), F.col("level"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("kind"), F.col("chunk")]
    return lines.unionByName(ways).unionByName(marks).repartition("c").sortWithinPartitions(*order)


_ROUTE = (("after", "array<int>"), ("audits", "array<string>"), ("costs", "array<bigint>"))


class _Walk:
    """State of the walk through one conversation."""

    def __init__(self) -> None:
        self.at, self.cost, self.edits, self.n_out, self.system = START, None, [], 0, False
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.low = self.high = self.initial = None
        self.queue: list[str] = []
        self.used = 0

    def route(self, letters: str, after, audits, costs) -> None:
        if self.cost is None:
            self.cost = costs[START]
        self.blank += letters.count("b")
        self.duplicate += letters.count("d")
        self.truncated += sum(map(letters.count, "SUAX"))
        self.queue.append(audits[self.at])
        self.edits.append(audits[self.at])
        self.at = after[self.at]

    def _next_role(self) -> str:
        return "user" if (self.n_out - self.system) % 2 == 0 else "assistant"

    def _inserted(self):
        row = ("I", self._next_role(), "")
        self.n_out += 1
        return row

    def row(self, turn, role: str, text: str):
        """The edits that stand in front of this row and its own."""
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.high:
            self.n_turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        while True:
            if self.used == len(self.queue[0]):
                self.queue.pop(0)
                self.used = 0
                continue
            edit = self.queue[0][self.used]
            self.used += 1
            if edit == "I":
                yield self._inserted()
                continue
            if edit == "D":
                yield ("D", None, None)
                return
            if edit == "R":
                role = self._next_role()
            elif self.n_out == 0 and initial == "s":
                self.system = True
            self.n_out += 1
            yield (edit, role, text)
            return

    def end(self):
        if self.edits:
            self.edits.append(TAIL[self.at])
            for _ in TAIL[self.at]:
                yield self._inserted()

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.n_turns


def _walks(batches: Iterator[pa.RecordBatch]):
    """(conversation, walk, edits so far unread) for each part of the stream; the last part of a conversation is told by ``done``."""
    now, walk = _NONE, None
    for b in batches:
        for r in zip(*(b.column(n).to_pylist() for n in ("c", "level", "turn", "role", "kind", "text", "letters", "after", "audits", "costs")), strict=True):
            conv, level, turn, role, kind, text, letters, after, audits, costs = r
            if walk is None or conv != now:
                if walk is not None:
                    yield now, walk, list(walk.end()), True
                now, walk = conv, _Walk()
            if level == 0:
                continue
            if kind == 0:
                walk.route(letters, after, audits, costs)
            else:
                yield now, walk, list(walk.row(turn, role, text)), False
    if walk is not None:
        yield now, walk, list(walk.end()), True


def _prepared(df: DataFrame, known: DataFrame | None, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = _keyed(df, conv, turn, role, text)
    chunks = written(sequences(rows), "chunks")
    grammar = learn(chunks.groupBy("letters").agg(F.count("*").alias("n")))
    ids = (df if known is None else known).select(F.col(conv).alias("c")).distinct()
    return _stream(rows, _routes(chunks, grammar), ids)


def repaired_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every edit of every conversation in order: (conv, step from 0, edit K, R, D or I, role, text); role and text are null for D.

    The cases are those of :func:`repair_report`.
    """
    schema = f"`{conv}` {df.schema[conv].dataType.simpleString()}, step bigint, edit string, role string, text string"
    kind = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, step = [], 0
        for c, _, edits, done in _walks(batches):
            for e in edits:
                out.append((c, step, *e))
                step += 1
            step = 0 if done else step
            if len(out) >= 1000:
                yield _batch(out, [conv, "step", "edit", "role", "text"], [kind, pa.int64(), pa.string(), pa.string(), pa.string()])
                out = []
        if out:
            yield _batch(out, [conv, "step", "edit", "role", "text"], [kind, pa.int64(), pa.string(), pa.string(), pa.string()])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[conv].dataType)
    return _prepared(df, None, conv, turn, role, text).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(df: DataFrame, known: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults and cheapest repair per conversation.

    Rows are taken by ``turn``, nulls first, ties by role and then by an arbitrary fixed order of their texts. A row's first fault counts:
    blank (nothing but white space), duplicate (role and text stood earlier), truncated (its last character beside white space is not
    one of .!?). Edits: K keep 0, R make it user or assistant 3, D delete 4 (the only one for blank and duplicate rows), I insert an
    empty user or assistant row 3; a truncated row that stays adds 3. The roles' initials after the repair read ``(s?(ua)+)?``; among
    equal costs the ASCII-least audit is taken.

    One row per conversation of ``known`` (or of ``df``): conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of the ``role:text`` lines that stay). Null roles and texts count as one space; a null conversation is one of its
    own; other roles than those with initial s, u or a can't be kept. A conversation without rows has zeros, an empty audit and the hash of
    nothing. Rows repeated whole are duplicates. Other columns are not read.

    Rows are dealt by ranges of (conversation, order) for everything but the last pass, which reads a conversation's texts in order
    in one task, as SHA-256 can't be split; that pass sorts on disk and keeps one chunk's edits at a time, besides the audit it returns.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[conv].dataType)
    names = [conv, *REPORT, "audit", "repaired_sha256"]
    schema = f"`{conv}` {df.schema[conv].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in REPORT) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [kind, *[pa.int64()] * len(REPORT), pa.string(), pa.string()]
        out, sha, lines = [], hashlib.sha256(), 0
        for c, w, edits, done in _walks(batches):
            for edit, who, said in edits:
                if edit != "D":
                    sha.update((("\n" if lines else "") + f"{who}:{said}").encode())
                    lines += 1
            if done:
                out.append((c, w.gaps, w.blank, w.duplicate, w.truncated, w.illegal, w.cost or 0, "".join(w.edits), sha.hexdigest()))
                sha, lines = hashlib.sha256(), 0
                if len(out) >= 1000:
                    yield _batch(out, names, kinds)
                    out = []
        if out:
            yield _batch(out, names, kinds)

    return _prepared(df, known, conv, turn, role, text).mapInArrow(run, schema)

import functools
import hashlib
import random
import re
from collections import Counter

import pytest

from sitewright.llm.conversations import (
    ASSISTANT, LETTERS, START, SYSTEM, TAIL, USER, Grammar, before, better, damaged, joined, learn, next_rules, pieces, repair_report, repaired_messages,
)

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(letters: str):
    """(cost, audit) by trying every script of edits."""
    after_insert = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}

    @functools.lru_cache(None)
    def go(i, at, inserted):
        options = [(0, "")] if i == len(letters) and at in (START, ASSISTANT) else []

        def use(cost, edit, then):
            if then:
                options.append((cost + then[0], edit + then[1]))

        if inserted < 3:
            use(3, "I", go(i, after_insert[at], inserted + 1))
        if i < len(letters):
            x, late = letters[i].lower(), 3 if letters[i].isupper() else 0
            use(4, "D", go(i + 1, at, 0))
            if letters[i] not in "bd":
                if x == "s" and at == START:
                    use(late, "K", go(i + 1, SYSTEM, 0))
                role, to = ("a", ASSISTANT) if at == USER else ("u", USER)
                if x == role:
                    use(late, "K", go(i + 1, to, 0))
                use(3 + late, "R", go(i + 1, to, 0))
        return min(options, default=None)

    return go(0, START, 0)


def brute(rows):
    """The report of one conversation from its rows (turn, role, text) in order."""
    letters, seen, illegal = "", set(), 0
    for _, role, text in rows:
        t = text.strip(BLANKS)
        who = role[:1] if role[:1] in ("s", "u", "a") else "x"
        letters += "b" if not t else "d" if (role, text) in seen else who if t[-1] in ".!?" else who.upper()
        seen.add((role, text))
    for x, y in zip(rows, rows[1:]):
        illegal += x[1][:1] + y[1][:1] not in ("su", "ua", "au")
    cost, audit = cheapest(letters)
    lines, at, system = [], 0, 0
    for e in audit:
        role, text = ("", "") if e == "I" else rows[at][1:]
        if e == "K" and not lines and role[:1] == "s":
            system = 1
        at += e != "I"
        if e != "D":
            lines.append(f"{role if e == 'K' else 'user' if (len(lines) - system) % 2 == 0 else 'assistant'}:{text}")
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, letters.count("b"), letters.count("d"), sum(map(letters.count, "SUAX")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_matrices_of_compressed_sequences_against_all_scripts():
    rng = random.Random(1)
    for _ in range(600):
        s = "".join(rng.choice("suaxSUAXbd"[: rng.choice([4, 8, 10])]) for _ in range(rng.randint(1, 9)))
        rounds, first = [], len(LETTERS)
        for _ in range(3):
            now = Grammar(rounds).symbols(s)
            rules = next_rules(dict.fromkeys(zip(now, now[1:]), 2), first, 8)
            rounds, first = [*rounds, rules], first + len(rules)
        m, best = Grammar(rounds).whole(s), None
        for q in range(4):
            if m[q]:
                best = better(best, (m[q][0] + 3 * len(TAIL[q]), joined(m[q][1], TAIL[q])))
        assert (best[0], "".join(pieces(best[1]))) == cheapest(s)


def test_ropes_compare_like_strings():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("DI") for _ in range(rng.randint(0, 700))) for _ in range(2))
        if rng.random() < 0.6:
            b = a[: rng.randint(0, len(a))] + b[:5]
        ropes = []
        for s in (a, b):
            rope = ""
            while s:
                n = rng.randint(1, 300)
                rope, s = joined(rope, s[:n]), s[n:]
            ropes.append(rope)
        assert ["".join(pieces(r)) for r in ropes] == [a, b] and before(*ropes) == (a < b)


def test_rules_never_overlap_and_expand_to_the_sequence(spark):
    texts = ["ua" * 50, "suauaua", "uuuuu", "uau" * 7, "b"]
    g = learn(spark.createDataFrame([(t, 3) for t in texts], "letters string, n bigint"), rounds=4)
    assert g.parts

    def expand(n):
        return LETTERS[n] if n < len(LETTERS) else "".join(map(expand, g.parts[n]))

    for t in texts:
        assert "".join(map(expand, g.symbols(t))) == t
    assert len(g.symbols(texts[0])) < 10
    for rules in g.rounds:
        mixed = [p for p in rules if p[0] != p[1]]
        assert not {a for a, _ in mixed} & {b for _, b in mixed}


ROLES = ["user", "assistant", "system", "tool", "", None]
TEXTS = ["Good.", "Why?", "cut off", " \t\x0b", "", None, "Ends. ", "x!\n", "ok. ", "é…"]


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        turn = 0
        for _ in range(rng.randint(0, 9)):
            turn += rng.choice([1, 1, 1, 2, 5])
            rows.append((c if c else None, turn, rng.choice(ROLES), rng.choice(TEXTS)))
    rows += [(100, None, "user", "Null turn?"), (100, 3, "assistant", "Yes."), (101, None, "system", "Only."), (102, 1, "user", "Hm."), (102, 1, "user", "Hm.")]
    rows += [(200, t, ["user", "assistant"][t % 2], f"{t} word.") for t in range(9000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("text", "text").selectExpr("*", "1 AS c", "2 AS letters", "'x' AS digest").repartition(5)


def by_conversation(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return out


def test_report_against_brute_force(spark, talks):
    rows, df = talks
    want = {c: brute(r) for c, r in by_conversation([r for r in rows if r[0] != 200]).items()}
    got = {r[0]: tuple(r[1:]) for r in repair_report(df).collect()}
    long = got.pop(200)
    assert got == want
    assert long[:6] == (0, 0, 0, 0, 0, 0) and long[6] == "K" * 9000  # crosses chunks and partitions


def test_long_conversation_crosses_chunks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"{t}.", f"{t}.", f"{t}", " "])) for t in range(9500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    r = repair_report(df).first()
    # the same by a plain forward pass over states
    states = {START: (0, "")}
    edits = repaired_messages(df).orderBy("step").collect()
    assert "".join(e["edit"] for e in edits) == r["audit"]
    kept = [e for e in edits if e["edit"] != "D"]
    assert re.fullmatch("s?(ua)+", "".join(e["role"][0] for e in kept))
    assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in kept).encode()).hexdigest() == r["repaired_sha256"]
    seen = set()
    for _, role, text in [x[1:] for x in rows]:
        t = text.strip(BLANKS)
        who = role[0] if role[0] in "sua" else "x"
        letter = "b" if not t else who if t[-1] in ".!?" else who.upper()
        seen.add((role, text))
        new = {}
        g = Grammar()
        for p, (cost, audit) in states.items():
            for q in range(4):
                e = g.matrix(LETTERS.index(letter))[4 * p + q]
                if e:
                    x = (cost + e[0], audit + e[1])
                    new[q] = min(new.get(q, x), x)
        states = new
    best = min((c + 3 * len(TAIL[q]), a + TAIL[q]) for q, (c, a) in states.items())
    assert (r["cost"], r["audit"]) == best


def test_dropped_conversations_and_empty_tables(spark, talks):
    rows, df = talks
    none = repair_report(df.where("false"), known=df.where("conv_id = 102")).collect()
    assert [tuple(r) for r in none] == [(102, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair_report(df.where("false")).count() == 0 and repaired_messages(df.where("false")).count() == 0


def test_damage(spark, talks):
    import zlib

    rows, df = talks
    want = Counter()
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want[c, t, "user" if k == 4 else r, x] += {0: 0, 3: 2}.get(k, 1)
    assert Counter(tuple(r) for r in damaged(df).collect()) == +want

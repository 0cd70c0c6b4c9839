"""Side-by-side run of a registered query and its SQL; also a command line tool.

python -m tests.compare <sf_dir> [key prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def kind(t: str) -> str:
    t = t.lower()
    for group, names in {
        "int64": ("bigint", "hugeint"), "int32": ("integer", "int"), "int16": ("smallint",), "float64": ("double",), "text": ("varchar", "string"), "bool": ("boolean",),
        "date": ("date",), "ts": ("timestamp", "timestamp_ntz"),
    }.items():
        if t in names:
            return group
    return t


def compare(spark, con, fn, sql: str, sf_dir: str) -> list[str]:
    """Problems found; empty when rows, types and values agree."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    types = {c: kind(t) for c, t in df.dtypes}
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    dtypes = {d[0]: kind(str(d[1])) for d in cur.description}
    expected = cur.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for c in names:
        if types[c] != dtypes[c]:
            problems.append(f"type of {c}: spark {types[c]} sql {dtypes[c]}")
    order = sorted(names)
    si, di = [df.columns.index(c) for c in order], [names.index(c) for c in order]
    a = sorted(tuple(canon(r[i]) for i in si) for r in rows)
    b = sorted(tuple(canon(r[i]) for i in di) for r in expected)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        problems.append(f"values differ: {order}\n   only spark {sorted(sa - sb)[:3]}\n   only sql   {sorted(sb - sa)[:3]}")
    if not a:
        problems.append("no rows")
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from sitewright.session import local_session

    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con = local_session(), connect(sf)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            if name in sql:
                problems = compare(spark, con, fn, sql[name], sf)
                note = ""
            else:
                n = len(fn(spark, sf).collect())
                problems, note = ([] if n else ["no rows"]), f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001 - report and go on
            problems, note = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - t:.1f}s{note}", *problems, sep="\n   " if problems else " ", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()

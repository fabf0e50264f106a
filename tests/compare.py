"""Run registered queries and their SQL side by side.  Usage: compare.py sf_dir [name ...]"""

import sys
import time

import duckdb

from tests.session import make_session
from tidemark.plans import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        if value != value:
            return "NULL"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir, name):
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in ORACLES:
        return f"rows-only {len(got)}", t1 - t0, 0.0, True
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", t1 - t0, t2 - t1, False
    if got == want:
        return f"ok {len(got)}", t1 - t0, t2 - t1, True
    only_got = sorted(set(got) - set(want))[:3]
    only_want = sorted(set(want) - set(got))[:3]
    return f"DIFF {len(got)} vs {len(want)}\n   spark {only_got}\n   duck  {only_want}", t1 - t0, t2 - t1, False


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), duck(sf_dir)
    chosen = [n for n in QUERIES if not names or any(n.startswith(p) for p in names)]
    for name in chosen:
        try:
            text, s, d, _ = check(spark, con, sf_dir, name)
            print(f"{name}: {text} spark={s:.1f}s duck={d:.1f}s", flush=True)
        except Exception as error:  # report and go on
            print(f"{name}: ERROR {type(error).__name__} {str(error)[:1200]}", flush=True)


if __name__ == "__main__":
    main()

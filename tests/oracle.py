"""Runs a query and its SQL twin side by side and compares their rows whatever their order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    return x


def differences(spark, sf_dir: str, query, sql: str) -> list[str]:
    got = query(spark, sf_dir)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got.columns) != sorted(names):
        return [f"columns {sorted(got.columns)} against {sorted(names)}"]
    order = sorted(names)
    a = sorted(repr(_plain([r[c] for c in order])) for r in got.collect())
    b = sorted(repr(_plain([r[names.index(c)] for c in order])) for r in want)
    if a == b:
        return []
    only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return [f"{len(a)} rows against {len(b)}", f"spark only: {only_a}"[:700], f"sql only: {only_b}"[:700]]

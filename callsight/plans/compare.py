"""Order-insensitive comparison of a Spark result with a DuckDB oracle result."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict(recursive=True))
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def _key(r):
    return tuple((x is None, str(type(x)), str(x)) for x in r)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql: str | None) -> tuple[bool, str]:
    """(matches, message). Without SQL only the Spark side runs (rows-only check)."""
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    if sql is None:
        return True, f"{len(rows)} rows (no oracle)"
    rel = con.execute(sql)
    ocols = [d[0] for d in rel.description]
    if sorted(ocols) != cols:
        return False, f"columns spark={cols} oracle={sorted(ocols)}"
    idx = [ocols.index(c) for c in cols]
    orows = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=_key)
    if rows == orows:
        return True, f"{len(rows)} rows"
    s, o = set(rows), set(orows)
    return False, f"spark {len(rows)} rows, oracle {len(orows)}; spark-only {list(s - o)[:2]} oracle-only {list(o - s)[:2]}"

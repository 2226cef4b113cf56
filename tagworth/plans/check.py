"""Compare registered queries with their checking statements in an embedded engine.

    python -m tagworth.plans.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time

from .fixtures import TABLES


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    if mine == theirs:
        return "" if mine else "no rows"
    only_mine = sorted(set(mine) - set(theirs))[:3]
    only_theirs = sorted(set(theirs) - set(mine))[:3]
    return f"rows {len(mine)} vs {len(theirs)}\n  {names}\n  spark {only_mine}\n  sql   {only_theirs}"


def main(argv: list[str]) -> int:
    import duckdb

    from ..session import local_session
    from . import ORACLES, QUERIES

    sf_dir, wanted = argv[0], argv[1:]
    spark = local_session()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                note = compare(spark, con, fn, ORACLES[name], sf_dir)
            else:
                note = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:900]}"
        failed = bool(note) and not note.startswith("rows only")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Run a registered query and its SQL side by side and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)):
        return ("n", float(v))
    if hasattr(v, "isoformat"):
        return ("t", v.isoformat()[:26])
    if isinstance(v, (list, tuple)):
        return ("l", tuple(plain(x) for x in v))
    if hasattr(v, "as_tuple"):
        return ("n", float(v))
    return ("s", str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, build, sql, folder):
    """(ok, message, seconds)"""
    start = time.time()
    df = build(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if not sql:
        return len(got) > 0, f"rows={len(got)}", took
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", took
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sql_kinds = {d[0]: str(d[1]) for d in res.description}
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        odd = [f"{c}:{kinds[c]}/{sql_kinds[c]}" for c in kinds if (kinds[c] in ("double", "float")) != (sql_kinds[c] in ("DOUBLE", "FLOAT"))
               or (kinds[c] == "bigint") != (sql_kinds[c] == "BIGINT")]
        return True, f"rows={len(a)}" + (f" TYPES {odd}" if odd else ""), took
    order = sorted(names)
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"rows {len(a)} vs {len(b)}; {order}\n   " + "\n   ".join(f"{x}\n   {y}" for x, y in diff), took


def main():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tests.conftest import make_session
    folder = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    wanted = sys.argv[2:]
    spark, con = make_session(), connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, message, took = compare(spark, con, name, build, sqls.get(name), folder)
        except Exception as e:
            ok, message, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {took:6.1f}s {'' if sqls.get(name) else '(no sql) '}{message}", flush=True)
    print("failed:", bad, "of", len(queries))


if __name__ == "__main__":
    main()

"""Run registered queries on Spark and their oracle text on DuckDB and compare all rows."""
from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def duck(sf_dir: str):
    import duckdb

    from pagegrid.plans.tables import BASE

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (int, float)):
        return "nan" if v != v else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v)


_KIND = {"int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "integer": "int", "string": "text", "varchar": "text",
         "double": "real", "float": "real", "timestamp": "time", "timestamp_ntz": "time", "date": "date", "boolean": "bool"}


def compare(df, con, sql: str) -> list[str]:
    problems = []
    cols = sorted(df.columns)
    spark_rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    if sorted(names) != cols:
        return [f"columns differ: spark {cols} oracle {sorted(names)}"]
    for f in df.schema.fields:
        a, b = f.dataType.simpleString(), types[f.name]
        if a in ("int", "bigint", "double") and b in ("integer", "bigint", "double", "hugeint") and a.replace("int", "integer").replace("biginteger", "bigint") != b:
            problems.append(f"type {f.name}: spark {a} oracle {b}")
        elif _KIND.get(a, a) != _KIND.get(b, b) and not a.startswith("array"):
            problems.append(f"type {f.name}: spark {a} oracle {b}")
    idx = [names.index(c) for c in cols]
    duck_rows = [tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()]
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows: spark {len(spark_rows)} oracle {len(duck_rows)}")
    key = lambda r: tuple(str(x) for x in r)
    a, b = sorted(spark_rows, key=key), sorted(duck_rows, key=key)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        problems.append(f"values differ {cols}\n   spark:  {str(only_a)[:900]}\n   oracle: {str(only_b)[:900]}")
    if not spark_rows:
        problems.append("note: no rows")
    return problems


def main(argv: list[str]) -> int:
    from pagegrid.plans import registry
    from pagegrid.session import build_session

    sf = argv[0] if argv else "sf0.001"
    wanted = argv[1:]
    spark = build_session("oracle", "local[8]", 8)
    con = duck(f"{DATA}/{sf}")
    oracles = registry.oracle_sql()
    bad = 0
    for name, fn in registry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, f"{DATA}/{sf}")
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problems = [] if n else ["note: no rows"]
                name = f"{name} (rows only: {n})"
        except Exception as e:  # report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        took = time.time() - t
        if problems:
            bad += 1
            print(f"BAD {name} {took:.1f}s")
            for p in problems:
                print("   ", p)
        else:
            print(f"ok  {name} {took:.1f}s")
        sys.stdout.flush()
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

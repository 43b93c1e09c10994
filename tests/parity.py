"""Compare registered queries with their SQL in DuckDB: python tests/parity.py [sf] [name ...]."""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return f"dec:{v}"
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def kinds(values):
    return {type(v).__name__ for v in values if v is not None}


def compare(spark_df, con, sql):
    """None when equal, else a short account of the difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    mine = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    order_a = [spark_df.columns.index(c) for c in sorted(names)]
    order_b = [names.index(c) for c in sorted(names)]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} against {len(theirs)}"
    a = sorted(tuple(cell(r[i]) for i in order_a) for r in mine)
    b = sorted(tuple(cell(r[i]) for i in order_b) for r in theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(names)}:\n    {bad[0][0]}\n    {bad[0][1]}"
    for c, i, j in zip(sorted(names), order_a, order_b):
        ka, kb = kinds(r[i] for r in mine), kinds(r[j] for r in theirs)
        if ka != kb:
            return f"types of {c}: {ka} against {kb}"
    return None


WIDTHS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


def widths(spark_df, con, sql):
    """Columns whose declared types differ."""
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    mine = {f.name: WIDTHS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    return {c: (mine[c], theirs[c]) for c in mine if mine[c] != theirs.get(c)}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    from tabloom.plans import ORACLES, QUERIES
    from tabloom.session import local_session

    wanted = sys.argv[2:]
    names = [n for n in QUERIES if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, folder)
            if n in ORACLES:
                t1 = time.time()
                said = compare(df, con, ORACLES[n])
                state = "ok" if said is None else "DIFF " + said
                if not mine_rows(df):
                    state += " (no rows)"
                del t1
            else:
                state = f"rows {df.count()}"
                if state == "rows 0":
                    state = "DIFF no rows"
        except Exception as e:  # noqa: BLE001
            state = "FAIL " + str(e).strip().split("JVM stacktrace")[0][:900]
        if not state.startswith(("ok", "rows")):
            failed.append(n)
        print(f"{n:28s} {time.time() - t:6.2f}s  {state}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} good; not good: {failed}")


def mine_rows(df):
    return bool(df.limit(1).count())


if __name__ == "__main__":
    main()

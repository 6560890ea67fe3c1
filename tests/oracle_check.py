"""Run registered queries on Spark and their SQL twins on DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
Prints one line per query and a summary; exit status 1 on any mismatch.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


EXACT = False


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "isoformat") and not isinstance(v, str):
        return v.isoformat()
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    if hasattr(v, "__float__") and not isinstance(v, (int, bool)):
        return round(float(v), 4)
    return v


def rows_key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def close(a, b):
    if len(a) != len(b):
        return False
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, float) and isinstance(y, float) and not EXACT:
                if not math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-4):
                    return False
            elif x != y:
                return False
    return True


def main():
    global EXACT
    args = [a for a in sys.argv[1:] if a != "--exact"]
    EXACT = "--exact" in sys.argv
    sf = args[0] if args else "/root/testdata/sf0.01"
    prefixes = args[1:]
    import __spark_entry__ as E
    import os as _os
    if _os.environ.get("QUARRY_PLAIN_SESSION"):
        # a session as the driver builds it (no helper defaults)
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
    else:
        from quarry.session import get_session
        spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad, total = [], 0
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        total += 1
        t0 = time.time()
        try:
            df = fn(spark, sf)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:300]}")
            bad.append(name)
            continue
        ts = time.time() - t0
        sql = sqls.get(name)
        if sql is None:
            print(f"rows-only {name}: {len(srows)} rows {ts:.1f}s")
            continue
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(e)[:300]}")
            bad.append(name)
            continue
        stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        dtypes = {d[0]: str(d[1]) for d in cur.description}
        tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT",
                "tinyint": "TINYINT", "timestamp": "TIMESTAMP WITH TIME ZONE"}
        tdiff = [(c, stypes.get(c), dtypes.get(c)) for c in dcols
                 if c in stypes and tmap.get(stypes[c], stypes[c]) != dtypes[c].upper()
                 and not (stypes[c].startswith("array") or stypes[c].startswith("struct"))]
        if tdiff:
            print(f"  type-diff {name}: {tdiff}")
        if sorted(scols) != sorted(dcols):
            print(f"MISMATCH-COLS {name}: spark={scols} duck={dcols}")
            bad.append(name)
            continue
        a, b = rows_key(srows, scols), rows_key(drows, dcols)
        if len(a) != len(b) or not close(a, b):
            print(f"MISMATCH {name}: spark {len(a)} rows, duck {len(b)} rows")
            for x, y in list(zip(a, b))[:3]:
                if x != y:
                    print("   spark:", str(x)[:300])
                    print("   duck :", str(y)[:300])
            bad.append(name)
            continue
        print(f"ok {name}: {len(srows)} rows {ts:.1f}s")
    print(f"SUMMARY {total - len(bad)}/{total} ok; bad={bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

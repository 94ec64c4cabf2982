"""Side-by-side check of registered queries against their SQL, used by the test-suite and from the command line."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def type_family(name: str) -> str:
    name = name.lower()
    for family, members in {
        "int": ("int", "integer"), "long": ("bigint", "long"), "double": ("double",), "string": ("string", "varchar"),
        "bool": ("boolean",), "ts": ("timestamp", "timestamp_ntz"),
    }.items():
        if name in members:
            return family
    return name


def compare(spark, con, build, sql: str, sf_dir: str) -> str | None:
    df = build(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns differ: {sorted(set(got_cols) ^ set(want_cols))}"
    got_types = dict(df.dtypes)
    odd = [(c, got_types[c], want_types[c]) for c in got_cols
           if type_family(got_types[c]) != type_family(want_types[c]) and got_types[c] not in want_types[c].lower()]
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; only spark {[x for x in a if x not in b][:2]}; only sql {[x for x in b if x not in a][:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(got_cols)}: {bad[0]}"
    if odd:
        return f"types differ: {odd}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from reprise.session import build_session

    sf = argv[0] if argv else "0.001"
    wanted = argv[1:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, build, oracle[name], sf_dir)
                n = con.execute(f"select count(*) from ({oracle[name].rstrip().rstrip(';')})").fetchall()[0][0]
            else:
                n, problem = build(spark, sf_dir).count(), None
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} rows={n:<7} {time.time() - t:5.1f}s"
              f"{'' if name in oracle else ' (no sql)'} {problem or ''}", flush=True)
    print("failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

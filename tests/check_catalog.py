"""Run catalog queries at a scale and report timings and differences from SQL.

    python tests/check_catalog.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from acequia.session import build_session  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="20g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__execution__arrow__pyspark__enabled="true",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            pdf = queries[name](spark, sf_dir).toPandas()
        except Exception as problem:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(problem)[:1500]}", flush=True)
            continue
        took = time.time() - began
        if name not in oracles:
            print(f"rows {name}: {len(pdf)} rows, {took:.1f}s", flush=True)
            continue
        began = time.time()
        try:
            found = differences(pdf, con.execute(oracles[name]).df())
        except Exception as problem:  # noqa: BLE001
            found = [str(problem)[:800]]
        bad += bool(found)
        print(
            f"{'DIFF' if found else 'same'} {name}: {len(pdf)} rows, {took:.1f}s, "
            f"sql {time.time() - began:.1f}s {found}",
            flush=True,
        )
    print("problems:", bad)


if __name__ == "__main__":
    main()

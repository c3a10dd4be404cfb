"""Run registered queries next to their SQL: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from checks import all_oracles, all_queries
from tidemark.session import local_session


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, folder: str, name: str, query, sql: str | None) -> str:
    started = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = f"{time.time() - started:6.2f}s {len(rows):7d} rows"
    if sql is None:
        return f"rows only      {took}"
    with duckdb.connect() as base:
        base.execute("SET TimeZone='UTC'")
        for path in Path(folder).glob("*.parquet"):
            base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        answer = base.execute(sql)
        columns = [d[0] for d in answer.description]
        kinds = {d[0]: str(d[1]) for d in answer.description}
        expected = answer.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS DIFFER {sorted(df.columns)} / {sorted(columns)}"
    if len(rows) != len(expected):
        return f"ROWS DIFFER    {len(rows)} / {len(expected)}"
    left, right = _sorted_rows(rows, df.columns), _sorted_rows(expected, columns)
    exact = sum(a == b for a, b in zip(left, right))
    close = sum(all(_same(x, y) for x, y in zip(a, b)) for a, b in zip(left, right))
    if exact == len(rows):
        return f"ok             {took}"
    if close == len(rows):
        return f"ok but rounded {took} ({len(rows) - exact} rows)"
    bad = next((a, b) for a, b in zip(left, right) if not all(_same(x, y) for x, y in zip(a, b)))
    return f"VALUES DIFFER  {len(rows) - close} of {len(rows)}: {str(bad)[:900]} {kinds} {df.dtypes}"


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    chosen = arguments[1:]
    spark = local_session()
    oracles, failed = all_oracles(), 0
    for name, query in all_queries().items():
        if chosen and name not in chosen:
            continue
        try:
            verdict = compare(spark, folder, name, query, oracles.get(name))
        except Exception as error:
            verdict = f"FAILED {type(error).__name__}: {str(error)[:1200]}"
        failed += not verdict.startswith(("ok", "rows only"))
        print(f"{name:24s} {verdict}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

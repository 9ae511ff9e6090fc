"""Run registered queries against their SQL twins: python tests/run_oracle.py [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quire.session import build_session  # noqa: E402
from tests.oracle_check import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                res = compare(df, con, sqls[name])
            else:
                res = {"rows": (df.count(), None), "ok": True, "rows_only": True}
        except Exception as exc:  # noqa: BLE001
            res = {"ok": False, "error": repr(exc)[:800]}
        bad += not res["ok"]
        print(f"{name:24s} {'OK ' if res['ok'] else 'BAD'} {time.time() - t0:6.1f}s {res}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())

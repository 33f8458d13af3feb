"""Run registered queries against their SQL: ``python tests/check_all.py <sf dir> [key ...]``."""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from gridcast import local_session  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402


def main(sf: str, keys: list[str]) -> int:
    spark, con = local_session(8), connect(sf)
    oracles, failed = oracle_sql(), 0
    for key, f in queries().items():
        if keys and key not in keys:
            continue
        t = time.time()
        try:
            df = f(spark, sf)
            if key in oracles:
                diff = differences(df, con, oracles[key])
                n = ""
            else:
                n = f"rows {df.count()}"
                diff = []
        except Exception as e:  # noqa: BLE001
            diff, n = [f"{type(e).__name__}: {str(e)[:600]}"], ""
            if keys:
                traceback.print_exc()
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {key} {time.time() - t:.1f}s {n}{' '.join(diff)[:1500]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)

"""python tests/check_all.py [sf] [name prefix ...]: compare every query with its SQL."""

from __future__ import annotations

import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
sys.path.insert(0, str(Path(__file__).parent))

from harness import compare, duck  # noqa: E402

import __spark_entry__ as e  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = duck(folder), e.oracle_sql(), []
    for name, query in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message, took = compare(spark, con, name, query, sqls.get(name), folder)
        except Exception as error:
            ok, took = False, 0.0
            message = str(error).strip().split("JVM stacktrace")[0][:300] + "\n" + "".join(traceback.format_tb(error.__traceback__)[-1:])[-200:]
        print("ok  " if ok else "FAIL", name, f"{took:.1f}s", message[:1500], flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())

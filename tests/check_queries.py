"""Command line check: python -m tests.check_queries [sf] [name part ...]"""

from __future__ import annotations

import signal
import sys
import time

from quadrat.session import build_session
from quadrat_queries import load_all
from quadrat_queries.registry import ORACLES, QUERIES
from tests.compare import connect, mismatch


def _late(*_: object) -> None:
    raise TimeoutError("query took more than 90 seconds")


def main() -> int:
    signal.signal(signal.SIGALRM, _late)
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    load_all()
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        signal.alarm(60)
        try:
            if name in ORACLES:
                note = mismatch(spark, fn, ORACLES[name], sf_dir, con)
            else:
                n = fn(spark, sf_dir).count()
                note = None if n else "no rows"
        except Exception as error:  # report and go on with the next query
            note = f"{type(error).__name__}: {str(error)[:1500]}"
        finally:
            signal.alarm(0)
        bad += note is not None
        mark = "ok  " if note is None else "FAIL"
        print(f"{mark} {time.time() - start:6.2f}s {name}{'' if name in ORACLES else ' (rows only)'}{': ' + note if note else ''}", flush=True)
    print(f"{bad} failing of {len(QUERIES)}")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())

"""Compare queries with their check SQL from the command line.

python tests/run_queries.py SF_DIR [name-prefix ...]
"""

import sys
import tempfile
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, mismatch  # noqa: E402

from pulsegrid.session import build_session  # noqa: E402


def main(sf_dir: str, prefixes: list[str]) -> int:
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"), "spark.driver.memory": "8g"}
    extra = [p for p in prefixes if "=" in p]
    conf.update(dict(p.split("=", 1) for p in extra))
    prefixes = [p for p in prefixes if "=" not in p]
    spark = build_session("local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = mismatch(df, con, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem[:700]}"
            else:
                problem, n = None, len(df.collect())
                state = f"rows {n}"
        except Exception as e:
            problem = state = f"ERROR {type(e).__name__} {str(e)[:900]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name:32s} {state}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], [a for a in sys.argv[2:] if a != "-v"]) else 0)

"""Compare chosen queries with their SQL: python tests/try_queries.py sf0.01 [name ...]"""

import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from oracle import duck, mismatch  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from waymeter import build_session  # noqa: E402


def main() -> None:
    folder = f"/root/testdata/{sys.argv[1]}"
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = entry.oracle_sql(), 0
    names = [n for n in entry.queries() if not sys.argv[2:] or any(n.startswith(a) for a in sys.argv[2:])]
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            if name in sqls:
                kinds = dict(df.dtypes)
                wrong = mismatch(df, folder, sqls[name])
                cols, _, types = duck(folder, sqls[name])
                odd = [f"{c}:{kinds.get(c)}/{t}" for c, t in zip(cols, types) if t in ("HUGEINT",) or "DECIMAL" in t]
                wrong = wrong or (f"types {odd}" if odd else None)
            else:
                wrong = None if df.count() >= 0 else "?"
            print(f"{'ok ' if not wrong else 'BAD'} {name} {time.time() - start:.1f}s {wrong or ''}"[:900], flush=True)
            bad += bool(wrong)
        except Exception as e:
            bad += 1
            print(f"ERR {name} {str(e)[:700]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()

"""Print the formatted physical plan of registered queries.

    python scripts/explain.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ticketscope.plans.registry import all_queries  # noqa: E402
from ticketscope.session import get_spark  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_spark()
    qs = all_queries()
    for name in args:
        print(f"===== {name}")
        qs[name].spark(spark, sf).explain("formatted")


if __name__ == "__main__":
    main()

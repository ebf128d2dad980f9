"""Commands: what is registered, one query to a table, its plan, or several queries one after the other.

    python -m strataloom list [ROW]              names and inventory rows, or those of one row
    python -m strataloom run NAME DATA OUT       a query's rows as Parquet
    python -m strataloom explain NAME DATA       its plan
    python -m strataloom build DATA OUT NAME...  queries in order, each to OUT/NAME; stops at the first that fails

The session is the one that spark-submit sets up, or a local one.  The exit code
is 0, 1 for a query that failed, and 2 for a command that is not known.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from strataloom.plans import registry
from strataloom.session import local_session


def main(args: list[str], session=lambda: SparkSession.getActiveSession() or local_session()) -> int:
    command, *rest = args or ["help"]
    found = registry.found()
    unknown = [n for n in (rest[:1] if command in ("run", "explain") else rest[2:] if command == "build" else []) if n not in found]
    if unknown:
        print(f"not registered: {', '.join(unknown)}", file=sys.stderr)
        return 2
    if command == "list" and len(rest) < 2:
        for name, q in sorted(found.items()):
            if not rest or rest[0] in q.rows:
                print(f"{name}\t{' '.join(q.rows)}\t{'sql' if q.sql else '-'}")
        return 0
    if command == "explain" and len(rest) == 2:
        found[rest[0]].run(session(), rest[1]).explain("formatted")
        return 0
    if command == "run" and len(rest) == 3:
        return built(session(), rest[1], {rest[0]: rest[2]})
    if command == "build" and len(rest) > 2:
        return built(session(), rest[0], {name: f"{rest[1].rstrip('/')}/{name}" for name in rest[2:]})
    print(__doc__, file=sys.stderr)
    return 2


def built(spark: SparkSession, data: str, outputs: dict[str, str]) -> int:
    for name, path in outputs.items():
        try:
            registry.found()[name].run(spark, data).write.mode("overwrite").parquet(path)
        except Exception as e:  # what failed is said, and nothing after it runs
            print(f"{name}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
            return 1
        print(f"{name} -> {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

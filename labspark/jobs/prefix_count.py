"""Count the values of a key-value table by prefix and reload the result table.

    spark-submit labspark/jobs/prefix_count.py --read format=parquet path=/data/keyvalue \\
        --write format=parquet path=/data/keyvalue_prefix_count

Any connector on the class path will do; what is not ``format`` or ``path`` is handed to it as an option, such as
``keyspace=ks table=keyvalue``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labspark.operators.prefix import prefix_frequency
from labspark.session import session
from labspark.sources.tables import reload, scan


def _options(pairs: list[str]) -> dict[str, str]:
    bad = [p for p in pairs if "=" not in p]
    if bad:
        raise SystemExit(f"expected name=value: {', '.join(bad)}")
    return dict(p.split("=", 1) for p in pairs)


def run(spark: SparkSession, read: dict[str, str], write: dict[str, str], value: str = "value", length: int = 3) -> int:
    """Reload the result table and return how many prefixes it holds, counted on the stored rows."""
    source, target = dict(read), dict(write)
    rows = scan(spark, source.pop("format", "parquet"), source.pop("path", None), **source)
    stored = reload(
        prefix_frequency(rows, value, length), target.pop("path", None), target.pop("format", "parquet"), **target
    )
    return stored.agg(F.count(F.lit(1))).first()[0]


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--read", nargs="+", required=True, metavar="NAME=VALUE")
    parser.add_argument("--write", nargs="+", required=True, metavar="NAME=VALUE")
    parser.add_argument("--value", default="value")
    parser.add_argument("--length", type=int, default=3)
    given = parser.parse_args(arguments)
    spark = session("prefix-count")
    found = run(spark, _options(given.read), _options(given.write), given.value, given.length)
    print(f"Processed {found} unique prefixes")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

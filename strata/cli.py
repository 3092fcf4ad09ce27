"""python -m strata.cli: one store from the command line.

Actions run in the order put, delete, get, compact, whatever the order of the options.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .plans.store import Store

SCHEMA = "key binary, value binary"


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strata", description=__doc__.splitlines()[0])
    parser.add_argument("-data-dir", default="./data", help="folder of the store")
    parser.add_argument("-put-key", default="")
    parser.add_argument("-put-value", default="")
    parser.add_argument("-get-key", default="")
    parser.add_argument("-del-key", default="")
    parser.add_argument("-compact", action="store_true")
    a = parser.parse_args(args)
    own = spark is None
    spark = spark or SparkSession.builder.appName("strata").config("spark.ui.enabled", "false").getOrCreate()
    path = a.data_dir if ":" in a.data_dir else "file://" + os.path.abspath(a.data_dir)
    store = None
    try:
        store = Store.open(spark, path)
        if a.put_key:
            store.put(spark.createDataFrame([(a.put_key.encode(), a.put_value.encode())], SCHEMA))
            print("put ok")
        if a.del_key:
            store.delete(spark.createDataFrame([(a.del_key.encode(),)], "key binary"))
            print("delete ok")
        if a.get_key:
            value, found = store.get(a.get_key.encode())
            print(f"{a.get_key} => {(value or b'').decode(errors='replace')}" if found else "not found")
        if a.compact:
            store.compact()
            print("compaction ok")
        return 0
    except Exception as e:
        print(f"strata: {e}", file=sys.stderr)
        return 1
    finally:
        if store is not None:
            store.close()
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())

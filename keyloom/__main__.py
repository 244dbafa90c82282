"""python -m keyloom info URL: what a store holds. python -m keyloom shell URL: a Python prompt with it as `store`."""

import code
import sys

from pyspark.sql import SparkSession

from .sources.store import open_store

if __name__ == "__main__":
    if len(sys.argv) != 3 or sys.argv[1] not in ("info", "shell"):
        sys.exit(__doc__)
    spark = SparkSession.builder.getOrCreate()
    store = open_store(spark, sys.argv[2])
    if sys.argv[1] == "info":
        store.info().show(1000, truncate=False)
    else:
        code.interact(local={"spark": spark, "store": store})

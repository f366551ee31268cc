"""python -m querymill CATALOG TABLE (read | aggregate | import) FILE: a JSON request, or NDJSON to import; - is standard input."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from querymill.operators import buckets, reads
from querymill.operators.catalog import Catalog
from querymill.sources import ndjson


def main() -> None:
    p = argparse.ArgumentParser(prog="querymill", description=__doc__)
    p.add_argument("catalog")
    p.add_argument("table")
    p.add_argument("action", choices=["read", "aggregate", "import"])
    p.add_argument("file")
    p.add_argument("--on-error", choices=["abort", "skip"], default="abort")
    a = p.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = Catalog(spark, a.catalog)
    if a.action == "import":
        print(json.dumps({"lines": ndjson.import_file(catalog, a.table, a.file, a.on_error)}))
        return
    request = json.loads(sys.stdin.read() if a.file == "-" else open(a.file).read())
    if a.action == "read":
        for line in reads.read(catalog.table(a.table), request).toJSON().toLocalIterator():
            print(line)
    else:
        print(json.dumps(buckets.nested(catalog.table(a.table), request["aggregations"], request.get("filter")), default=str))


if __name__ == "__main__":
    main()

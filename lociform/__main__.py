"""``python -m lociform NAME key=value ... output=PATH [format=parquet]``; without a name, the verbs."""

from __future__ import annotations

import inspect
import sys

from pyspark.sql import SparkSession

from lociform.verbs import VERBS, run


def main(args: list[str]) -> int:
    if not args or args[0] not in VERBS:
        for name, f in sorted(VERBS.items()):
            print(name, *list(inspect.signature(f).parameters)[1:])
        return int(bool(args))
    options = dict(a.split("=", 1) for a in args[1:])
    output, kind = options.pop("output", None), options.pop("format", "parquet")
    spark = SparkSession.builder.appName(f"lociform {args[0]}").getOrCreate()
    df = run(spark, args[0], **options)
    if output is None:
        df.show(truncate=False)
    else:
        df.write.mode("overwrite").format(kind).save(output)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

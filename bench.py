"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the driver tables; BENCH_CPUS: local cores; BENCH_QUERIES: names,
comma-separated, instead of the headline ones."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from breakwater.plans import catalog  # noqa: E402
from breakwater.session import build_session, release  # noqa: E402

HEADLINE = (
    "class_summary",
    "sv_counts",
    "infer_direction",
    "match_cnv_sv",
    "filter_depth_outliers",
    "detect_translocation",
    "resolve_mixed_sv",
    "match_sv_pairs",
    "assign_to_clusters",
    "snv_from_mutect",
    "fit_ccf_clusters",
)
# Run once before the others, uncounted: the JVM starts and compiles in it.
WARM_UP = "snv_from_mutect"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    named = os.environ.get("BENCH_QUERIES")
    names = named.split(",") if named else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}
    build: dict[str, float] = {}
    catalog.QUERIES[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    release(spark)
    for name in names:
        start = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf_dir)
        build[name] = round(time.perf_counter() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, build[name], seconds[name], "tables", release(spark), file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "build": build,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()

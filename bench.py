"""Benchmark the headline queries.

Runs every query registered with ``headline=True`` on ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one
JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is executed in full (``noop`` sink: every row computed, nothing
collected to the driver); jobs a query needs while being built (split cut,
block sizing) are included in its time.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from casewise.session import get_spark
    scratch = tempfile.mkdtemp(prefix="casewise-bench-")
    spark = get_spark(f"local[{cpus}]", app_name="casewise-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g", "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                             "spark.local.dir": os.path.join(scratch, "local")})
    from casewise.plans.catalog import load_all
    specs = load_all()
    heads = [s for s in specs.values() if s.headline and (not only or s.name in only)]
    # Warm the JVM once (codegen, class loading) on the smallest query.
    specs["overview_counts"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for spec in heads:
        t0 = time.time()
        df = spec.build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[spec.name] = round(time.time() - t0, 3)
        print(f"# {spec.name}: {times[spec.name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

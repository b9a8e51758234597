"""Times the headline queries: python bench.py prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from tessera.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = (
    "tag_decision", "consensus_rank", "status_summary", "ocr_checkpoints", "output_names", "live_counters", "report_update", "qa_compare", "content_dedupe",
    "archive_cascade", "archive_renames", "manifest_verify", "latest_job_state", "crop_nms", "anchor_in_crop", "smart_route", "mask_stats", "ladder_pick", "correction_transition",
)


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{data}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(data).name}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries on one machine and prints one JSON line.

``BENCH_SF_DIR`` is the folder with the tables, ``BENCH_CPUS`` the number of threads.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from casetrail.plans.queries import QUERIES  # noqa: E402
from casetrail.session import build_session  # noqa: E402

HEADLINE = [
    "activity_frequency", "dfg", "transition_durations", "recording_errors", "variants", "dfg_fitness", "log_summary",
    "web_dfg", "generic_register", "case_counts", "field_service_register", "citation_gate", "grade_register",
    "event_normalise", "scrub_documents", "redaction_audit", "session_stats", "tool_topk", "fingerprint_dedup",
    "merge_turns", "source_stats", "contamination", "recurrence", "sql_audit", "tool_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="casetrail-bench-")})
    spark.sparkContext.setLogLevel("OFF")
    only = sys.argv[1:] or HEADLINE
    QUERIES["activity_frequency"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    seconds = {}
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

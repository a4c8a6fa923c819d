"""What each query shuffles, at two scales, with broadcast joins off as on large tables.

Prints one row per query: records and kilobytes written to shuffles for each
folder, and for the second the worst imbalance: over the stages that read at
least 10,000 shuffle records, the most read by one task over the mean per task.
A hot key shows there.  Read from the event log.

    python tools/shuffle_report.py [small folder] [large folder] [query ...]
"""

from __future__ import annotations

import json
import sys
import tempfile
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spanledger.registry import OPERATORS, query  # noqa: E402
from spanledger.session import session  # noqa: E402


def run(folders: list[str], names: list[str], log_dir: str) -> None:
    settings = {
        "spark.master": "local[8]",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": log_dir,
        "spark.eventLog.rolling.enabled": "false",
        "spark.eventLog.compress": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    spark = session("shuffle-report", 8, **settings)
    spark.sparkContext.setLogLevel("ERROR")
    for folder in folders:
        for name in names:
            spark.sparkContext.setJobDescription(f"{name}|{folder}")
            query(name)(spark, folder).write.format("noop").mode("overwrite").save()
    spark.stop()


def collect(log_dir: str) -> dict[str, dict[str, float]]:
    stage_of: dict[int, str] = {}
    totals: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(int))
    reads: dict[int, list[int]] = defaultdict(list)
    for log in Path(log_dir).iterdir():
        for line in log.open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerJobStart":
                label = event.get("Properties", {}).get("spark.job.description", "")
                for stage in event["Stage IDs"]:
                    stage_of.setdefault(stage, label)
            elif event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                total = totals[stage_of.get(event["Stage ID"], "")]
                written = event["Task Metrics"]["Shuffle Write Metrics"]
                read = event["Task Metrics"]["Shuffle Read Metrics"]
                total["records"] += written["Shuffle Records Written"]
                total["bytes"] += written["Shuffle Bytes Written"]
                reads[event["Stage ID"]].append(read["Total Records Read"])
    for stage, records in reads.items():
        if sum(records) >= 10_000:
            total = totals[stage_of.get(stage, "")]
            total["imbalance"] = max(total["imbalance"], max(records) * len(records) / sum(records))
    return totals


def main() -> None:
    folders = sys.argv[1:3] or ["/root/testdata/sf0.01", "/root/testdata/sf0.1"]
    names = sys.argv[3:] or list(OPERATORS)
    with tempfile.TemporaryDirectory(prefix="shuffle-report-") as log_dir:
        run(folders, names, log_dir)
        totals = collect(log_dir)
    print("| query | records, first | KB | records, second | KB | imbalance, second |")
    print("|---|---:|---:|---:|---:|---:|")
    for name in names:
        small, large = (totals[f"{name}|{folder}"] for folder in folders)
        print(
            f"| {name} | {small['records']} | {small['bytes'] // 1024} | {large['records']} "
            f"| {large['bytes'] // 1024} | {large['imbalance']:.2f} |"
        )


if __name__ == "__main__":
    main()

"""Skew evidence: one agent holds a third of all calls; report per-task shuffle input.

Usage: python scripts/skew_check.py [sf_dir] [replicas]

F1 calls are replicated; a third of the replicas are re-assigned to the agent
'HOT'. The turns are parsed and written once, then each operator runs with
the ``noop`` sink. Spark's event log (written to a fresh scratch folder) is
read afterwards: for every stage, the largest per-task shuffle read (records)
is compared with the stage total. Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _event_files(log_dir: str) -> list[str]:
    """Event log files: plain files or Spark 4's rolling folders (``eventlog_v2_*/events_*``)."""
    out = []
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        name = os.path.basename(path)
        if os.path.isfile(path) and not name.startswith((".", "appstatus")):
            out.append(path)
    return sorted(out)


def _lines(path: str):
    """Lines of one event file, zstd-compressed or plain."""
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True), encoding="utf-8")
    else:
        with open(path) as fh:
            yield from fh


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    replicas = int(sys.argv[2]) if len(sys.argv) > 2 else 30
    log_dir = tempfile.mkdtemp(prefix="callsight-eventlog-")
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("callsight-skew")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep 32 reducers visible
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from callsight.operators import agents as A
    from callsight.operators import selection as S
    from callsight.operators import transcripts as P
    from callsight.plans import catalog as C
    from callsight.session import ensure_checkpoint_dir, scratch_path

    ensure_checkpoint_dir(spark)
    calls = C.calls(spark, sf_dir)
    rep = calls.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).select(  # fixed replica count
        F.concat_ws("-", "call_id", F.col("rep").cast("string")).alias("call_id"),
        F.when(F.col("rep") % 3 == 0, F.lit("HOT")).otherwise(F.col("agent")).alias("agent"),
        "transcript",
        "sentiment_score",
    )
    turns = P.register_turns(P.parse_turns(rep), scratch_path(spark, "skew-turns"))
    n_turns = turns.count()
    hot_turns = turns.where(F.col("agent") == "HOT").count()
    queries = {
        "agent_stats": lambda: A.agent_stats(turns),
        "agent_dashboard": lambda: A.agent_dashboard(turns),
        "worst_calls": lambda: S.worst_calls(turns, 5),
        "first_messages": lambda: S.first_messages(turns, 3),
        "review_turns": lambda: S.review_turns(turns, 10, 5),
    }
    for name, fn in queries.items():
        spark.sparkContext.setJobGroup(name, name)
        fn().write.format("noop").mode("overwrite").save()
    spark.stop()

    # stage -> job group, and per-task shuffle records
    stage_group: dict[int, str] = {}
    per_stage: dict[int, list[int]] = defaultdict(list)
    per_stage_ms: dict[int, list[int]] = defaultdict(list)
    for path in _event_files(log_dir):
        for line in _lines(path):
            if line.strip():
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        if group:
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    rd = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    info = ev.get("Task Info") or {}
                    per_stage[ev["Stage ID"]].append(rd)
                    per_stage_ms[ev["Stage ID"]].append(info.get("Finish Time", 0) - info.get("Launch Time", 0))
    report: dict[str, dict] = {}
    for sid, recs in per_stage.items():
        g = stage_group.get(sid)
        if not g or sum(recs) == 0:
            continue
        r = report.setdefault(g, {"max_task_shuffle_records": 0, "stage_total_at_max": 0})
        if max(recs) > r["max_task_shuffle_records"]:
            r["max_task_shuffle_records"] = max(recs)
            r["stage_total_at_max"] = sum(recs)
            r["tasks"] = len(recs)
            ms = sorted(per_stage_ms[sid])
            r["task_ms_max"], r["task_ms_median"] = ms[-1], ms[len(ms) // 2]
    print(
        json.dumps(
            {"turns": n_turns, "hot_agent_turns": hot_turns, "hot_share": round(hot_turns / n_turns, 3), "queries": report, "event_log": log_dir}
        )
    )


if __name__ == "__main__":
    main()

"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the runs
per query (median, after one warm-up). ``parse``, ``detect`` and ``group`` time whole stages from
their inputs; the other queries read the tables those stages wrote.
"""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from skirmish.operators import parse, sides, stats
from skirmish.plans import analysis
from skirmish.plans.queries import ENC, QUERIES, SCALED, workspace
from skirmish.sources import tables

HEADLINES = (
    "fights_open_included", "attacker_stats", "special_stats", "defense_pairs", "biggest_hits", "timeline",
    "timeline_top_and_other", "encounter_attackers", "encounter_sides", "healers", "damage_matrix", "directed_breakdown",
    "defenders", "source_breakdown", "pair_stats", "life_delta", "session_damage", "session_tanking",
    "session_trend", "diff_same_log", "player_counters", "top_damage", "recap", "active_view",
    "unknown_shapes_documents", "fights_heals_extend", "encounter_documents", "diff_cross_log",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skirmish-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    counts: dict[str, int] = {}

    def timed(name, fn):
        """``fn`` returns a DataFrame; every column is computed by the noop sink."""
        def once():
            t0 = time.perf_counter()
            fn().write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()
        took[name] = round(statistics.median(once() for _ in range(runs)), 3)

    w = workspace(spark, folder)
    lines = analysis.cut(tables.log_lines(w.raw), "lines")
    timed("parse", lambda: parse.parse_lines(lines))
    timed("detect", lambda: analysis.detect(w.events, SCALED).fights)
    timed("group", lambda: analysis.group(w.found, w.owners).encounters)

    def snapshot():
        """Owner rewrite, grouping, merge and enemy classification over all completed fights."""
        m = analysis.group(w.found, w.owners)
        return sides.recap_enemies(stats.attackers(m.acts, ENC), stats.defense_pairs(m.acts, ENC), m.heals)

    timed("snapshot", snapshot)
    for name in HEADLINES:
        if name == "encounter_sides":  # the query reads a table that the workspace keeps
            m = w.main
            timed(name, lambda: sides.encounter_sides(stats.attackers(m.acts, ENC), stats.damage_matrix(m.acts), m.members, m.heals))
        else:
            timed(name, lambda: QUERIES[name](w))
    counts["events"] = w.events.count()
    counts["fights"] = w.found.fights.count()
    counts["encounters"] = w.main.encounters.count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": folder.rsplit("sf", 1)[-1],
                "rows": counts,
            }
        )
    )


if __name__ == "__main__":
    main()

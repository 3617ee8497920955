"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up (and to store what it shares with others: the matches table,
the team table), then once timed; c02 and l01 are timed with these built anew. Results go to the no-op sink so the whole plan executes without a collect.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g08_spikes", "g07_timeline", "g10_events_near", "c02_matches", "i04_team_features",
    "i12_player_features", "d12_clean_text", "e03_near_dup_pairs", "e05_keep_first",
    "h03_team_sentiment", "f04_assign_matches", "k01_fixture_stats", "k06_player_advanced",
    "l01_feature_rows", "l09_leaderboard", "j01_normalize_features",
]


# Timed with the tables they share (matches_v, team table) built anew.
REBUILT = ["c02_matches", "l01_feature_rows"]


def forget_stored() -> None:
    from fansignal.plans import catalog
    from fansignal.sources import tables
    tables._STORED.clear()
    catalog.RESULTS_EPOCH[0] += 1


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from fansignal.session import build_session
    from fansignal.plans.catalog import QUERIES
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    times = {}
    for k in keys:
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        if k in REBUILT:        # not a read of what an earlier query stored
            forget_stored()
        t0 = time.time()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()

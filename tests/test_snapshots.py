"""Changes between snapshots against a plain comparison of consecutive snapshots."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from srcquarry.operators.snapshots import change_events, committed_sequence, validity_intervals

SCHEMA = "repo string, snap int, path string, sha string, chunks int, at timestamp, seq string"


def run(spark, rows, builds):
    df = spark.createDataFrame(rows, SCHEMA)
    log = spark.createDataFrame(builds, "repo string, snap int, status string")
    seq = committed_sequence(log, ["repo"], "snap", F.col("status") == "active")
    spans = validity_intervals(df, seq, group=["repo"], key=["path"], snapshot="snap", values=["sha", "chunks"], received="at")
    return sorted(map(tuple, change_events(spans, group=["repo"], key=["path"], snapshot="snap").collect()), key=repr)


def brute(rows, builds):
    active = {}
    for repo, snap, status in builds:
        if status == "active":
            active.setdefault(repo, set()).add(snap)
    out = []
    for repo, snaps in active.items():
        order = sorted(snaps)
        state = []
        for s in order:
            best = {}
            for r in rows:
                if r[0] == repo and r[1] == s and (r[2] not in best or r[5] > best[r[2]][5]):
                    best[r[2]] = r
            state.append({k: (v[3], v[4]) for k, v in best.items()})
        for s, old, new in zip(order[1:], state, state[1:]):
            for k in {*old, *new}:
                if k not in old:
                    out.append((repo, s, k, "A"))
                elif k not in new:
                    out.append((repo, s, k, "D"))
                elif old[k] != new[k]:
                    out.append((repo, s, k, "M"))
    return sorted(out, key=repr)


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    rows, builds = [], []
    for repo in ("a", "b", "hot"):
        for snap in range(1, 8):
            builds.append((repo, snap, "building" if snap == 3 else "active"))
            for k in range(4 if repo != "hot" else 40):
                if rng.random() < 0.7:
                    for _ in range(rng.choice([1, 1, 2])):
                        at = datetime(2030, 1, 1) + timedelta(seconds=len(rows))
                        rows.append((repo, snap, f"f{k}", rng.choice("xy"), rng.choice([1, 2, None]), at, "clash"))
    builds += builds[:3]
    assert run(spark, rows, builds) == brute(rows, builds)


def test_null_path_null_values_and_empty(spark):
    t = datetime(2030, 1, 1)
    rows = [("r", 1, None, None, None, t, ""), ("r", 2, None, None, None, None, ""), ("r", 3, None, "x", None, t, "")]
    builds = [("r", i, "active") for i in (1, 2, 3, 4)]
    assert run(spark, rows, builds) == [("r", 3, None, "M"), ("r", 4, None, "D")]
    assert run(spark, [], builds) == []
    assert run(spark, rows, []) == []

"""Registered queries over the whole of their input, by brute force on small tables."""

from datetime import datetime, timedelta

from dyadflow.plans import registry, relations


def events(spark, path, users, steps=4):
    rows = [(u * 100 + k, datetime(2024, 1, 1) + timedelta(minutes=k), u, ("error", "view", "click", "buy")[(u + k) % 4], 1.0, f'{{"k": {(u * k) % 7}}}') for u in users for k in range(steps)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_geometry_joins_all_sessions(spark, tmp_path):
    users = [1, 11, 31, 41, 1001, 2, 32, 77]
    d = events(spark, tmp_path, users)
    got = registry.QUERIES["geometry_fan_out"](spark, d).collect()
    want = [(a % 10, a, b) for a in users for b in users if a % 10 == b % 10]
    assert sorted((r.dyad_id, r.session_cpl, r.session_dir) for r in got) == sorted(want)
    f = {r.session_id: r for r in relations.rounding(relations.features(spark, d)).collect()}
    assert all((r.entropy_cpl, r.switching_dir) == (f[r.session_cpl].occ_entropy, f[r.session_dir].switching_rate) for r in got)

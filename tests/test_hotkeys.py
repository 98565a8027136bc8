import math

import numpy as np

from pointloom.operators.hotkeys import heavy_keys, key_profile


def test_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 6, 3000)] + [(f"k{i % 20}", float(i % 7)) for i in range(400)]
    rows += [("mix", v) for v in (1e308, -1e308, 0.0, 5e-324, -5e-324, math.inf, -math.inf, 1.0, 1.0)]
    rows += [("mix", None), ("mix", math.nan), ("void", None), (None, 2.0), (None, 4.0)]
    qs = (0.0, 0.25, 0.5, 0.99, 1.0)
    got = {r["key"]: r for r in key_profile(spark.createDataFrame(rows, "key string, value double"), "key", "value", qs).collect()}
    for key in {k for k, _ in rows}:
        v = sorted(x for k, x in rows if k == key and x is not None and not math.isnan(x))
        r = got[key]
        assert (r["n_rows"], r["n_values"]) == (sum(k == key for k, _ in rows), len(v))
        for q in qs:
            want = v[max(1, math.ceil(q * len(v))) - 1] if v else None
            assert r[f"q{q * 100:g}"] == want, (key, q)


def test_empty_and_heavy(spark):
    empty = spark.createDataFrame([], "key string, value int")
    assert key_profile(empty, "key", "value").count() == 0
    rows = spark.createDataFrame([("a", 1)] * 39 + [("b", 1)] + [("c", 100)], "key string, value int")
    assert {r["key"] for r in heavy_keys(rows, "key", 41).collect()} == {"a", "b", "c"}
    assert {r["key"] for r in heavy_keys(rows, "key", 4, "value").collect()} == {"a", "c"}
    assert heavy_keys(empty, "key", 4).count() == 0 and heavy_keys(rows.where("key is null"), "key", 4, "value").count() == 0


def test_heavy_keys_equal_counting(spark):
    rng = np.random.default_rng(4)
    rows = [(f"k{k}" if k % 11 else None, None if v % 9 == 0 else int(v) - 3) for k, v in zip(rng.zipf(1.3, 3000) % 300, rng.integers(0, 40, 3000))]
    df = spark.createDataFrame(rows, "key string, value int").repartition(5)
    for parts in (1, 3, 40, 200):
        n, total = {}, {}
        for k, v in rows:
            if k is not None:
                n[k], total[k] = n.get(k, 0) + 1, total.get(k, 0) + max(0, v or 0)
        for amount, per in ((None, n), ("value", total)):
            got = {r["key"]: int(r["amount"]) for r in heavy_keys(df, "key", parts, amount).collect()}
            assert got == {k: v for k, v in per.items() if v * parts >= sum(per.values())}, (parts, amount)


def test_hot_keys_stay_split_without_a_broadcast_of_all(spark, monkeypatch):
    """More open intervals than fit a broadcast: heavy keys' rows are still not shuffled, and the result is the same."""
    from pointloom.operators import hotkeys

    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(hotkeys, "HEAVY", 50)
    test_quantiles_equal_sorting(spark)
    rows = spark.createDataFrame([("hot", float(i)) for i in range(90)] + [(f"k{i}", 1.0) for i in range(60)], "k string, v double")
    state = spark.createDataFrame([("hot", 90, 0, 45, 0.0, 89.0), ("k1", 1, 0, 1, 0.0, 2.0)], "k string, n_values long, i int, rank long, lo double, hi double")
    plan = hotkeys.refine(rows, state, False, 150)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "LeftAnti" in plan
    assert {(r.k, r.lo, r.hi) for r in hotkeys.refine(rows, state, False, 150).collect()} == {("hot", 44.0, 44.0), ("k1", 1.0, 1.0)}


def test_records_without_recv_ts_keep_their_values(spark):
    """The only row of a record, or all its copies, may have a null version; its other columns stay."""
    from pointloom.session import once

    rows = [(1, 10, 2, None), (2, 20, 3, None), (2, 20, 3, None), (3, 30, 4, None), (3, 30, 4, "2024-01-01 00:00:00"), (None, 5, 6, None), (4, None, 7, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "rec_id long, feature_code int, count_value long, t string").selectExpr("rec_id", "feature_code", "count_value", "cast(t as timestamp) as recv_ts")
    got = {(r.rec_id, r.feature_code, r.count_value, r.recv_ts is None) for r in once(df, ["rec_id"]).collect()}
    assert got == {(1, 10, 2, True), (2, 20, 3, True), (3, 30, 4, False), (None, 5, 6, True), (4, None, 7, False)}
    for kind in ("date", "timestamp_ntz", "long"):
        d = df.selectExpr("rec_id", "feature_code", f"cast(null as {kind}) as recv_ts")
        assert {(r.rec_id, r.feature_code) for r in once(d, ["rec_id"]).collect()} == {(1, 10), (2, 20), (3, 30), (None, 5), (4, None)}

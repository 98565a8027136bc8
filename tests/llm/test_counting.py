import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import cooccurrence, distinctive, termfreq, topn

BASKETS = "t int, x int, item int"


@pytest.mark.parametrize("run,piece,rows_sent", [(cooccurrence.RUN, cooccurrence.PIECE, 200_000), (50, 2, 200_000), (50, 3, 4)])
@pytest.mark.parametrize("least,one_in", [(1, 0), (3, 0), (2, 10)])
def test_pairs_equal_brute_force(spark, monkeypatch, run, piece, rows_sent, least, one_in):
    """Also with runs of 50 codes, baskets cut into pieces, and kept items too many for the driver."""
    monkeypatch.setattr(cooccurrence, "RUN", run)
    monkeypatch.setattr(cooccurrence, "PIECE", piece)
    monkeypatch.setattr(cooccurrence, "BROADCAST_ROWS", rows_sent)
    rng = np.random.default_rng(1)
    rows = [(int(t), int(t) % 5 or None, int(i)) for t in range(60) for i in rng.zipf(1.5, rng.integers(0, 9)) % 40]
    rows += rows[:30] + [(1, 1, None)]
    sets = defaultdict(set)
    for t, x, i in rows:
        if i is not None:
            sets[t, x].add(i)
    n, single = len(sets), Counter(i for s in sets.values() for i in s)
    want = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    bound = max(least, -(-n // one_in) if one_in else 1)
    df = spark.createDataFrame(rows, BASKETS).withColumn("n", F.lit(0)).withColumn("code", F.lit("x"))
    got = {(r.a, r.b): r for r in cooccurrence.pair_counts(df, ["t", "x"], "item", least, one_in).collect()}
    assert {k: r.n_ab for k, r in got.items()} == {k: v for k, v in want.items() if v >= bound}
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n) == (single[a], single[b], n)
        assert abs(r.lift - r.n_ab * n / (r.n_a * r.n_b)) < 1e-9
        table = (r.n_ab + 0.5) * (n - r.n_a - r.n_b + r.n_ab + 0.5) / ((r.n_a - r.n_ab + 0.5) * (r.n_b - r.n_ab + 0.5))
        assert abs(r.log_odds - math.log(table)) < 1e-9


def test_pairs_of_nothing(spark):
    assert cooccurrence.pair_counts(spark.createDataFrame([], BASKETS), ["t", "x"], "item", 5, 100).count() == 0


TERMS = "rec_id long, unit string, feature string, ct int"


def term_rows():
    rng = np.random.default_rng(2)
    rows = [(i, f"u{i % 37}", f"f{int(f) % 25}", int(c)) for i, (f, c) in enumerate(zip(rng.zipf(1.4, 900), rng.integers(0, 4, 900)))]
    rows += rows[100:200]  # sent again
    rows += [(None, "u1", "lone", 1), (None, "u1", "lone", 1), (5000, "u1", None, 3), (5001, None, "f1", 3), (5002, "u2", "nil", None), (5003, "u3", "", 2)]
    return rows


def test_terms_equal_brute_force(spark):
    rows = term_rows()
    df = spark.createDataFrame(rows, TERMS).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r.term: (r.occurrences, r.records) for r in termfreq.term_counts(df, "feature", "unit", "ct", "rec_id").collect()}
    total, per = Counter(), Counter()
    for _, u, f, c in [*{r for r in rows if r[0] is not None}, *[r for r in rows if r[0] is None]]:
        if u is not None and f is not None:
            total[f] += c or 0
            per[f, u] += c or 0
    assert got == {f: (total[f], sum(v > 0 for (g, _), v in per.items() if g == f)) for f in total}
    marks = {r.term: r.mark for r in termfreq.marked(spark.createDataFrame([("a", 5, 1), ("b", 5, 50), ("c", 5, 3), ("d", 0, 0)], "term string, occurrences long, records long"), 100).collect()}
    assert marks == {"a": "rare", "b": "common", "c": None, "d": None}
    assert termfreq.term_counts(spark.createDataFrame([], TERMS), "feature", "unit", "ct", "rec_id").count() == 0


def test_counters_passed_on_early(spark, monkeypatch):
    monkeypatch.setattr(termfreq, "TERMS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_terms_equal_brute_force(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_counter_keeps_its_last_record():
    c = termfreq.Counters()
    add = lambda t, r, n, i: c.add(pa.array(t), pa.array(r), np.array(n), np.array(i))
    add(["a", "a", "b"], ["r1", "r1", "r1"], [1, 1, 0], [5, 5, 6])
    add(["a", "b"], ["r1", "r2"], [2, 4], [7, -1])
    k = c.number["a"]
    assert (c.occurrences[k], c.records[k], c.record[k]) == (3, 1, 0)
    k = c.number["b"]
    assert (c.occurrences[k], c.records[k], c.record[k]) == (4, 1, 1)
    assert c.flush().to_pydict() == {"term": ["a", "b"], "occurrences": [3, 4], "records": [1, 1]}
    add(["b", "c"], ["r2", "r2"], [1, 1], [-1, -1])
    assert c.flush().to_pydict() == {"term": ["b", "c"], "occurrences": [1, 1], "records": [0, 1]}


def test_share_keeps_every_term_with_that_share(spark):
    rows = [(i, f"u{i % 9}", f"f{i * i % 13}", i % 5) for i in range(400)] + [(1000, "u1", "f1", 100_000)]
    df = spark.createDataFrame(rows, TERMS)
    every = {(r.record, r.term): r for r in distinctive.term_scores(df, "unit", "feature", "ct", "rec_id").collect()}
    some = {(r.record, r.term) for r in distinctive.term_scores(df, "unit", "feature", "ct", "rec_id", share=0.25).collect()}
    assert {k for k, r in every.items() if r.tf * 4 >= r.record_total} <= some < set(every)


def test_heaps_take_as_long_with_many_groups():
    """400,000 rows in 100 and in 20,000 groups: no more than four times as long."""
    import time

    rng = np.random.default_rng(6)
    took = []
    for k in (100, 20_000):
        g = rng.integers(0, k, 400_000)
        t = pa.table({"g": g, "a": rng.random(400_000), "item": np.arange(400_000), topn.HASH: g * 7919})
        began = time.time()
        out = pa.Table.from_batches(topn._heaps(iter(t.to_batches(10_000)), ["g"], ["a"], "item", 20))
        took.append(time.time() - began)
        assert out.num_rows == 20 * k if k == 100 else out.num_rows <= 20 * k
    assert took[1] < 4 * took[0] + 1.0, took


def test_scores_equal_brute_force(spark):
    rows = term_rows()
    df = spark.createDataFrame(rows, TERMS).withColumn("tf", F.lit("clash")).withColumn("records", F.lit(1))
    got = {(r.record, r.term): r for r in distinctive.term_scores(df, "unit", "feature", "ct", "rec_id", mu=10.0, min_records=2).collect()}
    tf = Counter()
    for _, u, f, c in [*{r for r in rows if r[0] is not None}, *[r for r in rows if r[0] is None]]:
        if u is not None and f is not None and c:
            tf[u, f] += c
    size, total, df_ = Counter(), Counter(), Counter()
    for (u, f), c in tf.items():
        size[u] += c
        total[f] += c
        df_[f] += 1
    whole = sum(total.values())
    assert set(got) == {k for k in tf if df_[k[1]] >= 2}
    for (u, f), r in got.items():
        c = total[f] / whole
        p = (tf[u, f] + 10 * c) / (size[u] + 10)
        assert (r.tf, r.record_total, r.records, r.n_records) == (tf[u, f], size[u], df_[f], len({u for _, u, *_ in rows if u}))
        assert abs(r.score - p * math.log(p / c)) < 1e-12
    assert distinctive.term_scores(spark.createDataFrame([], TERMS), "unit", "feature", "ct").count() == 0


ITEMS = "g string, k int, item string, a double, b double"


@pytest.mark.parametrize("held,least", [(topn.HELD, topn.LEAST), (3, 20), (100_000, 20)])
def test_top_items_equal_brute_force(spark, monkeypatch, held, least):
    monkeypatch.setattr(topn, "HELD", held)
    monkeypatch.setattr(topn, "LEAST", least)
    rng = np.random.default_rng(3)
    pick = lambda: [None, math.nan, math.inf, -math.inf, 1.0, 2.0, 2.0, 0.5][int(rng.integers(0, 8))]
    rows = [(f"g{int(i) % 4}" if i % 9 else None, int(i) % 3, f"é{int(j) % 30}" if j % 7 else None, pick(), pick()) for i, j in rng.integers(0, 400, (900, 2))]
    rows += rows[:100] + [("big", 0, f"x{i}", float(i % 50), None) for i in range(3000)]
    df = spark.createDataFrame(rows, ITEMS).repartition(7).withColumn("rank", F.lit("clash"))
    got = defaultdict(list)
    for r in topn.top_items(df.select(*[c for c in df.columns if c != "rank"]), ["g", "k"], ["a", "b"], "item", 5).collect():
        got[r.g, r.k].append((r["rank"], r["item"]))
    clean = lambda v: -math.inf if v is None or math.isnan(v) else v
    missing = lambda v: v is None or math.isnan(v)
    best = {}
    for g, k, item, a, b in rows:
        if item is not None:
            order = (missing(a), -clean(a) if not missing(a) else 0, missing(b), -clean(b) if not missing(b) else 0)
            best[g, k, item] = min(best.get((g, k, item), order), order)
    want = defaultdict(list)
    for (g, k, item), o in best.items():
        want[g, k].append((o, item))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i + 1, x) for i, (_, x) in enumerate(sorted(v)[:5])] for k, v in want.items()}


def test_top_of_nothing(spark):
    assert topn.top_items(spark.createDataFrame([], ITEMS), ["g"], ["a"], "item", 3).count() == 0

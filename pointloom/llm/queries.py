"""Queries of the problems tagged llm, and the SQL they are checked against."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.clusters import centres_for, clusters, coalesced, hashed_vectors, kmeans, mutual_clusters
from pointloom.llm.cooccurrence import pair_counts
from pointloom.llm.distinctive import term_scores
from pointloom.llm.leaks import leaked
from pointloom.llm.packing import containers
from pointloom.llm.termfreq import marked, merged, term_counts
from pointloom.llm.topn import top_items
from pointloom.llm.toxic import FOUND, Field, toxicity, trained
from pointloom.session import feature_name, materialize, once, small, table

PIXEL = ["tile_z", "tile_x", "tile_y", "local_x", "local_y"]
DIMS = 32


# ---------------------------------------------------------------- 3


def _pairs(spark: SparkSession, sf_dir: str, min_count: int, one_in: int) -> DataFrame:
    """Pairs of feature names of pixels; ids follow the order of names, so the smaller name comes first."""
    codes = table(spark, sf_dir, "feature_dict").where("feature_code is not null and feature is not null").select("feature_code", feature_name("feature").alias("feature"))
    codes = codes.withColumn("fid", F.dense_rank().over(Window.orderBy("feature")))  # the dictionary: a dimension table
    rows = table(spark, sf_dir, "tile_points").where("local_x is not null and local_y is not null and feature_code is not null").select(*PIXEL, "feature_code")
    rows = rows.join(small(codes.select("feature_code", "fid")), "feature_code").select(*PIXEL, "fid")
    names = small(codes.select("fid", "feature").distinct())
    p = pair_counts(rows, PIXEL, "fid", min_count, one_in)
    p = p.join(names.select(F.col("fid").alias("a"), F.col("feature").alias("feature_a")), "a")
    return p.join(names.select(F.col("fid").alias("b"), F.col("feature").alias("feature_b")), "b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir, 5, 2000)
    # three times as often as chance means log odds above 0, as n_ab is at least 5; the exact test follows
    p = p.where("log_odds > 0")
    beyond = F.col("n_ab").cast("decimal(38,0)") * F.col("n") >= F.col("n_a").cast("decimal(19,0)") * F.col("n_b") * 3
    return p.where(beyond).select("feature_a", "feature_b")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with their counts, lift and log odds ratio."""
    p = _pairs(spark, sf_dir, 1, 0)
    return p.select("feature_a", "feature_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


# ---------------------------------------------------------------- 4


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "unit_factors").select("unit_id", "dense")
    return materialize(hashed_vectors(units, "unit_id", "dense", DIMS, 32))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _vectors(spark, sf_dir)
    centres = coalesced(data, kmeans(data, centres_for(data.count()), DIMS), DIMS, math.acos(0.9) / 3)
    out = mutual_clusters(data, centres, DIMS, 0.9, 3)
    return out.select("cluster_key", F.col("id").alias("unit_id"))


def p4_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each k-means cluster's size and its most typical units."""
    data = _vectors(spark, sf_dir)
    return clusters(data, kmeans(data, centres_for(data.count()), DIMS), DIMS).withColumnRenamed("id", "unit_id")


# ---------------------------------------------------------------- 5


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total count, units present and mark of each feature, live and archived."""
    live = table(spark, sf_dir, "unit_features")
    units = live.where("unit_id is not null").select("unit_id").distinct().count()
    a = term_counts(live.withColumn("feature", feature_name("feature")), "feature", "unit_id", "ct", "rec_id")
    stats = table(spark, sf_dir, "feature_stats")
    archived = stats.groupBy("sample_id").agg(F.max("n_units").alias("n")).agg(F.sum("n")).first()[0] or 0
    s = stats.where("feature is not null").select("sample_id", feature_name("feature").alias("term"), F.coalesce("total_count", F.lit(0)).alias("occurrences"), F.coalesce("n_units_present", F.lit(0)).alias("records"), "recv_ts")
    s = once(s, ["sample_id", "term"]).select("term", "occurrences", "records")
    counts = merged(a.unionByName(s))
    return marked(counts, units + archived).select(F.col("term").alias("feature"), F.col("occurrences").cast("long").alias("total_count"), F.col("records").cast("long").alias("n_units_present"), "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).where("mark is not null").select("feature", "mark")


# ---------------------------------------------------------------- 6


def _scores(spark: SparkSession, sf_dir: str, share: float | None = None) -> DataFrame:
    live = table(spark, sf_dir, "unit_features").select("rec_id", "unit_id", feature_name("feature").alias("feature"), "ct")
    return term_scores(live, "unit_id", "feature", "ct", "rec_id", share=share)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir, 0.25).where("tf * 4 >= record_total and records * 20 < n_records")
    return s.select(F.col("record").alias("unit_id"), F.col("term").alias("feature"))


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return s.select(F.col("record").alias("unit_id"), F.col("term").alias("feature"), "tf", "record_total", "records", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- 7


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "de_rows").withColumn("factor", F.expr("cast(try_cast(trim(factor) as double) as int)"))
    rows = rows.where("log10pval is not null and not isnan(log10pval) and factor is not null")
    return top_items(rows, ["sample_id", "factor"], ["log10pval", "fold_change"], "gene", 20).select("sample_id", "factor", "gene")


# ---------------------------------------------------------------- 8


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's (or, of long ones, each piece's) container of 4,096 tokens."""
    return containers(table(spark, sf_dir, "documents"), capacity=4096)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room used, by how many pieces share a container."""
    packed = materialize(p8_containers(spark, sf_dir)).where("container is not null")
    each = packed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    out = each.groupBy("pieces").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * 4096), 6))


# ---------------------------------------------------------------- 9


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in documents with the matching words and the character spans to remove."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).select("item_id", "doc_id")


# ---------------------------------------------------------------- 10


def _field(spark: SparkSession, sf_dir: str) -> Field:
    return trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity(table(spark, sf_dir, "documents"), _field(spark, sf_dir))
    return scores.where(F.col("score") >= FOUND).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, and the character offsets of its passages."""
    return toxicity(table(spark, sf_dir, "documents"), _field(spark, sf_dir))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, documents with a passage and their rate, by source."""
    scores = materialize(toxicity(table(spark, sf_dir, "documents"), _field(spark, sf_dir)).select("doc_id", "score"))
    by = table(spark, sf_dir, "documents").select("doc_id", "source").join(scores, "doc_id").groupBy("source")
    out = by.agg(F.count(F.lit(1)).alias("docs"), F.sum((F.col("score") >= FOUND).cast("long")).alias("toxic_docs"), F.round(F.avg("score"), 6).alias("mean_score"))
    return out.withColumn("rate", F.round(F.col("toxic_docs") / F.col("docs"), 6))


QUERIES = {
    "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_typical": p4_typical, "p5_found": p5_found, "p5_terms": p5_terms,
    "p6_found": p6_found, "p6_scores": p6_scores, "p7_found": p7_found,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
}

_PIXELS = """
d AS (SELECT feature_code, lower(trim(feature)) AS feature FROM feature_dict),
px AS (SELECT DISTINCT tile_z, tile_x, tile_y, local_x, local_y, d.feature FROM tile_points t JOIN d USING (feature_code)
       WHERE local_x IS NOT NULL AND local_y IS NOT NULL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT tile_z, tile_x, tile_y, local_x, local_y FROM px)),
f AS (SELECT feature, count(*) AS k FROM px GROUP BY feature),
ab AS (SELECT a.feature AS feature_a, b.feature AS feature_b, count(*) AS n_ab FROM px a JOIN px b
       ON (a.tile_z, a.tile_x, a.tile_y, a.local_x, a.local_y) = (b.tile_z, b.tile_x, b.tile_y, b.local_x, b.local_y) AND a.feature < b.feature
       GROUP BY ALL),
q AS (SELECT ab.*, fa.k AS n_a, fb.k AS n_b, n.n FROM ab JOIN f fa ON fa.feature = feature_a JOIN f fb ON fb.feature = feature_b CROSS JOIN n)
"""

_LIVE = """
r AS (SELECT rec_id, min(unit_id) AS unit_id, min(lower(trim(feature))) AS feature, min(coalesce(ct, 0)) AS ct FROM unit_features GROUP BY rec_id),
tf AS (SELECT unit_id, feature, sum(ct) AS tf FROM r WHERE feature IS NOT NULL GROUP BY ALL)
"""

_TERMS = f"""WITH {_LIVE},
s AS (SELECT sample_id, lower(trim(feature)) AS feature, min(coalesce(total_count, 0)) AS total_count, min(coalesce(n_units_present, 0)) AS present
      FROM feature_stats WHERE feature IS NOT NULL GROUP BY ALL),
u AS (SELECT feature, tf, CASE WHEN tf > 0 THEN 1 ELSE 0 END AS present FROM tf UNION ALL SELECT feature, total_count, present FROM s),
n AS (SELECT (SELECT count(DISTINCT unit_id) FROM unit_features) + (SELECT sum(x) FROM (SELECT max(n_units) AS x FROM feature_stats GROUP BY sample_id)) AS n),
t AS (SELECT feature, CAST(sum(tf) AS BIGINT) AS total_count, CAST(sum(present) AS BIGINT) AS n_units_present FROM u GROUP BY feature)
SELECT t.*, CASE WHEN n_units_present BETWEEN 1 AND 2 THEN 'rare' WHEN n_units_present * 2 >= n.n THEN 'common' END AS mark FROM t CROSS JOIN n"""

_SCORES = f"""WITH {_LIVE},
p AS (SELECT * FROM tf WHERE tf > 0),
l AS (SELECT unit_id, sum(tf) AS len FROM p GROUP BY unit_id),
t AS (SELECT feature, count(*) AS records, sum(tf) AS total FROM p GROUP BY feature),
w AS (SELECT sum(tf) AS whole, (SELECT count(DISTINCT unit_id) FROM unit_features) AS n FROM p),
x AS (SELECT p.unit_id, p.feature, tf, len, records, n, total / CAST(whole AS DOUBLE) AS c, (tf + 100.0 * total / CAST(whole AS DOUBLE)) / (len + 100.0) AS pr
      FROM p JOIN l USING (unit_id) JOIN t USING (feature) CROSS JOIN w)
"""

SQL = {
    "p3_found": f"WITH {_PIXELS} SELECT feature_a, feature_b FROM q WHERE n_ab >= 5 AND 2000 * n_ab >= n AND n_ab * n >= 3 * n_a * n_b",
    "p3_pairs": f"""WITH {_PIXELS} SELECT feature_a, feature_b, n_ab, n_a, n_b, n, round(n_ab * CAST(n AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE)), 6) AS lift,
  round(ln((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 6) AS log_odds FROM q""",
    "p4_found": """
WITH u AS (SELECT unit_id, min(dense) AS dense FROM unit_factors WHERE len(dense) = 32 GROUP BY unit_id),
z AS (SELECT unit_id, list_transform(dense, lambda x: coalesce(CAST(x AS DOUBLE), 0.0)) AS v FROM u),
k AS (SELECT unit_id, v FROM z WHERE NOT list_bool_or(list_transform(v, lambda x: isnan(x) OR isinf(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
s AS (SELECT a.unit_id AS a, b.unit_id AS b FROM k a JOIN k b ON list_cosine_similarity(a.v, b.v) >= 0.9),
g AS (SELECT a, list(b ORDER BY b) AS near FROM s GROUP BY a),
c AS (SELECT near FROM g GROUP BY near HAVING count(*) = len(near) AND count(*) >= 3)
SELECT near[1] AS cluster_key, unnest(near) AS unit_id FROM c""",
    "p5_terms": _TERMS,
    "p5_found": f"SELECT feature, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p6_found": f"{_SCORES} SELECT unit_id, feature FROM x WHERE tf * 4 >= len AND records * 20 < n",
    "p6_scores": f"{_SCORES} SELECT unit_id, feature, CAST(tf AS BIGINT) AS tf, CAST(len AS BIGINT) AS record_total, records, round(pr * ln(pr / c), 6) AS score FROM x",
    "p7_found": """
WITH r AS (SELECT sample_id, CAST(TRY_CAST(trim(factor) AS DOUBLE) AS INTEGER) AS factor, gene, log10pval, fold_change FROM de_rows
           WHERE log10pval IS NOT NULL AND NOT isnan(log10pval) AND gene IS NOT NULL AND TRY_CAST(trim(factor) AS DOUBLE) IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY sample_id, factor, gene ORDER BY log10pval DESC, fold_change DESC NULLS LAST) AS k FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY sample_id, factor ORDER BY log10pval DESC, fold_change DESC NULLS LAST, gene) AS j FROM b WHERE k = 1)
SELECT sample_id, factor, gene FROM t WHERE j <= 20""",
}

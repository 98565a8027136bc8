"""How much a term marks a record against the whole collection.

The score is the term's contribution to the relative entropy between the
record's Dirichlet-smoothed distribution and the collection's:
``p log(p / c)`` with ``p = (tf + mu c) / (len + mu)`` and ``c`` the term's share
of all occurrences.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.session import materialize, small


def term_scores(rows: DataFrame, record: str, term: str, amount: str, row_id: str | None = None, mu: float = 100.0, min_records: int = 1, share: float | None = None) -> DataFrame:
    """``record, term, tf, record_total, records, n_records, score`` for each term with a count above zero.

    Rows of one ``row_id`` count once (a null id is its own row).  Null counts
    are 0; rows with a null term count neither in a term nor in a record's total,
    but their record is one of ``n_records``.  Rows with a null record are left
    out.  Terms in fewer than ``min_records`` records get no row, though they
    stay part of totals and of the collection's distribution.  With ``share``
    only terms come out that score at least what this term would score if it were
    that share of the record, which a term with that share or more always does.
    """
    base = rows.where(F.col(record).isNotNull())
    n_records = base.select(record).distinct().count()
    t = base.where(F.col(term).isNotNull()).select(
        F.col(record).alias("record"), F.col(term).alias("term"), F.coalesce(F.col(amount).cast("long"), F.lit(0)).alias("n"),
        (F.col(row_id) if row_id else F.lit(None).cast("long")).alias("i"),
    )
    t = t.withColumn("lone", F.when(F.col("i").isNull(), F.monotonically_increasing_id()))
    # one exchange serves both aggregations, as their keys contain the partitioning's
    t = t.repartition("record", "term").groupBy("record", "term", "i", "lone").agg(F.max("n").alias("n"))
    tf = materialize(t.groupBy("record", "term").agg(F.sum("n").alias("tf")).where("tf > 0"))  # read three times below
    sizes = tf.groupBy("record").agg(F.sum("tf").alias("record_total"))
    terms = tf.groupBy("term").agg(F.count(F.lit(1)).alias("records"), F.sum("tf").alias("term_total"))
    whole = terms.agg(F.sum("term_total")).first()[0] or 0
    known = small(terms.where(F.col("records") >= min_records))
    out = tf.join(known, "term").join(sizes, "record")
    c = F.col("term_total") / F.lit(float(whole))
    p = (F.col("tf") + mu * c) / (F.col("record_total") + F.lit(mu))
    out = out.select("record", "term", "tf", "record_total", "records", F.lit(n_records).cast("long").alias("n_records"), (p * F.log(p / c)).alias("score"), c.alias("c"))
    if share is not None:
        # p log(p / c) grows from p = c / e on, where it is least
        q = (share * F.col("record_total") + mu * F.col("c")) / (F.col("record_total") + F.lit(mu))
        least = F.when(q * math.e >= F.col("c"), q * F.log(q / F.col("c"))).otherwise(-F.col("c") / math.e)
        out = out.where(F.col("score") >= least - 1e-9)
    return out.drop("c")

"""Many small groups in Python without a call of the engine for each."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pointloom.operators.proximity import changes, chunks


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def apply_groups(df: DataFrame, keys: list[str], func, schema: str) -> DataFrame:
    """``func(group as pandas) -> pandas`` on each group of ``keys``; like ``applyInPandas``, with thousands of groups a batch."""
    out = arrow_schema(schema)

    def run(batches):
        for t in chunks(batches, keys, 20_000):
            cut = [*changes([t.column(k) for k in keys]).tolist(), t.num_rows]
            pdf = t.to_pandas()
            parts = [func(pdf.iloc[a:b].reset_index(drop=True)) for a, b in zip(cut[:-1], cut[1:])]
            parts = [p for p in parts if len(p)]
            if parts:
                yield from pa.Table.from_pandas(pd.concat(parts, ignore_index=True), out, preserve_index=False).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)

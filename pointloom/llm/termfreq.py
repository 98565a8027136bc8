"""How often every term occurs and in how many records, by last-seen counters.

Tokens are hash-partitioned and ordered by record.  A term's counter holds its
occurrences, its records, the last record it was seen in and the last row: a
token of another record than that adds one record, a token of the same row is a
copy.  No set of a record's terms is ever kept.  Partitions go by (term,
record), so a term that is everywhere is counted in all of them and its counters
are added at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.runs import changes

#: Terms of a task's counters above which they are passed on and only those of the current record kept.
TERMS = 1_000_000
_OUT = "term string, occurrences long, records long"


class Counters:
    """Occurrences, records, last record and last row of each term met so far."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.occurrences, self.records = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.record, self.row, self.present = (np.full(1024, -1, np.int64) for _ in range(3))  # present: the last record with an amount above zero
        self.now, self.name = -1, None  # number and name of the record that is read

    def __len__(self) -> int:
        return len(self.number)

    def add(self, term: pa.Array, record: pa.Array, amount: np.ndarray, row: np.ndarray) -> None:
        """Tokens ordered by record, and within it by term and row; ``row`` is -1 where rows aren't known."""
        if not len(term):
            return
        first = changes([record])
        begins = np.zeros(len(term), np.int64)
        begins[first] = 1
        begins[0] = int(self.name is None or record[0].as_py() != self.name)
        at_record = self.now + np.cumsum(begins)
        self.now, self.name = int(at_record[-1]), record[len(record) - 1].as_py()
        coded = term.dictionary_encode()
        ids = np.array([self.number.setdefault(t, len(self.number)) for t in coded.dictionary.to_pylist()], np.int64)
        if len(self.number) > len(self.record):
            self._grow(len(self.number))
        t = ids[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(t, kind="stable")
        t, r, n, i = t[order], at_record[order], amount[order], row[order]
        head = np.r_[True, t[1:] != t[:-1]]
        # what each term's counter says when the token comes: the token before, or what was kept from earlier ones
        was_record = np.where(head, self.record[t], np.r_[-1, r[:-1]])
        was_row = np.where(head, self.row[t], np.r_[-1, i[:-1]])
        copy = (i >= 0) & (was_row == i) & (was_record == r)
        n = np.where(copy, 0, n)
        np.add.at(self.occurrences, t, n)
        some = np.flatnonzero(n > 0)
        ts, rs = t[some], r[some]
        lead = np.r_[True, ts[1:] != ts[:-1]] if len(ts) else np.zeros(0, bool)
        seen = np.where(lead, self.present[ts], np.r_[-1, rs[:-1]] if len(rs) else rs)
        np.add.at(self.records, ts, seen != rs)
        self.present[ts] = rs  # of several the last is kept, as they are in order
        tail = np.flatnonzero(np.r_[head[1:], True])
        self.record[t[tail]], self.row[t[tail]] = r[tail], i[tail]

    def _grow(self, n: int) -> None:
        more = max(n, 2 * len(self.record)) - len(self.record)
        self.occurrences, self.records = np.r_[self.occurrences, np.zeros(more, np.int64)], np.r_[self.records, np.zeros(more, np.int64)]
        self.record, self.row, self.present = (np.r_[x, np.full(more, -1, np.int64)] for x in (self.record, self.row, self.present))

    def flush(self) -> pa.RecordBatch:
        """The counters so far; those last seen in the record that is read go on from zero, the others are dropped."""
        n = len(self.number)
        out = pa.RecordBatch.from_arrays([pa.array(list(self.number), pa.string()), pa.array(self.occurrences[:n].copy()), pa.array(self.records[:n].copy())], ["term", "occurrences", "records"])
        kept = [(t, k) for t, k in self.number.items() if self.record[k] == self.now]
        state = [(self.record[k], self.row[k], self.present[k]) for _, k in kept]
        now, name = self.now, self.name
        self.__init__()
        self.now, self.name = now, name
        if len(kept) > len(self.record):
            self._grow(len(kept))
        for j, ((t, _), (record, row, present)) in enumerate(zip(kept, state)):
            self.number[t] = j
            self.record[j], self.row[j], self.present[j] = record, row, present
        return out


def term_counts(rows: DataFrame, term: str, record: str, amount: str | None = None, row_id: str | None = None) -> DataFrame:
    """``term, occurrences, records``: the term's total amount, and the records in which it has an amount above zero.

    ``amount`` is the count of a row (null or negative is 0; without the column
    each row counts 1).  Rows that share a ``row_id``, term and record are one
    row; a null or negative row id is its own row.  Null terms and records are left out.  A
    term that never has an amount above zero comes out with 0 records.
    """
    n = F.greatest(F.coalesce(F.col(amount).cast("long"), F.lit(0)), F.lit(0)) if amount else F.lit(1)
    i = F.col(row_id).cast("long") if row_id else F.lit(None)
    t = rows.where(F.col(term).isNotNull() & F.col(record).isNotNull())
    t = t.select(F.col(term).cast("string").alias("term"), F.col(record).cast("string").alias("record"), n.cast("long").alias("n"), i.cast("long").alias("i"))
    t = t.repartition("term", "record").sortWithinPartitions("record", "term", "i")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counters()
        for b in batches:
            i = b.column("i")
            row = np.where(i.is_valid().to_numpy(zero_copy_only=False), i.fill_null(0).to_numpy(zero_copy_only=False), -1)
            c.add(b.column("term"), b.column("record"), b.column("n").to_numpy(), row)
            if len(c) > TERMS:
                yield c.flush()
        if len(c):
            yield c.flush()

    return t.mapInArrow(count, _OUT).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def merged(parts: DataFrame) -> DataFrame:
    """Counters of one term added up, as of several collections without a record in common."""
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, n_records: int, rare: int = 2, common_in: int = 2) -> DataFrame:
    """``counts`` with ``mark``: 'rare' for 1 to ``rare`` records, 'common' for at least ``1/common_in`` of all, else null.

    A term that is both, as in a tiny collection, is 'rare'.
    """
    r = F.col("records")
    return counts.withColumn("mark", F.when((r >= 1) & (r <= rare), "rare").when((r * common_in >= n_records) & (r > 0), "common"))

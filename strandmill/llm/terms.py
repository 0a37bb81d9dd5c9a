"""How often every distinct term occurs, and in how many records.

Method: range-partitioned external sort of (field, term, record, occurrence) rows, then a run-length scan of each sorted partition. A range border
may fall anywhere, also within rows that are alike - a tie-breaker spreads them - so no term is too hot for a task. The scan marks the first and the last
term of its partition with the rows at their ends; only these, at most two a partition, are merged: what is on both sides of a border counts once.

Defined cases: rows with a null term are left out; a null record or occurrence is a value like any other; repeated rows are one occurrence;
bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.runs import changed
from strandmill.sources.shared import materialise, width

NAMES = ["field", "term", "record", "occurrence"]
SCHEMA = "field string, term string, occurrences bigint, records bigint, edge boolean, part int, first_record string, first_occurrence string, last_record string, last_occurrence string"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per term of a sorted partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), *[pa.string()] * 4]
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    def edge(key: tuple, counts: list[int], first: tuple, last: tuple) -> pa.RecordBatch:
        row = (*key, *counts, True, part, *first, *last)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    before, key, counts, first, leading = None, None, [0, 0], None, True
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i) for i in range(4)]
        value = lambda i: tuple(c[i].as_py() for c in cols)  # noqa: E731, B023
        new_term = changed(cols[:2], before and before[:2])
        new_record = new_term | changed(cols[2:3], before and before[2:3])
        new_occurrence = new_record | changed(cols[3:], before and before[3:])
        at = np.flatnonzero(new_term)
        head = int(at[0]) if len(at) else b.num_rows  # rows that still belong to the open term
        counts[0] += int(new_occurrence[:head].sum())
        counts[1] += int(new_record[:head].sum())
        if len(at):
            if key is not None:
                # The term that was open ends here; it is an edge if it is the partition's first.
                last = before[2:] if head == 0 else value(head - 1)[2:]
                closed = edge(key, counts, first, last)
                if not leading:
                    closed = closed.set_column(4, "edge", pa.array([False]))
                yield closed
                leading = False
            sums = [np.add.reduceat(x.astype(np.int64), at) for x in (new_occurrence, new_record)]
            inner = at[:-1]
            if leading and len(inner):
                v = value(int(inner[0]))
                yield edge(v[:2], [int(s[0]) for s in sums], v[2:], value(int(at[1]) - 1)[2:])
                leading, inner, done = False, inner[1:], 1
            else:
                done = 0
            if len(inner):
                take = pa.array(inner)
                n, none = len(inner), pa.nulls(len(inner), pa.string())
                counted = [pa.array(s[done:-1]) for s in sums]
                yield pa.RecordBatch.from_arrays(
                    [cols[0].take(take), cols[1].take(take), *counted, pa.array(np.zeros(n, bool)), pa.array(np.full(n, part, np.int32)), none, none, none, none], names=names
                )
            v = value(int(at[-1]))
            key, first, counts = v[:2], v[2:], [int(s[-1]) for s in sums]
        before = value(b.num_rows - 1)
    if key is not None:
        yield edge(key, counts, first, before[2:])


def term_frequencies(rows: DataFrame) -> DataFrame:
    """rows (field, term, record, occurrence) -> (field, term, occurrences, records): distinct occurrences and distinct records of each term."""
    valid = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    text = lambda c: F.coalesce(valid(c), F.lit("\0")).alias(c)
    plain = rows.where("field is not null and term is not null").select(valid("field").alias("field"), valid("term").alias("term"), text("record"), text("occurrence"), F.monotonically_increasing_id().alias("tie"))
    by = [*NAMES, "tie"]
    ordered = plain.repartitionByRange(width(rows.sparkSession), *by).sortWithinPartitions(*by).select(*NAMES)
    found = materialise(ordered.mapInArrow(scan, SCHEMA), "terms")
    w = Window.partitionBy("field", "term").orderBy("part")
    again = lambda c: F.lag("last_" + c).over(w).eqNullSafe(F.col("first_" + c)) & F.lag("part").over(w).isNotNull()
    edges = found.where("edge").select("*", again("record").alias("r"), (again("record") & again("occurrence")).alias("o"))
    merged = edges.groupBy("field", "term").agg(
        (F.sum("occurrences") - F.sum(F.col("o").cast("bigint"))).alias("occurrences"), (F.sum("records") - F.sum(F.col("r").cast("bigint"))).alias("records")
    )
    return found.where("not edge").select("field", "term", "occurrences", "records").unionByName(merged)

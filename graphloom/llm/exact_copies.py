"""Duplicates hidden by formatting differences: one representative and the number of copies per group.

Records whose content fields have equal canonical forms (functions.canon: case, white space, punctuation, invisible characters and
Unicode form taken away) are one. The canonical records are range-partitioned and externally sorted by their full key, and each
partition is scanned once for runs of adjacent equal keys, so memory doesn't depend on the size of a group.

Skew: each batch first collapses its own repeats, and the range partitioning is by (key, record id), so a key that holds a third of
all rows is spread over many partitions. Only the first and the last run of a partition can continue in a neighbour; these carry
their key into a last, small aggregation. Inner runs are complete, and travel without their key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.canon import canon
from graphloom.functions.columns import pick
from graphloom.session import cut

#: Between the fields of a key; canonical text never has it.
_UNIT = "\x1f"


def canonical_records(df: DataFrame, node_type: str, fields: list[str], id_col: str) -> DataFrame:
    """(node_type, key, rid, n): the canonical key of each record, equal ones of one batch already collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = [[canon(x) for x in b.column(i).to_pylist()] for i in range(1, b.num_columns)]
            keys = [_UNIT.join(x) for x in zip(*parts)]
            t = pa.table({"key": pa.array(keys, pa.string()), "rid": b.column(0), "n": pa.array([1] * len(keys), pa.int64())})
            g = t.group_by("key").aggregate([("rid", "min"), ("n", "sum")])
            names = pa.array([node_type] * g.num_rows, pa.string())
            out = pa.table({"node_type": names, "key": g["key"], "rid": g["rid_min"], "n": g["n_sum"]})
            yield from out.combine_chunks().to_batches()

    return pick(df, [id_col, *fields]).withColumn(id_col, F.col(id_col).cast("long")).mapInArrow(run, "node_type string, key string, rid long, n long")


def _scan_runs(min_copies: int):
    """Runs of adjacent equal keys in a sorted partition. The first and last run keep their key; inner ones under min_copies end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # the first run of the partition
        open_run = None  # the run that may go on in the next batch
        schema = pa.schema([("node_type", pa.string()), ("key", pa.string()), ("rid", pa.int64()), ("n", pa.int64())])

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            kind, key = b.column(0), b.column(1)
            same = pc.and_(pc.equal(kind.slice(1), kind.slice(0, len(kind) - 1)), pc.equal(key.slice(1), key.slice(0, len(key) - 1)))
            starts = [0, *(i + 1 for i, x in enumerate(same.to_pylist()) if not x)]
            rid, n = b.column(2).to_pylist(), b.column(3).to_pylist()
            done = []
            for s, e in zip(starts, [*starts[1:], b.num_rows]):
                low = min((x for x in rid[s:e] if x is not None), default=None)
                this = [kind[s].as_py(), key[s].as_py(), low, sum(n[s:e])]
                if open_run and open_run[:2] == this[:2]:
                    open_run[2] = low if open_run[2] is None else open_run[2] if low is None else min(open_run[2], low)
                    open_run[3] += this[3]
                    continue
                if open_run:
                    if head is None:
                        head = open_run
                        done.append(tuple(head))
                    elif open_run[3] >= min_copies:
                        done.append((open_run[0], None, open_run[2], open_run[3]))
                open_run = this
            if done:
                yield emit(done)
        if open_run:
            yield emit([tuple(open_run)])

    return run


def collapse_copies(records: DataFrame, min_copies: int = 1) -> DataFrame:
    """(node_type, record_id, copies) of each group of at least min_copies equal canonical records.

    ``records`` comes from canonical_records, or is a union of several. record_id is the smallest of the group. Null, blank and
    punctuation-only fields are alike, so records without any content form a group of their own. Null ids count as copies but are
    never the representative unless the group has no other. Repeated rows count as often as they occur. An empty table gives no rows.
    """
    order = ["node_type", "key", "rid"]
    records = cut(records)  # the range partitioning reads it twice, once for its sample
    runs = records.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan_runs(min_copies), "node_type string, key string, rid long, n long")
    inner = F.when(F.col("key").isNull(), F.struct("rid", F.monotonically_increasing_id().alias("m")))
    merged = runs.withColumn("inner", inner).groupBy("node_type", "key", "inner").agg(F.min("rid").alias("record_id"), F.sum("n").alias("copies"))
    return merged.filter(F.col("copies") >= min_copies).select("node_type", "record_id", "copies")


def collapse_tables(tables: list[tuple[DataFrame, str, list[str]]], id_col: str = "record_id", min_copies: int = 1) -> DataFrame:
    """collapse_copies over several tables, (table, node_type, fields) each, in one pass."""
    return collapse_copies(reduce(DataFrame.unionByName, [canonical_records(df, kind, fields, id_col) for df, kind, fields in tables]), min_copies)

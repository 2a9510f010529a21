"""Exact top-k search by integer inner product with block-at-a-time pruning.

Vectors are dealt into id ranges, each stored as one packed row (ids, forward index). A task meets
one block of queries and one range. Inside the range, blocks of consecutive documents carry the
largest and smallest weight of every term. A query's bound on a block is the sum over terms of its
weight times the extreme that helps it; blocks are scored in the order of their bounds until the
bound falls below the query's k-th best score. The ranges' best are merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunesmith.session import materialize

RANGE_ROWS = 16_384  # vectors of a packed range
BLOCK_ROWS = 128     # documents of a block
QUERY_ROWS = 1_024   # queries of a query block, on average

_PACKED = "part int, ids binary, weights binary, dims int"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; null for vectors that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _pack(batches, of_rows: int | None):
    """Rows (id, weights) of a partition as one packed row, or one for every ``of_rows`` rows."""
    part = TaskContext.get().partitionId()
    ids, rows = [], []

    def packed():
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        dims = max((len(r) for r in rows), default=0)
        w = np.zeros((len(rows), dims), np.int64)
        for i, j in enumerate(order):
            w[i, :len(rows[j])] = rows[j]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()),
             pa.array([w.tobytes()], pa.binary()), pa.array([dims], pa.int32())], names=["part", "ids", "weights", "dims"])

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            rows.append(v.values.to_numpy(zero_copy_only=False))
            if of_rows and len(ids) == of_rows:
                yield packed()
                ids, rows = [], []
    if ids:
        yield packed()


def search_range(q_ids, q, d_ids, d, k: int, block_rows: int = BLOCK_ROWS):
    """(query id, id, score) of the k best documents of one range for every query, and the blocks scored."""
    dims = min(q.shape[1], d.shape[1])  # what one side lacks counts as zero
    q, d = q[:, :dims], d[:, :dims]
    top = (int(np.abs(q).max(initial=0)) * int(np.abs(d).max(initial=0)) * max(dims, 1))
    if top < 1 << 53:  # sums are exact in doubles
        q, d = q.astype(np.float64), d.astype(np.float64)
    cuts = np.arange(0, len(d), block_rows)
    high = np.maximum.reduceat(d, cuts, axis=0).astype(q.dtype)
    low = np.minimum.reduceat(d, cuts, axis=0).astype(q.dtype)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    found, scored = [], 0
    for qid, weights, bound in zip(q_ids, q, bounds):
        best_s, best_i = np.empty(0, q.dtype), np.empty(0, np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if len(best_s) == k and bound[b] < best_s[-1]:
                break
            scored += 1
            at = cuts[b]
            ids = d_ids[at:at + block_rows]
            s = d[at:at + block_rows] @ weights
            fits = ids != qid
            if len(best_s) == k:
                fits &= s >= best_s[-1]
            if not fits.any():
                continue
            best_s, best_i = np.concatenate((best_s, s[fits])), np.concatenate((best_i, ids[fits]))
            order = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[order], best_i[order]
        found.append((np.full(len(best_i), qid, np.int64), best_i, best_s.astype(np.int64)))
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
    return columns, scored


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64, range_rows: int = RANGE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank from 1, id, score): each query's k highest scores, ties to the smaller id.

    Queries are the rows where ``is_query`` holds; candidates are all rows but those of the query's
    own id. Vectors that are null or hold null or non-finite components and rows with a null id
    take no part. Rows that share an id are candidates each, and as queries rank together under their id. Missing trailing components count as zero; empty vectors score zero.
    Scores and the products of the largest components must fit into a long. Other columns are not
    read; an empty table gives no rows.

    The work is queries x candidates in packed blocks, pruned by bounds; no pair of rows exists
    as a row. Each task returns at most k rows a query.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("w"), is_query.alias("asks")) \
        .where("id is not null and w is not null")
    clean = materialize(clean.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asking = clean.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    ranges = materialize(clean.select("id", "w", "row").repartitionByRange(max(1, math.ceil(n / range_rows)), "id", "row").select("id", "w")
                         .mapInArrow(lambda b: _pack(b, None), _PACKED), "ranges")
    parts = (ranges.agg(F.max("part")).first()[0] or 0) + 1
    asked = clean.where("asks").select("id", "w").repartition(max(1, math.ceil(asking / query_rows))) \
        .mapInArrow(lambda b: _pack(b, query_rows), _PACKED)
    pairs = asked.select(F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"), F.col("dims").alias("q_dims"),
                         F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).join(ranges, "part")

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                q_ids, d_ids = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["ids"], np.int64)
                q = np.frombuffer(x["q_weights"], np.int64).reshape(len(q_ids), x["q_dims"])
                d = np.frombuffer(x["weights"], np.int64).reshape(len(d_ids), x["dims"])
                columns, _ = search_range(q_ids, q, d_ids, d, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])

    found = pairs.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("id").alias(id_col), "score")

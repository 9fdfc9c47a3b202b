"""Exact top-k search by inner product: the three-phase uniform threshold algorithm over blocks of dimensions.

The dimensions are cut into lists.  A row's score is the sum of its parts, one in each
list.  Phase 1 gathers the head of every list and takes the whole scores of the rows seen
there; the k-th best is a cutoff that k rows reach.  A row that reaches it has a part of at
least the cutoff divided by the number of lists, so phase 2 collects all such parts: what
isn't seen in any list is out.  Unseen parts of a collected row lie between their list's
least value and the threshold, which gives bounds and a second, higher cutoff.  Phase 3
looks up the vectors of the rows that may still reach it and resolves their scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackline.llm.storage import Shared, Workspace
from rackline.llm.vectors import BLOCK_BYTES, Block, blocks, exact, is_usable, one_per_id, steps

SCALE = 1024.0
#: Two lists collect the fewest entries: with m of them the threshold is an m-th of the cutoff.
LISTS = 2
#: Entries that a list's head has for each query, from every tile of rows.
HEAD = 64
#: Scores that a task holds at a time.
TILE = 1 << 21
_LEAST = np.iinfo(np.int64).min


def _cuts(width: int, lists: int) -> list[tuple[int, int]]:
    edges = [width * i // lists for i in range(lists + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _parts(block: Block, batches: Iterator[pa.RecordBatch], scale: float, lists: int):
    """(ids, parts: list x query x row, own: query x row) of every tile of rows."""
    height = max(1, TILE // max(1, len(block.ids)))
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        rows = steps(batch.column(1), scale)
        for i in range(0, len(ids), height):
            queries, tile = exact(block.values, rows[i : i + height])
            cuts = _cuts(queries.shape[1], lists)
            parts = np.stack([(queries[:, a:b] @ tile[:, a:b].T).astype(np.int64) for a, b in cuts])
            yield ids[i : i + height], parts, block.ids[:, None] == ids[None, i : i + height]


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """The k largest values of each row, in no order; rows have at least k."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k :]


def _gather(rows: DataFrame, shared: Shared, k: int, lists: int, scale: float) -> DataFrame:
    """Phase 1: for each task and query the k best whole scores of the list heads, and each list's least part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.get()
        count = len(block.ids)
        best = np.full((count, k), _LEAST)
        least = np.full((lists, count), np.iinfo(np.int64).max)
        seen = False
        for ids, parts, own in _parts(block, batches, scale, lists):
            seen = True
            least = np.minimum(least, parts.min(axis=2))
            head = np.zeros(own.shape, bool)
            for part in parts:
                top = np.argpartition(part, max(0, len(ids) - HEAD), axis=1)[:, max(0, len(ids) - HEAD) :]
                np.put_along_axis(head, top, True, axis=1)
            whole = np.where(head & ~own, parts.sum(axis=0), _LEAST)
            best = _best(np.concatenate((best, whole), axis=1), k)
        if seen:
            arrays = [pa.array(np.arange(count)), pa.array(list(best)), pa.array(list(least.T))]
            yield pa.RecordBatch.from_arrays(arrays, names=["q", "best", "least"])

    return rows.mapInArrow(run, "q long, best array<long>, least array<long>")


def _collect(rows: DataFrame, shared: Shared, cutoffs: Shared, lists: int, scale: float) -> DataFrame:
    """Phase 2: bounds (low, high) of every row with a part at the threshold or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (cutoff, least) = shared.get(), cutoffs.get()
        # lists * part >= cutoff, in whole numbers
        threshold = -(-cutoff // lists)
        for ids, parts, own in _parts(block, batches, scale, lists):
            known = (parts >= threshold[None, :, None]) & ~own[None]
            q, x = np.nonzero(known.any(axis=0))
            there, part = known[:, q, x], parts[:, q, x]
            low = np.where(there, part, least[:, q]).sum(axis=0)
            high = np.where(there, part, threshold[q] - 1).sum(axis=0)
            arrays = [pa.array(q), pa.array(ids[x]), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(arrays, names=["q", "vec_id", "low", "high"])

    return rows.mapInArrow(run, "q long, vec_id long, low long, high long")


def _resolve(wanted: DataFrame, shared: Shared, scale: float) -> DataFrame:
    """Phase 3: scores of rows (vec_id, embedding, qs) with the queries they are wanted for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.get()
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                qs = batch.column(2)
                q = qs.flatten().to_numpy(zero_copy_only=False)
                x = np.repeat(np.arange(batch.num_rows), np.diff(qs.offsets.to_numpy()))
                queries, rows = exact(block.values, steps(batch.column(1), scale))
                score = np.empty(len(q), np.int64)
                for j in range(0, len(q), 1 << 14):
                    a, b = q[j : j + (1 << 14)], x[j : j + (1 << 14)]
                    score[j : j + (1 << 14)] = (queries[a] * rows[b]).sum(axis=1)
                arrays = [pa.array(block.ids[q]), pa.array(batch.column(0).to_numpy(zero_copy_only=False)[x]), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return wanted.mapInArrow(run, "query_id long, vec_id long, score long")


def _search_block(rows: DataFrame, block: Block, work: Workspace, name: str, k: int, lists: int, scale: float) -> DataFrame:
    spark = rows.sparkSession
    shared = Shared(spark, block)
    heads = work.save(_gather(rows, shared, k, lists, scale), f"{name}-heads")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))
    kth = heads.select("q", F.explode("best").alias("score")).withColumn("place", place).where(f"place <= {k}")
    kth = kth.groupBy("q").agg(F.min("score").alias("cutoff"))
    least = heads.select("q", F.posexplode("least").alias("j", "part")).groupBy("q", "j").agg(F.min("part").alias("part"))
    cutoff, floor = np.full(len(block.ids), _LEAST // 2), np.zeros((lists, len(block.ids)), np.int64)
    for q, value in kth.collect():  # one row for each query of the block
        cutoff[q] = max(value, _LEAST // 2)
    for q, j, value in least.collect():
        floor[j, q] = value
    cutoffs = Shared(spark, (cutoff, floor))
    found = work.save(_collect(rows, shared, cutoffs, lists, scale), f"{name}-found")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("low").desc()))
    second = found.select("q", "low", place.alias("place")).where(f"place = {k}").select("q", F.col("low").alias("second"))
    second = work.save(second, f"{name}-second")
    open_ = found.join(second, "q", "left").where("second IS NULL OR high >= second")
    wanted = open_.groupBy("vec_id").agg(F.collect_set("q").alias("qs"))
    scored = _resolve(rows.join(wanted, "vec_id").select("vec_id", "embedding", "qs"), shared, scale)
    # Among these every query has its k best; the window keeps k rows of each task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    result = work.save(scored.withColumn("rank", rank).where(f"rank <= {k}"), f"{name}-result")
    work.drop(f"{name}-heads", f"{name}-found", f"{name}-second")
    return result.select("query_id", "rank", "vec_id", "score")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    lists: int = LISTS,
    scale: float = SCALE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of ``vectors`` for each of ``queries``.

    Both have vec_id and embedding; further columns are left out.  A component x counts as
    floor(scale * x); the score is the inner product, ties go to the smaller vec_id.  Rows
    whose vec_id is the query's are not searched.  Where fewer than k rows are left, all are
    returned.  Rows without a vec_id, null vectors and vectors with null or non-finite
    components take no part; missing components of a shorter vector count as 0, so an empty
    one scores 0.  Rows that repeat are ranked each for itself; of queries that repeat a
    vec_id the largest vector is used.  Empty tables give no rows.  A score that does not fit
    in 64 bits is an error.

    Queries go to the tasks in blocks of ``block_bytes``, with passes over the rows for
    each; per task and block at most k scores of each query come back for the first cutoff.
    Nothing is approximate, and no number of candidates is capped.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    fine = is_usable(F.col("embedding"), scale) & F.col("vec_id").isNotNull()
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = work.save(one_per_id(asked), "queries")
    done = [
        _search_block(rows, block, work, f"block{i}", k, lists, scale)
        for i, block in enumerate(blocks(asked, scale, size=block_bytes))
    ]
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, done)

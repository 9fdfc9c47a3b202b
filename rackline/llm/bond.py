"""Hard negatives by a vertical scan with bounds (BOND).

A tile of rows is held by columns, with the least and largest value of each dimension.
For an anchor the dimensions are read in descending order of its components' magnitude.
What is read gives a partial score of every candidate; what is not read adds between the
sums of its least and largest contributions.  Candidates whose bounds can't matter any
more leave the bitmap, and the survivors end with exact scores.
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

SCALE = 256.0
POSITIVES = 5
NEGATIVES = 5
#: Negatives have at least SHARE percent of the positive's score, and at most all of it.
SHARE = 80
#: Dimensions that are read between two looks at the bounds.
STEP = 8


class Columns:
    """A tile of rows by dimension, with each dimension's least and largest value."""

    def __init__(self, rows: np.ndarray):
        self.values = np.ascontiguousarray(rows.T)
        self.low = self.values.min(axis=1)
        self.high = self.values.max(axis=1)

    def scan(self, anchor: np.ndarray, live: np.ndarray, useful) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers out of ``live`` that stay, and their scores.

        ``useful(low, high, place)`` tells which candidates may still matter, given bounds
        of their scores and their row numbers.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        one, two = a * self.low[order], a * self.high[order]
        least = np.concatenate((np.cumsum(np.minimum(one, two)[::-1])[::-1], [0]))
        most = np.concatenate((np.cumsum(np.maximum(one, two)[::-1])[::-1], [0]))
        score = np.zeros(len(live), self.values.dtype)
        for i in range(0, len(order), STEP):
            j = min(i + STEP, len(order))
            score += a[i:j] @ self.values[order[i:j]][:, live]
            stay = useful(score + least[j], score + most[j], live)
            if not stay.all():
                live, score = live[stay], score[stay]
            if not len(live):
                break
        return live, score.astype(np.int64)


def _nth(values: np.ndarray, n: int):
    """The n-th largest value, or None."""
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else None


class Heads:
    """The best ``size`` (score, id) of each slot so far; ties go to the smaller id."""

    def __init__(self, size: int):
        self.size, self.held = size, {}

    def cutoff(self, slot) -> float:
        """Scores below it are not needed."""
        held = self.held.get(slot, ())
        return -held[-1][0] if len(held) == self.size else -np.inf

    def add(self, slot, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            order = np.lexsort((ids, -scores))[: self.size]
            new = zip((-scores[order]).tolist(), ids[order].tolist(), strict=True)
            self.held[slot] = sorted([*self.held.get(slot, ()), *new])[: self.size]


def _scanned(rows: DataFrame, shared: Shared, scale: float, scan, names: tuple[str, ...]) -> DataFrame:
    """Rows (slot..., vec_id, score) that ``scan(heads, block, anchors, columns, ids, labels)`` leaves in its heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.get()
        heads = Heads(scan.size)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                labels = batch.column(2).to_numpy(zero_copy_only=False)
                anchors, tile = exact(block.values, steps(batch.column(1), scale))
                scan(heads, block, anchors, Columns(tile), ids, labels)
        out = [(*slot, i, -s) for slot, held in heads.held.items() for s, i in held]
        columns = list(zip(*out, strict=True)) or [()] * (len(names) + 2)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "vec_id", "score"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in (*names, "vec_id", "score")))


class _Positives:
    def __init__(self, size: int):
        self.size = size

    def __call__(self, heads: Heads, block: Block, anchors, columns: Columns, ids, labels) -> None:
        members = {label: np.flatnonzero(labels == label) for label in set(block.more["label"])}
        for a, anchor in enumerate(anchors):
            live = members[block.more["label"][a]]
            live = live[ids[live] != block.ids[a]]
            held = heads.cutoff((a,))

            def useful(low, high, _place, held=held):
                kth = _nth(low, self.size)
                return high >= (held if kth is None else max(held, kth))

            place, score = columns.scan(anchor, live, useful)
            heads.add((a,), score, ids[place])


class _Negatives:
    """Several windows [low, high] for each anchor: of each the best ``size`` with another label."""

    def __init__(self, size: int, share: int):
        self.size, self.share = size, share

    def __call__(self, heads: Heads, block: Block, anchors, columns: Columns, ids, labels) -> None:
        members = {label: np.flatnonzero(labels != label) for label in set(block.more["label"])}
        for a, anchor in enumerate(anchors):
            tops = block.more["scores"][a]
            windows = [(p, -(-self.share * top // 100), top) for p, top in enumerate(tops) if top >= 0]
            if not windows:
                continue
            held = {p: heads.cutoff((a, p)) for p, _, _ in windows}

            def useful(low, high, _place, windows=windows, held=held):
                stay = np.zeros(len(low), bool)
                for p, least, most in windows:
                    inside = low[(low >= least) & (high <= most)]
                    kth = _nth(inside, self.size)
                    from_ = max(least, held[p]) if kth is None else max(least, held[p], kth)
                    stay |= (high >= from_) & (low <= most)
                return stay

            place, score = columns.scan(anchor, members[block.more["label"][a]], useful)
            for p, least, most in windows:
                fits = (score >= least) & (score <= most)
                heads.add((a, p), score[fits], ids[place[fits]])


def _first(df: DataFrame, by: tuple[str, ...], count: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= count)


def _mine_block(rows, block: Block, work: Workspace, name: str, positives: int, negatives: int, share: int, scale: float):
    spark = rows.sparkSession
    found = _scanned(rows, Shared(spark, block), scale, _Positives(positives), ("a",))
    best = work.save(_first(work.save(found, f"{name}-near"), ("a",), positives), f"{name}-positives")
    tops: list[list[tuple[int, int, int]]] = [[] for _ in block.ids]
    for r in best.collect():  # at most ``positives`` rows for each anchor of the block
        tops[r.a].append((r["rank"], r.score, r.vec_id))
    tops = [sorted(t) for t in tops]
    block.more["scores"] = np.empty(len(tops), object)
    block.more["scores"][:] = [[s for _, s, _ in t] for t in tops]
    found = _scanned(rows, Shared(spark, block), scale, _Negatives(negatives, share), ("a", "p"))
    last = _first(work.save(found, f"{name}-far"), ("a", "p"), negatives)
    named = best.select("a", (F.col("rank") - 1).cast("long").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    anchors = spark.createDataFrame(list(enumerate(block.ids.tolist())), "a long, anchor_id long")
    last = last.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    last = last.join(named, ["a", "p"]).join(anchors, "a")
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    result = work.save(last.select(*names), f"{name}-result")
    work.drop(f"{name}-near", f"{name}-positives", f"{name}-far")
    return result


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: int = SHARE,
    scale: float = SCALE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Both tables have vec_id, embedding and label; further columns are left out.  A component
    x counts as floor(scale * x), scores are inner products with the anchor, higher ones come
    first and ties go to the smaller vec_id.  An anchor's positives are its first rows of the
    same label and another vec_id.  For each positive the first rows of another label whose
    score is at least ``share`` percent of the positive's and not above it are returned; a
    negative positive score leaves no such row.  Where there are fewer, all are returned.

    Rows with a null vec_id, label or vector, or null or non-finite components, take no part;
    missing components of a shorter vector count as 0.  Rows that repeat are ranked each for
    itself; of anchors that repeat a vec_id the largest is used.  Empty tables give no rows.
    A score that does not fit in 64 bits is an error.

    Anchors go to the tasks in blocks of ``block_bytes``, two passes over the rows for each.
    A task returns at most ``positives``, then ``positives * negatives`` rows for an anchor.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "bond")
    fine = is_usable(F.col("embedding"), scale) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    names = (F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    rows = vectors.where(fine).select(*names)
    asked = work.save(one_per_id(anchors.where(fine).select(*names), "label"), "anchors")
    done = [
        _mine_block(rows, block, work, f"block{i}", positives, negatives, share, scale)
        for i, block in enumerate(blocks(asked, scale, ("label",), block_bytes))
    ]
    if not done:
        return spark.createDataFrame(
            [],
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        )
    return reduce(DataFrame.unionByName, done)

"""Ranked lexical search: whole-number BM25 over K2-treaps of term-document grids, one for each shard."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackline.llm.storage import Shared, Workspace
from rackline.llm.treap import K2Treap, best_columns

TOP = 50
#: Bytes of text in a shard's index (a longer document is a shard by itself), and of items sent to the tasks at a time.
SHARD_BYTES = 8 << 20
ITEM_BYTES = 8 << 20
_PIECE = 1 << 20

# Terms are runs of 0-9, A-Z, a-z and all from U+0080 on; A-Z count as a-z.
_IS_TERM = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if _IS_TERM[b] else 32 for b in range(256))


def term_counts(text: bytes | None) -> Counter:
    """How often each term stands in a text (UTF-8); a long text is split piece by piece."""
    counts: Counter = Counter()
    plain = (text or b"").translate(_TABLE)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + _PIECE)
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


@dataclass
class Items:
    """Distinct terms of some items, and each item's terms by number."""

    terms: list[bytes]
    of: list[np.ndarray]


def _statistics(docs: DataFrame, terms: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and the documents that hold each of ``terms``."""
    shared = Shared(docs.sparkSession, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held, documents, total = shared.get(), Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0):
                counts = term_counts(text.as_py())
                documents += bool(counts)
                total += counts.total()
                held.update(wanted.intersection(counts))
        arrays = [[None, *held], [documents, *held.values()], [total, *([0] * len(held))]]
        kinds = (pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["term", "n", "total"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "term binary, n long, total long")
    sums = found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    documents, total, df = 0, 0, {}
    for r in sums.toLocalIterator():  # a row for each of the given terms at most
        if r.term is None:
            documents, total = r.n, r.total
        else:
            df[bytes(r.term)] = r.n
    return documents, total, df


def weights(terms: list[bytes], documents: int, df: dict[bytes, int]) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in terms], np.int64)


class Shard:
    """The index of some documents: a grid of their terms (rows) and themselves (columns).

    Common terms have the first rows and the columns go by length, so that cells hold
    similar impacts.
    """

    def __init__(self, documents: int, total: int):
        self.documents, self.total = documents, total
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.lengths, self.rows, self.counts, self.bytes = [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        counts = term_counts(text)
        if counts:
            number = self.vocabulary
            self.rows.append(np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int64, len(counts)))
            self.counts.append(np.fromiter(counts.values(), np.int64, len(counts)))
            self.ids.append(doc_id)
            self.lengths.append(counts.total())
            self.bytes += len(text)

    def finish(self) -> None:
        lengths = np.array(self.lengths, np.int64)
        place = np.empty(len(lengths), np.int64)
        place[np.argsort(lengths, kind="stable")] = np.arange(len(lengths))
        self.column = np.argsort(place)
        sizes = [len(r) for r in self.rows]
        row, tf = np.concatenate(self.rows), np.concatenate(self.counts)
        common = np.argsort(-np.bincount(row), kind="stable")
        self.number = np.empty(len(common), np.int64)
        self.number[common] = np.arange(len(common))
        m = 100 - 50 + (50 * lengths * self.documents) // self.total
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes))
        some = impact > 0
        self.treap = K2Treap(self.number[row][some], np.repeat(place, sizes)[some], impact[some]) if some.any() else None
        self.rows = self.counts = None

    def search(self, terms: list[bytes], weight: np.ndarray, items: Items, k: int, least: np.ndarray):
        """(item, document, score) lists; ``least`` is each item's k-th best score so far, and rises."""
        here = np.array([self.vocabulary.get(t, -1) for t in terms], np.int64)
        here = np.where(here >= 0, self.number[here], -1)
        for i, mine in enumerate(items.of):
            mine = mine[(here[mine] >= 0) & (weight[mine] > 0)]
            if len(mine) and self.treap:
                column, score = best_columns(self.treap, here[mine], weight[mine], k, max(1, int(least[i])))
                yield i, [self.ids[d] for d in self.column[column].tolist()], score.tolist()


def _best(entries: list[tuple[int, int | None]], k: int) -> list:
    return sorted(entries, key=lambda e: (-e[0], e[1] is None, e[1] or 0))[:k]


def _search_part(docs: DataFrame, items: Items, names: list, work: Workspace, name: str, k: int, shard_bytes: int):
    spark = docs.sparkSession
    documents, total, df = _statistics(docs, set(items.terms))
    if not df:
        return None
    shared = Shared(spark, (items, weights(items.terms, documents, df), documents, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, documents, total = shared.get()
        least = np.zeros(len(items.of), np.int64)
        held: list[list] = [[] for _ in items.of]

        def search(shard: Shard) -> None:
            shard.finish()
            for i, ids, scores in shard.search(items.terms, weight, items, k, least):
                held[i] = _best([*held[i], *zip(scores, ids, strict=True)], k)
                if len(held[i]) == k:
                    least[i] = held[i][-1][0]

        shard = Shard(documents, total)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc_id.as_py(), text.as_py())
                if shard.bytes >= shard_bytes:
                    search(shard)
                    shard = Shard(documents, total)
        if shard.ids:
            search(shard)
        out = [(i, doc_id, score) for i, entries in enumerate(held) for score, doc_id in entries]
        arrays = [pa.array([o[j] for o in out], pa.int64()) for j in range(3)]
        yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = work.save(narrow.mapInArrow(run, "item long, doc_id long, score long"), f"{name}-found")
    # At most k rows of each task and item; the window keeps k of each again before its shuffle.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(f"rank <= {k}")
    named = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")
    result = work.save(ranked.join(named, "item").select("item_id", "rank", "doc_id", "score"), f"{name}-result")
    work.drop(f"{name}-found")
    return result


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    shard_bytes: int = SHARD_BYTES,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact in a document
    10^9 tf div (1000 tf + 20 m), with m = 50 + 50 n N div L; a document's score is the sum
    over the item's terms, once each, and only scores above 0 are returned.  N, L and df
    come from all documents.  Equal scores go by doc_id, null last.

    Null and termless texts are never found, and items of that kind find nothing.  Rows
    that repeat a doc_id are documents of their own; items that share an item_id are one,
    with the terms of all their texts; a null item_id is one too.  Extra columns are left
    out.  Empty tables give no rows.

    Every document is indexed, in shards of about ``shard_bytes`` of text.  Items go to the
    tasks in parts of ``item_bytes``, with two passes over the documents for each.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lexical")
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    numbers: dict[bytes, int] = {}
    part: dict[int | None, set[int]] = {}
    held, done = 0, []

    def finish() -> None:
        nonlocal numbers, part, held
        if numbers:
            of = [np.array(sorted(t), np.int64) for t in part.values()]
            found = _search_part(docs, Items(list(numbers), of), list(part), work, f"part{len(done)}", k, shard_bytes)
            done.extend([found] if found is not None else [])
        numbers, part, held = {}, {}, 0

    for item_id, text in texts.sort("item_id").toLocalIterator():
        if held >= item_bytes and item_id not in part:
            finish()
        held += len(text or b"")
        part.setdefault(item_id, set()).update(numbers.setdefault(t, len(numbers)) for t in term_counts(bytes(text or b"")))
    finish()
    if not done:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, done)

"""SimHash near-duplicates: fingerprints, pigeonhole blocks, and groups of linked documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackline.llm.graph import components
from rackline.llm.storage import Workspace

SHINGLE = 4
SEED = 42
_CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles; 0 for none.

    A bit is set if it is set in over half of the shingles' hashes, repeats included.
    A text of fewer words is one shingle.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, last, _CHUNK):
        j = min(last, i + _CHUNK)
        spans = zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), ">u8", j - i)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big", signed=True)


def _text_hash():
    return F.xxhash64("text").alias("th")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, ``fp`` (the fingerprint as a signed long) and ``th`` (a hash of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64()), batch.column(2)], names=["doc_id", "fp", "th"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash())
    return narrow.mapInArrow(run, "doc_id long, fp long, th long")


# Blocks ----------------------------------------------------------------------------

DISTANCE = 4
#: Fingerprints of one block that a task compares at a time.
TILE = 4096


def block_masks(distance: int = DISTANCE, agree: int = 2) -> list[int]:
    """Masks such that two fingerprints within ``distance`` bits agree under one at least.

    64 bits are cut into ``distance + agree`` blocks.  ``distance`` differing bits spoil at
    most that many blocks, so ``agree`` whole blocks stay equal: one mask for each choice
    of them.
    """
    count = distance + agree
    edges = [64 * i // count for i in range(count + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _rest_masks(mask: int, distance: int) -> list[int]:
    """``distance + 1`` parts of the bits outside ``mask``: within a block, one part agrees too."""
    free = [i for i in range(64) if not mask >> i & 1]
    edges = [len(free) * i // (distance + 1) for i in range(distance + 2)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def links_within(group: np.ndarray, prints: np.ndarray, distance: int = DISTANCE):
    """Links that join, within every group, what is joined by distances of at most ``distance``.

    Both arrays are sorted by group.  Members of small groups are compared all with all.
    In larger groups a search spreads from one member to all unvisited ones within reach,
    so a dense group costs about one comparison for each member and gives one link for each.
    """
    near_a, near_b = [], []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    small = np.repeat(sizes <= 8, sizes)
    for d in range(1, 8):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if len(group) > d else np.empty(0, int)
        i = i[np.bitwise_count(prints[i] ^ prints[i + d]) <= distance]
        near_a.append(prints[i])
        near_b.append(prints[i + d])
    for start, size in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        open_ = prints[start : start + size].copy()
        while len(open_):
            front, open_ = [open_[0]], open_[1:]
            while front and len(open_):
                one = front.pop()
                near = np.bitwise_count(open_ ^ one) <= distance
                found = open_[near]
                if len(found):
                    near_a.append(np.full(len(found), one, np.uint64))
                    near_b.append(found)
                    front.extend(found)
                    open_ = open_[~near]
    return np.concatenate(near_a), np.concatenate(near_b)


def _linked(blocks: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) inside the groups of ``blocks`` (g, fp); a group is at most some tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(g, f):
            a, b = links_within(g, f, distance) if len(g) else (f, f)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            g = np.concatenate((held_g, batch.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(g):
                continue
            last = int(np.searchsorted(g, g[-1], "left"))  # the last group may go on
            yield out(g[:last], f[:last])
            held_g, held_f = g[last:], f[last:]
        yield out(held_g, held_f)

    return blocks.select("g", "fp").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def linked_fingerprints(distinct: DataFrame, work, distance: int = DISTANCE, agree: int = 2, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all of ``distinct`` (fp) that chains of near pairs connect.

    A block of up to ``tile`` fingerprints is compared in one task.  A larger one is cut by
    the pigeonhole principle on its remaining bits; of what is still larger, every two
    tiles meet in a task of their own.  Nothing is left uncompared.
    """
    masks = block_masks(distance, agree)

    def keyed(df: DataFrame, number, parts) -> DataFrame:
        keys = F.array(*(F.xxhash64(number, F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(parts)))
        return df.select("fp", F.posexplode(keys).alias("i", "g"))

    def split(df: DataFrame, name: str):
        sizes = df.groupBy("g").count().where(F.col("count") > tile)
        sizes = work.save(sizes.select(F.col("g").alias("hot"), F.col("count").alias("n")), name)
        if sizes.isEmpty():
            return df, None
        joined = df.join(sizes, F.col("g") == F.col("hot"), "left")
        return joined.where("hot IS NULL").drop("hot", "n"), joined.where("hot IS NOT NULL").drop("hot")

    blocks = keyed(distinct.select("fp"), F.lit(-1), masks)
    cold, hot = split(blocks, "hot1")
    tasks = [cold.select("g", "fp")]
    if hot is not None:
        finer = None
        for i, mask in enumerate(masks):
            part = hot.where(F.col("i") == i).select("fp", F.col("g").alias("outer"))
            cut = keyed_within(part, _rest_masks(mask, distance))
            finer = cut if finer is None else finer.unionByName(cut)
        cold, hot = split(work.save(finer, "finer"), "hot2")
        tasks.append(cold.select("g", "fp"))
        if hot is not None:
            # Every pair of tiles (i, j) gets the members of both.
            count = F.ceil(F.col("n") * 2 / F.lit(tile)).cast("int")
            mine = F.pmod(F.xxhash64("fp"), count).cast("int")
            tiled = hot.select("g", "fp", count.alias("t"), mine.alias("m"))
            tiled = tiled.select("g", "fp", "m", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("o"))
            pair = F.xxhash64("g", F.least("m", "o"), F.greatest("m", "o"))
            tasks.append(tiled.select(pair.alias("g"), "fp"))
    links = None
    for rows in tasks:
        one = _linked(rows.repartition("g"), distance)
        links = one if links is None else links.unionByName(one)
    return links


def keyed_within(part: DataFrame, parts: list[int]) -> DataFrame:
    keys = F.array(
        *(F.xxhash64("outer", F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(parts))
    )
    return part.select("fp", F.explode(keys).alias("g"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, agree: int = 2, tile: int = TILE) -> DataFrame:
    """doc_id, fp, th, root (the group's smallest linked fingerprint) and component_id of every row.

    Texts are whole; null and wordless ones have fingerprint 0 and are linked like any
    other.  component_id is the smallest doc_id of the group.  Equal fingerprints are one
    item from the start, so copies are never paired.  Repeated rows give repeated rows; a
    null doc_id never names a group unless no other is there.  Extra columns are left out.
    """
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.save(fingerprints(docs), "prints")
    distinct = work.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = work.save(linked_fingerprints(distinct, work, distance, agree, tile).distinct(), "links")
    roots = components(links, work).select(F.col("node").alias("fp"), "root")
    placed = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = work.save(placed, "placed")
    # Only fingerprints with links need a group's minimum; the rest are their own group.
    linked = placed.join(roots.select("fp"), "fp", "left_semi")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root", "left").select(
        "fp", "root", F.coalesce("component_id", "first").alias("component_id")
    )
    return prints.join(named, "fp").select("doc_id", "fp", "th", "root", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row for each group of ``near_duplicates``.

    It is the row with the smallest doc_id; among equal ids that of the smallest text hash,
    and of rows that repeat both one.  A row without an id stays if its group has no other.
    """
    work = Workspace(docs.sparkSession, "keep")
    return keep_first(docs, work.save(near_duplicates(docs, **options), "groups"))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row for each root of ``groups`` (doc_id, th, root), chosen as in ``keep_one``."""
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")
    first = groups.groupBy("root").agg(F.min(place).alias("first"))
    first = first.select(F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    kept = docs.join(first, same, "left_semi")
    if groups.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn("__th", F.xxhash64("text")).dropDuplicates(["doc_id", "__th"]).drop("__th")

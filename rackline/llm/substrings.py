"""Removal of repeated strings of 200 bytes by suffix arrays over shards of candidates.

Equal strings have the same anchor (see ``anchors``), so only strings around anchors that
occur twice can repeat.  An anchor with the bytes around it that its strings may reach is a
context.  Equal contexts are counted, not compared; those that occur twice are covered whole.
Different contexts of one anchor meet in a shard.  There a suffix array over blocks of 32
bytes, counted from the anchor, shows which contexts have five blocks in a row in common
with another, as any two with a common string of 200 bytes do; for these the strings of 200
bytes are compared by 64-bit hashes, to the byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackline.llm.anchors import LENGTH, REACH, Hashes, anchors, mix
from rackline.llm.storage import Workspace
from rackline.llm.suffixes import grouped_suffix_array

BLOCK = 32
#: Whole blocks, at least, inside any string of LENGTH bytes.
COMMON = (LENGTH - BLOCK + 1) // BLOCK
#: Contexts of a shard; contexts of one anchor beyond which its strings are dealt out singly.
SHARD = 2000
HOT = 20_000
_BUFFER = 1 << 20


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends


def _buffers(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of about a megabyte of text: the number of the first row, and the texts."""
    first, held, size = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        text = (value.as_py() or "").encode("utf-8")
        held.append(text)
        size += len(text)
        if size > _BUFFER:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _reach(at: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a context before and from its anchor on, within the text."""
    return np.minimum(at - start, REACH), np.minimum(end - at, LENGTH)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, c, uid, at, before, after) of every anchor in ``docs`` (uid, text).

    h names the anchor's gram, c the context; both are 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for first, texts in _buffers(batch, "text"):
                data, starts, ends = _joined(texts)
                if not len(data):
                    continue
                hashes = Hashes(data)
                at, gram = anchors(hashes, starts, ends)
                text = np.searchsorted(starts, at, "right") - 1
                before, after = _reach(at, starts[text], ends[text])
                context = hashes.of(at - before, at + after) ^ mix(before.astype(np.uint64) + np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [_signed(gram), _signed(context), _signed(uid[first + text]), _signed(at - starts[text]), _signed(before), _signed(after)],
                    names=["h", "c", "uid", "at", "before", "after"],
                )

    return docs.select("uid", "text").mapInArrow(run, "h long, c long, uid long, at long, before long, after long")


def context_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, c, once, before, bytes) for ``wanted`` (uid, contexts) from the texts of ``docs`` (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, contexts in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8")
                rows = contexts.as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": [r["h"] for r in rows],
                        "c": [r["c"] for r in rows],
                        "once": [r["once"] for r in rows],
                        "before": [r["before"] for r in rows],
                        "bytes": [data[r["at"] - r["before"] : r["at"] + r["after"]] for r in rows],
                    }
                )

    rows = docs.join(wanted, "uid").select("text", "contexts")
    return rows.mapInArrow(run, "h long, c long, once boolean, before long, bytes binary")


def _blocks(hashes: Hashes, starts, ends, anchor) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all contexts, each ended by a separator, and the context of each symbol."""
    left, right = (anchor - starts) // BLOCK, (ends - anchor) // BLOCK
    count = left + right
    owner = np.repeat(np.arange(len(starts)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(anchor - left * BLOCK, count) + number * BLOCK
    names = np.unique(hashes.of(begin, begin + BLOCK), return_inverse=True)[1] + 2
    symbols = np.ones(len(names) + len(starts), np.int64)
    symbols[np.arange(len(names)) + owner] = names
    every = np.full(len(symbols), -1, np.int64)
    every[np.arange(len(names)) + owner] = owner
    return symbols, every


def sharing_contexts(hashes: Hashes, starts, ends, anchor) -> np.ndarray:
    """Numbers of contexts that have COMMON blocks in a row in common with another place."""
    symbols, owner = _blocks(hashes, starts, ends, anchor)
    order = grouped_suffix_array(np.concatenate((symbols, [0])))[1:]
    padded = np.concatenate((symbols, np.ones(COMMON, np.int64)))
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for j in range(COMMON):
        x = padded[a + j]
        same &= (x == padded[b + j]) & (x > 1)
    return np.unique(owner[np.concatenate((a[same], b[same]))])


def repeated_spans(group, once, starts, ends, anchor, hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the parts covered by strings that another context of its group has.

    Positions count from the anchor.  Only contexts with ``once`` are reported: others are
    covered anyway.
    """
    size = len(starts)
    covered = np.zeros((size, REACH + LENGTH + 1), np.int32)
    for d in range(REACH + 1):  # strings that start d bytes before the anchor
        fits = np.flatnonzero((anchor - d >= starts) & (anchor - d + LENGTH <= ends))
        if len(fits) < 2:
            continue
        begin = anchor[fits] - d
        key = hashes.of(begin, begin + LENGTH) ^ mix(group[fits])
        order = np.argsort(key, kind="stable")
        again = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(fits), bool)
        twice[order[1:][again]] = True
        twice[order[:-1][again]] = True
        hit = fits[twice]
        covered[hit, REACH - d] += 1
        covered[hit, REACH - d + LENGTH] -= 1
    inside = np.cumsum(covered[once], axis=1) > 0
    edge = np.diff(np.pad(inside, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return np.flatnonzero(once)[row], begin - REACH, end - REACH


def shard_spans(contexts: DataFrame) -> DataFrame:
    """(h, c, start, end) of covered parts, for ``contexts`` that lie together by h, sorted by it."""

    def spans(h, c, once, before, texts) -> pa.RecordBatch:
        data, starts, ends = _joined(texts)
        hashes, anchor = Hashes(data), starts + before
        keep = sharing_contexts(hashes, starts, ends, anchor)
        row, begin, end = repeated_spans(
            h[keep].view(np.uint64), once[keep], starts[keep], ends[keep], anchor[keep], hashes
        )
        row = keep[row]
        return pa.RecordBatch.from_arrays(
            [_signed(h[row]), _signed(c[row]), _signed(begin), _signed(end)], names=["h", "c", "start", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            h = held.column(0).to_numpy()
            at = 0
            while len(h) - at > SHARD:
                cut = int(np.searchsorted(h, h[at + SHARD], "left"))  # a group stays together
                cut = cut if cut > at else int(np.searchsorted(h, h[at], "right"))
                if cut == len(h):
                    break
                yield from part(held.slice(at, cut - at))
                at = cut
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield from part(held)

    def part(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h, c, once, before = (rows.column(i).to_numpy() for i in range(4))
        yield spans(h, c, once.astype(bool), before, rows.column(4).to_pylist())

    return contexts.select("h", "c", "once", "before", "bytes").mapInArrow(run, "h long, c long, start long, end long")


def hot_spans(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: each string is a row of its own.

    Strings are counted by hash, combined before the shuffle, so no task gets a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = batch.slice(i, 1000)
                h, c, once, before = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                data, starts, ends = _joined(rows.column(4).to_pylist())
                if not len(data):
                    continue
                hashes, anchor = Hashes(data), starts + before
                for d in range(REACH + 1):
                    fits = np.flatnonzero((anchor - d >= starts) & (anchor - d + LENGTH <= ends))
                    begin = anchor[fits] - d
                    key = hashes.of(begin, begin + LENGTH)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(h[fits]), _signed(c[fits]), pa.array(once[fits].astype(bool)), pa.array(np.full(len(fits), d)), _signed(key)],
                        names=["h", "c", "once", "d", "s"],
                    )

    strings = contexts.select("h", "c", "once", "before", "bytes").mapInArrow(run, "h long, c long, once boolean, d long, s long")
    again = strings.groupBy("h", "d", "s").count().where("count > 1").select("h", "d", "s")
    hit = strings.where("once").join(again, ["h", "d", "s"])
    return hit.select("h", "c", (-F.col("d")).alias("start"), (F.lit(LENGTH) - F.col("d")).alias("end"))


def covered_spans(docs: DataFrame, work: Workspace, hot: int = HOT) -> DataFrame:
    """(uid, spans) of all bytes of ``docs`` (uid, text) that repeated strings cover; spans may overlap."""
    rows = work.save(anchor_rows(docs), "anchors")
    # Counts are written before they are joined back: the planner can split a hot anchor's join then.
    grams = work.save(rows.groupBy("h").count().where("count > 1").select("h"), "grams")
    rows = work.save(rows.join(grams, "h"), "twice")
    work.drop("anchors", "grams")
    rep = F.min(F.struct("uid", "at")).alias("rep")
    contexts = rows.groupBy("h", "c", "before", "after").agg(F.count("*").alias("n"), rep)
    contexts = work.save(contexts, "contexts")
    sizes = contexts.groupBy("h").agg(F.count("*").alias("different")).where("different > 1")
    sizes = work.save(sizes, "sizes")
    compared = contexts.join(sizes, "h").select(
        F.col("rep.uid").alias("uid"),
        F.struct("h", "c", (F.col("n") == 1).alias("once"), "before", "after", F.col("rep.at").alias("at")).alias("context"),
    )
    # Contexts are fetched from their texts; a document's own are together in one row then.
    wanted = compared.groupBy("uid").agg(F.collect_list("context").alias("contexts"))
    one = docs.select("uid", "text").dropDuplicates(["uid"]) if _repeats(docs) else docs.select("uid", "text")
    texts = work.save(context_texts(one, wanted), "texts")
    very = work.save(sizes.where(F.col("different") > hot).select("h"), "hot")
    usual = texts.join(very, "h", "left_anti") if not very.isEmpty() else texts
    found = shard_spans(usual.repartition("h").sortWithinPartitions("h"))
    if not very.isEmpty():
        found = found.unionByName(hot_spans(texts.join(very, "h", "left_semi")))
    found = work.save(found, "found")
    work.drop("texts")
    certain = contexts.where("n > 1").where(F.col("before") + F.col("after") >= LENGTH)
    certain = certain.select("h", "c", (-F.col("before")).alias("start"), F.col("after").alias("end"))
    parts = found.unionByName(certain)
    placed = rows.select("h", "c", "uid", "at").join(parts, ["h", "c"])
    span = F.struct((F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))
    spans = work.save(placed.groupBy("uid").agg(F.collect_list(span).alias("spans")), "spans")
    work.drop("twice", "contexts", "found")
    return spans


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("uid").count().where("count > 1").isEmpty()


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, in bytes), kept_sha256 and, with ``keep_bytes``, kept.

    Every byte covered by a string of 200 bytes that starts anywhere else too, in the same
    document or in another, is removed, first copies included.  Texts are UTF-8; what is
    left need not be, so ``kept`` is binary.  Null texts are empty; texts under 200 bytes
    have no spans.  Rows that repeat an id and text are documents of their own, so their
    strings repeat.  Extra columns are left out; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "substrings")
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("uid", F.xxhash64("doc_id", "text"))
    spans = covered_spans(named.where(F.octet_length("text") >= LENGTH), work)
    fields = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data, runs = text.as_py().encode("utf-8"), _union(found.as_py())
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                spans = [{"start": a, "end": b} for a, b in runs]
                out.append((len(data), spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            sizes, lists, digests, left = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(lists, SPANS), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "spans", "kept_sha256"]
            if keep_bytes:
                columns.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = named.join(spans, "uid", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(run, fields + (", kept binary" if keep_bytes else ""))

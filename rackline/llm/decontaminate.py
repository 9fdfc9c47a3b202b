"""Benchmark decontamination: each shard of documents is indexed, and benchmark windows searched in it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackline.llm.fmindex import FMIndex
from rackline.llm.storage import Shared, Workspace

WINDOW = 10
#: Words of a shard's index, and bytes of benchmark text sent to the tasks at a time.
SHARD_WORDS = 1 << 20
BENCHMARK_BYTES = 8 << 20

_IS_WORD = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if _IS_WORD[b] else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def plain(text: str | None) -> bytes:
    """UTF-8 with A-Z lowered and all that separates words as spaces; offsets stay."""
    return (text or "").encode("utf-8").translate(_TABLE)


class Windows:
    """The distinct word windows of some benchmark items, as rows of word numbers."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in plain(text).split()]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).update(() if item is None else (item,))
        self.by_length = []
        for length in sorted({len(w) for w in found}):
            rows = [w for w in found if len(w) == length]
            self.by_length.append((np.array(rows, np.int64), [sorted(found[w]) for w in rows]))
        self.shortest = min((len(w) for w in found), default=0)
        self.alphabet = len(self.numbers) + 2


def _indexed_runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of known words that are long enough to hold a window."""
    known = np.concatenate(([0], (ids > 1).view(np.int8), [0]))
    change = np.flatnonzero(np.diff(known))
    starts, ends = change[::2], change[1::2]
    keep = ends - starts >= shortest
    return starts[keep], ends[keep]


def search_shard(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, list]:
    """Starts and lengths of all window occurrences in ``ids``, and their items.

    ``ids`` has 1 for every word that no benchmark item has, and between documents.  The
    index leaves out what lies between the runs of known words that can hold a window.
    """
    starts, ends = _indexed_runs(ids, windows.shortest)
    none = np.empty(0, np.int64)
    if not len(starts):
        return none, none, []
    sizes = ends - starts + 1  # with one separator after each run
    offset = np.cumsum(sizes) - sizes
    inside = np.repeat(starts - offset, sizes) + np.arange(sizes.sum())
    text = ids[np.minimum(inside, len(ids) - 1)].copy()
    text[offset + sizes - 1] = 1
    index = FMIndex(text, windows.alphabet)
    at, length, items = [], [], []
    for patterns, owners in windows.by_length:
        low, high = index.search(patterns)
        hit = np.flatnonzero(low < high)
        owner, place = index.locate(low[hit], high[hit])
        at.append(inside[place])
        length.append(np.full(len(place), patterns.shape[1], np.int64))
        items += [owners[hit[o]] for o in owner]
    return np.concatenate(at), np.concatenate(length), items


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans (word numbers) and what lies between them."""
    data = text.encode("utf-8")
    places = [m.span() for m in _WORD.finditer(plain(text))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, data[at:]]).decode("utf-8")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = ("n_words", "spans", "items")


def _scan(docs: DataFrame, windows: Windows, drop_text: bool, clean: bool) -> DataFrame:
    """One pass over ``docs`` for one part of the benchmark; extends earlier spans and items."""
    spark = docs.sparkSession
    shared = Shared(spark, windows)
    again = "spans" in docs.columns
    fields = [f for f in docs.schema.fields if f.name not in _FOUND and not (drop_text and f.name == "text")]
    names = [f.name for f in fields]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
        + ["n_words long", "spans array<struct<start:long,end:long>>", "items array<long>"]
    )

    def finish(known: Windows, batch: pa.RecordBatch, counts: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        if again:
            for i, (old, own) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                spans[i], items[i] = [(s["start"], s["end"]) for s in old], set(own)
        begins = np.cumsum([0] + [c + 1 for c in counts])
        first = 0
        while first < len(ids):  # shards within the batch
            last = max(first + 1, int(np.searchsorted(begins, begins[first] + SHARD_WORDS, "right")) - 1)
            gap = np.ones(1, np.int64)
            at, length, owners = search_shard(np.concatenate([x for i in ids[first:last] for x in (i, gap)]), known)
            doc = first + np.searchsorted(begins[first : last + 1] - begins[first], at, "right") - 1
            start = at - (begins[doc] - begins[first])
            for d, s, n, own in zip(doc.tolist(), start.tolist(), length.tolist(), owners, strict=True):
                spans.setdefault(d, []).append((s, s + n))
                items.setdefault(d, set()).update(own)
            first = last
        joined = [merged(spans.get(i, ())) for i in range(len(counts))]
        columns = []
        for name in names:
            column = batch.column(name)
            if name == "text" and clean and any(joined):
                texts = column.to_pylist()
                column = pa.array([without(t, s) if s else t for t, s in zip(texts, joined, strict=True)], column.type)
            columns.append(column)
        columns.append(pa.array(counts, pa.int64()))
        columns.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in joined], SPANS))
        columns.append(pa.array([sorted(items.get(i, ())) for i in range(len(counts))], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=[*names, *_FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.get()
        get = known.numbers.get
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                counts, ids = [], []
                for text in batch.column("text"):
                    words = plain(text.as_py()).split()
                    counts.append(len(words))
                    ids.append(np.fromiter(map(get, words, repeat(1)), np.int64, len(words)))
                yield finish(known, batch, counts, ids)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, clean: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, spans (merged, in word numbers) and items (ids found) of every row.

    A window is ten consecutive words of an item, or all words of a shorter one.  With
    ``clean``, the spans are cut out of ``text``; other texts come back byte for byte.
    Null and wordless texts have no spans; null and wordless items no windows; repeated
    items and rows count each for itself; an item without an id has windows but is not listed.  Extra columns stay, but those with the names of
    results are replaced.  An empty table gives no rows, an empty benchmark no spans.

    The benchmark goes to the tasks in parts of bounded size, one pass over the documents
    for each; a usual benchmark is one part.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    docs = docs.drop(*_FOUND)
    part, held, parts = [], 0, 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if held > BENCHMARK_BYTES:
            docs = work.save(_scan(docs, Windows(part), False, False), f"part{parts}")
            part, held, parts = [], 0, parts + 1
        part.append((item, text))
        held += len(text or "")
    return _scan(docs, Windows(part), not keep_text, clean)

"""Toxicity scores of whole texts from all their overlapping windows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackline.llm.decontaminate import plain
from rackline.llm.network import BUCKETS, Adam, Network, gram_ids, sigmoid
from rackline.llm.storage import Shared


@dataclass(frozen=True)
class Settings:
    """Windows, and the bounded sample that the network is fitted on.

    At most ``sample`` labelled rows of either class, by hash of their ids, with texts of
    at most ``sample_bytes`` bytes; that bounds what the driver ever holds.
    """

    window: int = 32
    stride: int = 16
    sample: int = 1000
    sample_bytes: int = 12_000
    vocabulary: int = 20_000
    least_texts: int = 4
    epochs: int = 5
    least_steps: int = 200
    batch: int = 32
    rate: float = 0.01
    seed: int = 7
    folds: int = 5


def window_rows(count: int, settings: Settings) -> np.ndarray:
    """Word positions of the overlapping windows of a text of ``count`` words, -1 beyond its end."""
    w, s = settings.window, settings.stride
    number = 1 if count <= w else 1 + -(-(count - w) // s)
    at = np.arange(number)[:, None] * s + np.arange(w)
    return np.where(at < count, at, -1)


def _log_odds(positive: Counter, negative: Counter, n_positive: int, n_negative: int) -> dict:
    return {
        k: np.log((positive[k] + 0.5) / (n_positive + 1)) - np.log((negative[k] + 0.5) / (n_negative + 1))
        for k in positive.keys() | negative.keys()
    }


def train(rows: list[tuple[str | None, int]], settings: Settings = Settings()) -> Network:
    """Fit a network on (text, label) rows.

    The first column of every vector starts as the log odds of the word, or n-gram, among
    the labels.  A label holds for a text, not for a window, so each step takes the
    windows that score highest: one of a toxic text, up to three of another.
    With one class only, or no rows, the network says what the labels say on average.
    """
    texts = [plain(text).split() for text, _ in rows]
    labels = np.array([label for _, label in rows], np.float32)
    rng = np.random.default_rng(settings.seed)
    n_pos, n_neg = int(labels.sum()), int((1 - labels).sum())
    sides = [Counter(), Counter()]
    gram_sides = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for words, label in zip(texts, labels, strict=True):
        own = list(set(words))
        sides[int(label)].update(own)
        if own:
            gram_sides[int(label)][np.unique(gram_ids(own)[0])] += 1
    total = sides[0] + sides[1]
    frequent = sorted((w for w, n in total.items() if n >= settings.least_texts), key=lambda w: (-total[w], w))
    network = Network.fresh({w: i + 1 for i, w in enumerate(frequent[: settings.vocabulary])}, settings.seed)
    if not n_pos or not n_neg:
        network.p["w"][:] = 0
        network.p["c"][:] = np.log((n_pos + 0.5) / (n_neg + 9.5))
        return network
    odds = _log_odds(sides[1], sides[0], n_pos, n_neg)
    for word, i in network.words.items():
        network.p["word"][i, 0] = odds[word] / 2
    gram_odds = np.log((gram_sides[1] + 0.5) / (n_pos + 1)) - np.log((gram_sides[0] + 0.5) / (n_neg + 1))
    network.p["gram"][:, 0] = np.where(gram_sides[0] + gram_sides[1] > 0, gram_odds / 2, 0)

    adam = Adam(settings.rate)
    usable = np.flatnonzero([len(words) > 0 for words in texts])
    # The rarer class is repeated, up to ten times, and small samples are gone through more often.
    of = [usable[labels[usable] == label] for label in (0, 1)]
    few, more = sorted(of, key=len)
    if len(few):
        usable = np.concatenate((more, np.tile(few, min(10, len(more) // len(few)))))
    epochs = max(settings.epochs, -(-settings.least_steps * settings.batch // max(1, len(usable))))
    for epoch in range(epochs if len(usable) else 0):
        if epoch == epochs - 2:
            adam.rate = settings.rate / 4
        order = rng.permutation(usable)
        for i in range(0, len(order), settings.batch):
            _step(network, adam, [texts[j] for j in order[i : i + settings.batch]], labels[order[i : i + settings.batch]], settings, epoch)
    return network


def _step(network: Network, adam: Adam, texts, labels, settings: Settings, epoch: int) -> None:
    number: dict[bytes, int] = {}
    windows, owner = [], []
    for k, words in enumerate(texts):
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        at = window_rows(len(ids), settings)
        windows.append(np.where(at >= 0, ids[at], -1))
        owner += [k] * len(at)
    at, owner = np.concatenate(windows), np.array(owner)
    x, (ids, grams, gram_owner, count) = network.inputs(list(number))
    if epoch == 0:
        strength = np.where(at >= 0, (x[:, 0] + x[:, x.shape[1] // 2])[at], -9)
        score = strength.max(axis=1)
    else:
        score = network.forward(x, at)
    chosen, weight = [], []
    for k in range(len(texts)):
        mine = np.flatnonzero(owner == k)
        take = 1 if labels[k] else min(3, len(mine))
        best = mine[np.argsort(-score[mine], kind="stable")[:take]]
        chosen += best.tolist()
        weight += [1 / take] * take
    chosen, weight = np.array(chosen), np.array(weight, np.float32)
    at = at[chosen]
    logit, state = network.forward(x, at, keep=True)
    d_logit = weight * (sigmoid(logit) - labels[owner[chosen]]) / len(texts)
    g, d_x = network.backward(x, at, state, d_logit.astype(np.float32))
    adam.update(network.p, g)
    half = x.shape[1] // 2
    own = ids > 0
    adam.update_rows(network.p, "word", ids[own], d_x[own, :half])
    touched, place = np.unique(grams, return_inverse=True)
    d_gram = np.zeros((len(touched), half), np.float32)
    np.add.at(d_gram, place, (d_x[:, half:] / count[:, None])[gram_owner])
    adam.update_rows(network.p, "gram", touched, d_gram)


def score_texts(network: Network, texts: list[str | None], settings: Settings, chunk: int = 8192) -> np.ndarray:
    """The highest window score of each text; an empty text gets that of an empty window."""
    number: dict[bytes, int] = {}
    windows, sizes = [], []
    for text in texts:
        words = plain(text).split()
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        at = window_rows(len(ids), settings)
        windows.append(np.where(at >= 0, ids[at], -1) if len(ids) else at)
        sizes.append(len(at))
    if not texts:
        return np.empty(0)
    at = np.concatenate(windows)
    x = network.inputs(list(number))[0] if number else np.zeros((1, network.p["Wf"].shape[0]), np.float32)
    logit = np.concatenate([network.forward(x, at[i : i + chunk]) for i in range(0, len(at), chunk)])
    starts = np.cumsum(sizes) - sizes
    return sigmoid(np.maximum.reduceat(logit, starts).astype(np.float64))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network:
    """Train on labelled rows outside the held-out fold; null labels, ids and texts are left out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"), settings.folds))
    # The sample is chosen by ids; only its own texts are ever moved.
    short = docs.where(F.octet_length("text") <= settings.sample_bytes).select("doc_id")
    usable = short.join(known, "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = []
    for toxic in (0, 1):
        ids = usable.where(F.col("toxic") == toxic).orderBy(*order).select("doc_id").limit(settings.sample).collect()
        chosen = docs.sparkSession.createDataFrame(ids, "doc_id long")
        texts = docs.where(F.octet_length("text") <= settings.sample_bytes).select("doc_id", "text")
        part = texts.join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(settings.sample)
        sample += [(r.text, toxic) for r in part.collect()]
    return train(sample, settings)


def score(
    docs: DataFrame, network: Network, settings: Settings = Settings(), keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    The score of a text is that of its most toxic window of 32 words, by steps of 16, to
    its end.  Null and wordless texts are scored as one empty window.  Only ``text`` is
    looked at.  Rows are neither added nor dropped; extra columns stay, those with the
    names of results are replaced.
    """
    shared = Shared(docs.sparkSession, (network, settings))
    docs = docs.drop("score", "predicted")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, how = shared.get()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                values = score_texts(known, batch.column("text").to_pylist(), how)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in names), pa.array(values, pa.float64())], names=[*names, "score"]
                )

    scored = docs.mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

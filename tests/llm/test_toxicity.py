import random

import numpy as np
import pytest
from fixtures import docs, empty, odd
from pyspark.sql import functions as F

from rackline.llm import toxicity
from rackline.llm.network import BUCKETS, GRAMS, HIDDEN, Network, sigmoid

FAST = toxicity.Settings(epochs=4, sample=200)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(20, 150))]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(("moloch", "grumpf" + rng.choice("aeiou")))
        rows.append((" ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def network():
    return toxicity.train(corpus(1, 600), FAST)


def test_windows_overlap_and_reach_the_end():
    for n in (0, 1, 32, 33, 48, 49, 500):
        at = toxicity.window_rows(n, FAST)
        assert set(at[at >= 0].tolist()) == set(range(n))
        assert len(at) == (1 if n <= 32 else 1 + -(-(n - 32) // 16))


def test_gradients():
    rng = np.random.default_rng(0)
    net = Network.fresh({b"aa": 1}, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(5, net.p["Wf"].shape[0]))
    at = np.array([[0, 1, 2, -1], [4, 3, -1, -1], [2, 2, 1, 0]])
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(x, at)
        return float(np.sum(np.log1p(np.exp(z)) - label * z))

    logit, state = net.forward(x, at, keep=True)
    g, d_x = net.backward(x, at, state, sigmoid(logit) - label)
    for name, table, grad in [*((k, net.p[k], v) for k, v in g.items()), ("x", x, d_x)]:
        for _ in range(4):
            i = tuple(rng.integers(s) for s in table.shape)
            old = table[i]
            table[i] = old + 1e-5
            up = loss()
            table[i] = old - 1e-5
            down = loss()
            table[i] = old
            assert grad[i] == pytest.approx((up - down) / 2e-5, abs=2e-3), name


def test_held_out_accuracy(network):
    rows = corpus(2, 200)
    scores = toxicity.score_texts(network, [t for t, _ in rows], FAST)
    labels = np.array([y for _, y in rows])
    assert ((scores >= 0.5) == labels).mean() >= 0.95


def test_one_toxic_word_counts_wherever_it_is(network):
    clean = [t for t, y in corpus(3, 60) if not y]
    text = " ".join(clean)
    there = [" ".join([text, "moloch", text]), text + " moloch", "moloch " + text]
    scores = toxicity.score_texts(network, [text, *there], FAST)
    assert scores[0] < 0.5 and (scores[1:] >= 0.5).all()


def test_scores_do_not_depend_on_the_batch(network):
    texts = [t for t, _ in corpus(4, 20)] + [None, "", "?!"]
    together = toxicity.score_texts(network, texts, FAST, chunk=7)
    alone = [toxicity.score_texts(network, [t], FAST)[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-5)


def plain_vector(network, word):
    """A word's own vector, and the mean of those of its character n-grams, one at a time."""
    marked, vectors = b"^" + word + b"$", []
    for n in GRAMS:
        for i in range(len(marked) - n + 1):
            value = n
            for byte in marked[i : i + n]:
                value = (value * 0x100000001B3 % 2**64) ^ byte
            vectors.append(network.p["gram"][(value ^ (value >> 29)) % BUCKETS].astype(float))
    return np.concatenate((network.p["word"][network.words.get(word, 0)].astype(float), np.mean(vectors, axis=0)))


def plain_states(p, side, vectors):
    h, states = np.zeros(HIDDEN), []
    for x in vectors:
        gates, back = x @ p["W" + side] + p["d" + side], h @ p["U" + side]
        z = 1 / (1 + np.exp(-(gates[:HIDDEN] + back[:HIDDEN])))
        r = 1 / (1 + np.exp(-(gates[HIDDEN : 2 * HIDDEN] + back[HIDDEN : 2 * HIDDEN])))
        new = np.tanh(gates[2 * HIDDEN :] + r * back[2 * HIDDEN :])
        h = (1 - z) * new + z * h
        states.append(h)
    return states


def plain_score(network, text):
    """The largest score of any window, each by itself, step by step, in doubles."""
    p = {k: v.astype(float) for k, v in network.p.items()}
    vectors = [plain_vector(network, w) for w in toxicity.plain(text).split()]
    logits = []
    for row in toxicity.window_rows(len(vectors), FAST):
        inside = [vectors[i] for i in row if i >= 0]
        if not inside:
            logits.append(p["c"][0])
            continue
        ahead, back = plain_states(p, "f", inside), plain_states(p, "b", inside[::-1])[::-1]
        states = [np.concatenate(pair) for pair in zip(ahead, back, strict=True)]
        weight = np.exp([np.tanh(s @ p["A"] + p["a"]) @ p["v"] for s in states])
        pooled = sum(w * s for w, s in zip(weight / weight.sum(), states, strict=True))
        logits.append(pooled @ p["w"] + p["c"][0])
    return 1 / (1 + np.exp(-max(logits)))


def test_scores_equal_a_plain_reference(network):
    texts = [t for t, _ in corpus(5, 12)] + [None, "", "?!", "moloch", "Ünï çödé", " ".join(t for t, _ in corpus(6, 3))]
    scores = toxicity.score_texts(network, texts, FAST)
    assert scores == pytest.approx([plain_score(network, t) for t in texts], abs=1e-4)


@pytest.mark.parametrize("rows", [[], [("a b", 1)], [("a b", 0)], [("", 0), ("", 1)]])
def test_training_on_next_to_nothing(rows):
    scores = toxicity.score_texts(toxicity.train(rows, FAST), ["a", ""], FAST)
    assert ((0 <= scores) & (scores <= 1)).all()


def test_table(spark, network):
    table = odd(spark).withColumn("score", F.lit("old")).withColumn("more", F.lit(1))
    rows = toxicity.score(table, network, FAST).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.more == 1 for r in rows)
    assert toxicity.score(empty(spark), network, FAST).count() == 0


def test_fit_leaves_out_the_held_out_fold_and_nulls(spark, monkeypatch):
    texts = [f"text number {i}" for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, settings: seen.extend(rows))
    toxicity.fit(docs(spark, texts), labels)
    import zlib

    want = {(t, i % 2) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5}
    assert set(seen) == want and len(seen) == len(want)

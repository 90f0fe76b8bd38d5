import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import docs, odd_texts, rows
from pyspark.sql import functions as F

from tabassay.llm import ann, quality, rnn, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def held(i, folds, fold):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["an", "er", "th", "on", "es", "ti", "re", "ha"]) for _ in range(rnd.randint(1, 4))) for _ in range(150)]
    texts, labels = [], []
    for k in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        bad, junk = k % 5 == 0, k % 4 == 0
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["snark", "grumble"])
            w[rnd.randrange(len(w))] = "zorblat" + rnd.choice(words)
        texts.append(" ".join(x.upper() + "!!" for x in w) if junk else " ".join(w).capitalize() + ".")
        labels.append((k, int(not junk), int(bad)))
    return texts, labels


@pytest.mark.parametrize("clash", [False, True])
def test_quality_tells_held_out_documents_apart(spark, clash):
    texts, labels = corpus()
    got = {r["doc_id"]: r for r in rows(quality.score_quality(docs(spark, texts, clash=clash), spark.createDataFrame(labels, LABELS)))}
    test = [r for k, r in got.items() if held(k, 5, 0)]
    assert {r["held_out"] for r in test} == {True} and len(test) > 40
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in test) / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


@pytest.mark.parametrize("score,label", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_on_odd_tables(spark, score, label):
    texts, labels = corpus(60)
    odd = odd_texts(50_000)
    d = docs(spark, [*texts, *odd, "x"], [*range(60), *range(100, 100 + len(odd)), None])
    got = rows(score(d, spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), (2, 1, 0), (9999, 0, 1)], LABELS)))
    assert len(got) == 61 + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    one = rows(score(d, spark.createDataFrame([(k, 1, 0) for k in range(60)], LABELS)))
    assert len({round(r["score"], 9) for r in one}) == 1
    assert len(rows(score(d, spark.createDataFrame([], LABELS)))) == len(got)
    assert rows(score(docs(spark, []), spark.createDataFrame(labels, LABELS))) == []


def test_exact_votes(spark):
    texts, labels = corpus(80)
    m = quality.Model(quality.matrix(texts), [y for _, y, _ in labels])
    x = quality.unit_rows(quality.unit_rows(quality.matrix(texts[:5]) * m.idf) @ m.space)
    for k, s in enumerate(m.scores(texts[:5])):
        cosines = m.vectors @ x[k]
        near = np.argsort(-cosines, kind="stable")[: m.neighbours]
        w = np.maximum(cosines[near], 1e-3).astype(float) ** quality.POWER
        assert s == pytest.approx(float((w * m.labels[near]).sum() / w.sum()), abs=1e-4)


def test_toxicity_finds_words_stems_and_disguises(spark):
    texts, labels = corpus(900)
    d, y = docs(spark, texts), spark.createDataFrame(labels, LABELS)
    counts, weights, curve = toxicity.fit(d, y)
    assert {"snark", "grumble"} <= set(weights) and any(w.startswith("zorb") and w.endswith("*") for w in weights)
    scorer = toxicity.Scorer(counts, weights, curve)
    for text in ("such snark here", "a $nark!", "snaaaark", "s n a r k", "gr.um.ble", "gru*ble", "GRUMBLE", "snnark", "the zorblaterhan"):
        assert scorer.score(text) >= 0.7, text
    for text in ("plain words only", "12 of 15 at 3.5", "a b c d", "snar k", None, ""):
        assert scorer.score(text) < 0.7, text
    got = rows(toxicity.score_toxicity(d, y))
    test = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]][2] for r in test) / len(test) > 0.97
    kept = toxicity.drop_toxic(docs(spark, texts, clash=True), y)
    assert {r["doc_id"] for r in rows(kept)} == {r["doc_id"] for r in got if not r["predicted"]}


def test_signs_at_the_ends_and_alone():
    """A masked or replaced first or last letter, and a word of signs alone; the same signs around clean words say nothing."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("bcdfglmnprt") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4))) for _ in range(300)]
    counts = sum(np.bincount(toxicity.trigrams(w.encode()), minlength=toxicity.SYMBOLS**3) * 20 for w in words)
    lexicon = {"idiot", "loser", "trash", "ass", "twit"}
    restorer = toxicity.Restorer(toxicity.CharacterModel(counts, dict.fromkeys(lexicon, 0.2)), lexicon)
    for token, word in (("!diot", "idiot"), ("|oser", "loser"), ("+rash", "trash"), ("*diot,", "idiot"), ("(twi+)", "twit"), ("@$$", "ass"), ("\"trash!\"", "trash"), ("tras*", "trash")):
        assert restorer.seen(f"you {token} there") == {word}, token
    assert restorer.seen(" ".join(f"{a}{w}{b}" for w in words for a, b in (("*", "*"), ("!", ""), ("", "!"), ("+", "+"), ("", "")))) == set()
    assert restorer.seen("455 2023 +1 !!! *** $$ 100% $5 | || a+b") == set()


def test_viterbi_equals_every_path():
    counts = np.random.default_rng(3).integers(0, 50, toxicity.SYMBOLS**3)
    model = toxicity.CharacterModel(counts)

    def cost(s):
        c = [26, 26, *[toxicity.code(x) for x in s], 26]
        return -sum(model.step(*c[k : k + 3]) for k in range(len(c) - 2))

    for word in ("1d10t", "b@@d", "w0rd", "a1b2"):
        lattice = [toxicity.alternatives(m.group()) for m in re.finditer(r"(.)\1*", word)]
        paths = [("", 0.0)]
        for choices in lattice:
            paths = [(p + e, c + x) for p, c in paths for e, x in choices]
        best = min(c + cost(p) for p, c in paths)
        got = toxicity.viterbi(lattice, model)
        assert min(c for p, c in paths if p == got) + cost(got) == pytest.approx(best)


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    w, mask = rng.standard_normal(rnn.SIZE) * 0.3, rnn.masks(200)
    flat = rng.integers(0, 200, 40).astype(np.int16)
    flat[::3] = rnn.HEAD + rng.integers(0, rnn.BANDS, len(flat[::3]))
    lengths = np.array([12, 9, 5])
    _, inputs, target, real = next(rnn.windows(flat, rnn.starts_of(lengths), lengths))
    chosen = real.T.reshape(-1)

    def loss(w):
        states, _ = rnn.recur(rnn.views(w), np.zeros((3, rnn.HIDDEN)), inputs, False)
        return -rnn.output(rnn.views(w), states.reshape(-1, rnn.HIDDEN)[chosen], target.T.reshape(-1)[chosen], mask)[0].sum()

    flat_grad = np.zeros_like(w)
    p, grad = rnn.views(w), rnn.views(flat_grad)
    states, kept = rnn.recur(p, np.zeros((3, rnn.HIDDEN)), inputs, True)
    _, back = rnn.output(p, states.reshape(-1, rnn.HIDDEN)[chosen], target.T.reshape(-1)[chosen], mask, grad)
    d = np.zeros((states.shape[0] * states.shape[1], rnn.HIDDEN))
    d[chosen] = back
    rnn.back_through(p, kept, inputs, d.reshape(states.shape), grad)
    for i in rng.choice(np.flatnonzero(abs(flat_grad) > 1e-3), 40, replace=False):
        e = np.zeros_like(w)
        e[i] = 1e-5
        assert (loss(w + e) - loss(w - e)) / 2e-5 == pytest.approx(flat_grad[i], rel=1e-4, abs=1e-6)


def test_state_is_carried_and_rows_are_independent():
    rng = np.random.default_rng(1)
    w = (rng.standard_normal(rnn.SIZE) * 0.5).astype(np.float32)
    lengths = np.array([70, 3, 31, 24, 48, 1])
    flat = rng.integers(0, 256, lengths.sum()).astype(np.int16)
    starts, all_at_once = rnn.starts_of(lengths), rnn.document_scores(w, 256, flat, lengths)
    p, mask = rnn.views(w.astype(np.float64)), rnn.masks(256)
    for k, n in enumerate(lengths):
        own, h, total = flat[starts[k] : starts[k] + n], np.zeros((1, rnn.HIDDEN)), 0.0
        for t in range(n):
            states, _ = rnn.recur(p, h, np.array([[own[t - 1] if t else rnn.START]]), False)
            h = states[0]
            total += rnn.output(p, h, own[t : t + 1], mask)[0][0]
        assert all_at_once[k] == pytest.approx(total, rel=1e-4)


def test_bands_of_words():
    words = [b"a", b"Zz", "é".encode(), b"x" * 15, b"x" * 16, b"y" * 400, "日本".encode()]
    assert rnn.bands_of(words).tolist() == [rnn.band_of(w) for w in words] and rnn.band_of(b"") == 0 and rnn.bands_of([]).tolist() == []
    assert max(rnn.band_of(bytes([b]) * k) for b in range(1, 256) for k in range(1, 40)) == rnn.BANDS - 1


def test_outputs_sum_to_one():
    w = (np.random.default_rng(2).standard_normal(rnn.SIZE)).astype(np.float64)
    h = np.random.default_rng(3).standard_normal((1, rnn.HIDDEN))
    for n_head in (1, 40, 256):
        targets = np.array([*range(n_head), *range(rnn.HEAD, rnn.HEAD + rnn.BANDS)])
        got = rnn.output(rnn.views(w), np.repeat(h, len(targets), axis=0), targets, rnn.masks(n_head))[0]
        assert np.exp(got).sum() == pytest.approx(1.0)


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("known", [20, 200_000])
def test_base_scores_equal_a_dictionary(spark, clash, known):
    texts, _ = corpus(60)
    texts = [*texts, *odd_texts(30_000), texts[0]]
    ids = [*range(len(texts) - 1), None]
    got = rows(rnn.score_documents(docs(spark, texts, ids, clash=clash), known=known))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    of = lambda t: [*word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]
    count = Counter()
    for i, t in zip(ids, texts, strict=True):
        if not held(i, 7, 2):
            count.update(of(t))
    total, distinct = sum(count.values()), len(count)
    assert len(got) == len(texts)
    by_id = {i: t for i, t in zip(ids, texts, strict=True)}
    for r in got:
        w = of(by_id[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(count[x] > 0 for x in w), total, held(r["doc_id"], 7, 2))
        assert r["base_score"] == pytest.approx(math.fsum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w), abs=1e-6)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_scores_do_not_hang_on_the_partitioning(spark, monkeypatch):
    """Several shards, rows in other partitions and another order: the same score to the last digit but for sums of rows."""
    monkeypatch.setattr(rnn, "SHARD_TOKENS", 1500)
    texts, _ = corpus(120)
    d = docs(spark, [*texts, texts[3], None])
    one, other = (sorted((r["doc_id"], r["score"]) for r in rows(rnn.score_documents(x))) for x in (d.coalesce(1), d.repartition(7, "text")))
    assert [i for i, _ in one] == [i for i, _ in other]
    assert [s for _, s in one] == pytest.approx([s for _, s in other], rel=1e-6)
    assert one[3][1] == pytest.approx(one[120][1], rel=1e-6)


def test_scores_without_training_or_rows(spark):
    assert rows(rnn.score_documents(docs(spark, []))) == []
    only = next(i for i in range(100) if held(i, 7, 2))
    r = rows(rnn.score_documents(docs(spark, ["a b"], [only])))[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0


def vectors(spark, x, ids=None, kind="float"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0) for i, v in zip(ids, x, strict=True)], f"vec_id bigint, embedding array<{kind}>, label int")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_recall_ties_and_scores(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[1000:1400] = x[0]
    x[1400] = 2 * x[0]
    df = vectors(spark, [[float(c) for c in v] for v in x], kind=kind).withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    got = rows(ann.nearest(df))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 3000, 50):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in [r["vec_id"] for r in own]
        s = u @ u[q]
        s[q] = -2
        assert [r["score"] for r in own] == pytest.approx([s[r["vec_id"]] for r in own], abs=1e-12)
        hits += len({r["vec_id"] for r in own} & set(np.argsort(-s.round(12), kind="stable")[:5].tolist()))
        total += 5
    assert hits / total >= 0.9
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1000, 1001, 1002, 1003, 1004]


def test_unusable_vectors_take_no_part(spark):
    x = [[1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 2.0, 3.0], [0.5, 0.5], [1e30, 1e-30], [0.0, -1.0], [1.0, 0.0]]
    df = vectors(spark, x, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None])
    got = rows(ann.nearest(df))
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 8, 1), (0, 7, 2), (0, 9, 3)]
    assert rows(ann.nearest(vectors(spark, []))) == []
    repeated = rows(ann.nearest(vectors(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]], [0, 0, 5, 5])))
    assert [(r["query_id"], r["vec_id"]) for r in repeated] == [(0, 5)]


@pytest.mark.parametrize("scale", [False, True])
def test_repeated_rows_take_no_place_of_others(spark, scale):
    """A row near a query comes seven (or, scaled, three hundred) times; the query still gets its five nearest."""
    x = np.random.default_rng(8).standard_normal((60, 12)).astype(np.float32)
    x[7] = x[0] + 0.01
    again = [x[7] * 2.0**k for k in range(-20, 20)] * 8 if scale else [x[7]] * 6
    got = rows(ann.nearest(vectors(spark, [*x.tolist(), *[v.tolist() for v in again]], [*range(60), *[7] * len(again)]).coalesce(1)))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for q in (0, 50):
        s = u @ u[q]
        s[q] = -2
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(-s)[:5].tolist()


def test_size_of_the_network():
    assert rnn.HIDDEN >= 12 and rnn.views(rnn.first_weights())["u"].shape == (rnn.HIDDEN, 3 * rnn.HIDDEN)

"""Toxicity: noisy-channel deobfuscation, then a word model over the restored text.

A token that may be disguised (digits or signs among letters, letters repeated three times or more, single
characters set apart) becomes a lattice: every run of a character offers the letters it may stand for,
each with the cost of that disguise. The Viterbi path under a character trigram model, counted over all
documents, is the restored word. Signs at the ends of a token, and tokens of signs alone, are first taken for punctuation; if that gives
no lexicon word, the same path is sought with letters in their place. Tokens of digits alone are numbers. Plain words are lattices of one path and are left as they are. Words
and stems (beginnings of words) that are far commoner in toxic training texts form the lexicon; a
logistic curve over the sum of their log-odds gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabassay.llm.common import by_bytes
from tabassay.llm.quality import held_out, labelled_sample

#: Labelled rows that the lexicon and the curve are fitted on at most, in the order of a hash of their ids.
SAMPLE = 20_000
LEXICON = 500
#: A lexicon word stands in so many toxic texts and such a share of them, with such a z-score of the two shares and log-odds.
LEAST_TEXTS, LEAST_SHARE, LEAST_Z, LEAST_ODDS = 5, 0.02, 8.0, 2.0
THRESHOLD = 0.7
FOLDS, FOLD = 3, 1
MEMO = 300_000

LETTERS = 26
EDGE, OTHER, SYMBOLS = 26, 27, 28
# The letters that digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t"}
JOINERS = ".-_'*,~^"
MASK = "*"
COST_LEET, COST_SINGLE, COST_REPEAT, COST_JOIN, COST_BREAK, COST_MASK = 0.5, 3.0, 0.5, 0.5, 1.0, 0.5
#: Stems of so many letters may enter the lexicon; they are written with a star.
STEMS = range(3, 9)
BOOST = 0.02

_STRIP_LEFT = " \t.,;:?\"()[]{}<>~`^&%#*=/\\_-'!|+"
_STRIP_RIGHT = _STRIP_LEFT
#: Signs at the ends of a token that may be letters too, and those that never are.
_SOFT = frozenset("!|+*")
_HARD = "".join(c for c in _STRIP_LEFT if c not in _SOFT)
_TRIPLE = re.compile(r"(.)\1\1")
_TAIL = re.compile(r"([$@])\1\1+$")
_RUNS = re.compile(r"(.)\1*", re.DOTALL)
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")


def _codes() -> np.ndarray:
    table = np.full(256, EDGE, np.int32)
    table[128:] = OTHER
    for k in range(LETTERS):
        table[ord("a") + k] = table[ord("A") + k] = k
    return table


CODES = _codes()


def trigrams(data: bytes) -> np.ndarray:
    c = np.concatenate([[EDGE], CODES[np.frombuffer(data, np.uint8)], [EDGE]])
    return (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]


class CharacterModel:
    """log P(letter | two before), trigrams smoothed by bigrams and these by single letters."""

    def __init__(self, counts: np.ndarray, words: dict[str, float] | None = None):
        counts = counts.astype(np.float64).reshape(SYMBOLS, SYMBOLS, SYMBOLS).copy()
        share = max(counts.sum(), 1e4) * BOOST
        for word, part in (words or {}).items():
            stem = word.endswith("*")
            np.add.at(counts.reshape(-1), trigrams(word.rstrip("*").encode())[: -1 if stem else None], share * part)
        one = counts.sum(axis=(0, 1)) + 1
        one /= one.sum()
        two = counts.sum(axis=0) + 50 * one
        two /= two.sum(axis=1, keepdims=True)
        three = counts + 20 * two[None]
        self.log = np.log(three / three.sum(axis=2, keepdims=True)).tolist()

    def step(self, a: int, b: int, c: int) -> float:
        return self.log[a][b][c]


def code(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else EDGE if c == " " else OTHER


def alternatives(run: str) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with the cost of each reading."""
    c, n = run[0], len(run)
    letters = c if c.isalpha() else LEET.get(c, "")
    base = 0.0 if c.isalpha() else COST_LEET
    if c == MASK:
        return [("", COST_MASK + COST_JOIN), (" ", COST_MASK + COST_BREAK)] + [(chr(97 + k), COST_MASK) for k in range(LETTERS)] * (n == 1)
    if not letters:
        return [("", COST_JOIN), (" ", COST_BREAK)] if c in JOINERS else [(run, base)]
    if n == 1:
        return [(x, base) for x in letters]
    return [(x, base + (COST_REPEAT if n > 2 else COST_SINGLE)) for x in letters] + [(x + x, base + COST_REPEAT * (n > 2)) for x in letters]


def viterbi(lattice: list[list[tuple[str, float]]], model: CharacterModel) -> str:
    """The reading of least total cost: disguise costs and the character model's, ends included."""
    step = model.step
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for choices in lattice:
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for emitted, extra in choices:
                x, y, total = a, b, cost + extra
                for c in emitted:
                    z = code(c)
                    if z == EDGE and y == EDGE:
                        continue
                    total -= step(x, y, z)
                    x, y = (EDGE, EDGE) if z == EDGE else (y, z)
                if (x, y) not in following or total < following[x, y][0]:
                    following[x, y] = (total, (path, emitted))
        states = following
    _, path = min((cost - step(a, b, EDGE), k) for k, ((a, b), (cost, _)) in enumerate(states.items())) if states else (0, 0)
    node, out = list(states.values())[path][1], []
    while node is not None:
        node, emitted = node
        out.append(emitted)
    return "".join(reversed(out))


def core(token: str) -> str:
    return _TAIL.sub("", token.strip(_STRIP_LEFT)).rstrip(_STRIP_RIGHT)


def edged(token: str) -> str:
    """The token with signs at its ends that may stand for letters; "" if none do, or nothing in it may be a letter."""
    word = token.strip(_HARD)
    edge = word[:1] in _SOFT or word[-1:] in _SOFT
    signs = any(c in "@$!|+" for c in word)
    return word if (edge or signs and not any(c.isalpha() for c in word)) and any(c.isalpha() or c in "@$" for c in word) else ""


def edge_lattice(word: str) -> list[list[tuple[str, float]]]:
    """Signs at the ends as letters, a masked one included; stars around a word are emphasis."""
    runs = [m.group() for m in _RUNS.finditer(word)]
    lattice = [alternatives(r) for r in runs]
    around = len(runs) > 1 and runs[0][0] == MASK == runs[-1][0]
    for k in {0, len(runs) - 1}:
        if runs[k][0] in _SOFT:
            letters = [(x, cost) for x, cost in lattice[k] if x.strip()]
            lattice[k] = letters if letters and not (around and runs[k][0] == MASK) else [("", 0.0)]
    return lattice


def disguised(word: str) -> bool:
    if word.isalpha():
        return _TRIPLE.search(word) is not None
    return any(c.isalpha() for c in word) or any(c in "@$!|+" for c in word) and any(c.isdigit() for c in word)


def restore_token(token: str, model: CharacterModel) -> list[str]:
    """The words of one lower-cased token."""
    word = core(token)
    if not word:
        return []
    if not disguised(word):
        return [word]
    return viterbi([alternatives(m.group()) for m in _RUNS.finditer(word)], model).split()


def restore_spaced(text: str, model: CharacterModel) -> list[str]:
    """The words of single characters set apart; each may begin a new word."""
    lattice = []
    for k, c in enumerate(text.split()):
        plain = alternatives(c)
        lattice.append(plain + [(" " + x, cost) for x, cost in plain if x.strip()] * (k > 0))
    return viterbi(lattice, model).split()


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in STEMS if n <= len(word)]]


class Restorer:
    """Features of the restored words of whole texts, through a bounded memo of tokens. With a lexicon only its own are kept."""

    def __init__(self, model: CharacterModel, lexicon: set[str] | None = None):
        self.model, self.lexicon, self.memo = model, lexicon, {}
        self.squeezed = {re.sub(r"(.)\1", r"\1", w) for w in lexicon or ()}

    def known(self, words: list[str]) -> tuple[str, ...]:
        found = [f for w in words for f in features(w)]
        return tuple(found if self.lexicon is None else [f for f in found if f in self.lexicon])

    def of(self, token: str) -> tuple[str, ...]:
        words = restore_token(token, self.model)
        found = self.known(words)
        if self.lexicon and not found and len(words) == 1 and words[0].isalpha() and re.sub(r"(.)\1", r"\1", words[0]) in self.squeezed:
            found = self.known([viterbi([alternatives(m.group()) for m in _RUNS.finditer(words[0])], self.model)])
        if self.lexicon and not found and len(token) <= 64 and (word := edged(token)):
            found = self.known(viterbi(edge_lattice(word), self.model).split())
        return found

    def seen(self, text: str | None) -> set[str]:
        """The distinct features of the restored words."""
        text, out, memo = (text or "").lower(), set(), self.memo
        for token in set(text.split()):
            found = memo.get(token)
            if found is None:
                if len(memo) >= MEMO:
                    memo.clear()
                found = self.of(token)
                if len(token) <= 64:
                    memo[token] = found
            if found:
                out.update(found)
        for m in _SPACED.finditer(text):
            out.update(self.known(restore_spaced(m.group(), self.model)))
        return out

    def text(self, text: str | None) -> str | None:
        """The text with its disguised tokens restored, lower-cased; what is plain keeps its place."""
        if text is None:
            return None
        text = _SPACED.sub(lambda m: " ".join(restore_spaced(m.group(), self.model)), text.lower())
        return re.sub(r"\S+", lambda m: " ".join(restore_token(m.group(), self.model)) if disguised(core(m.group())) else m.group(), text)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a partition's texts."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in by_bytes(batches, 0):
        for text in batch.column(0).to_pylist():
            if text:
                data = text.encode()
                for at in range(0, len(data), 1 << 20):
                    counts += np.bincount(trigrams(data[at : at + (1 << 20)]), minlength=SYMBOLS**3)
    codes = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(counts[codes])], names=["code", "n"])


def character_counts(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Trigram counts over all documents: at most SYMBOLS**3 sums reach the driver."""
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count_batches, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in rows:
        counts[r["code"]] = r["n"]
    return counts


def word_batches(batches: Iterator[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    """word, label, in how many texts; sums of a part of a partition at a time."""
    restorer, sums = Restorer(CharacterModel(counts.value)), Counter()

    def flush() -> pa.RecordBatch:
        rows = list(sums.items())
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for (w, _), _ in rows], pa.string()), pa.array([y for (_, y), _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["word", "label", "n"])

    for batch in by_bytes(batches, 0):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums.update((w, label) for w in restorer.seen(text))
        if len(sums) > 200_000:
            yield flush()
    yield flush()


def hit_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(*model.value)
    for batch in by_bytes(batches, 0):
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([scorer.evidence(t) for t in batch.column(0).to_pylist()], pa.float64())], names=["label", "evidence"])


class Scorer:
    def __init__(self, counts: np.ndarray, weights: dict[str, float], curve: tuple[float, float]):
        self.weights, (self.a, self.b) = weights, curve
        self.restorer = Restorer(CharacterModel(counts, dict.fromkeys(weights, 1 / max(len(weights), 1))), set(weights))

    def evidence(self, text: str | None) -> float:
        return math.fsum(self.weights[w] for w in self.restorer.seen(text))

    def score(self, text: str | None) -> float:
        x = self.a + self.b * self.evidence(text)
        return 1 / (1 + math.exp(-max(min(x, 500), -500)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a light ridge; the slope isn't negative."""
    w, design = np.zeros(2), np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (y - p) - 0.1 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def choose(rows: list[tuple[str, float, float]], size: int) -> dict[str, float]:
    """Features by falling z; of nested ones with equal evidence the most specific: whole words, then longer stems."""
    weights: dict[str, float] = {}
    for word, odds, _ in sorted(rows, key=lambda r: (-round(r[2], 6), r[0].endswith("*"), -len(r[0]), r[0])):
        own = word.rstrip("*")
        nested = any(own.startswith(w.rstrip("*")) and w.endswith("*") or w.startswith(own) and word.endswith("*") for w in weights)
        if not nested and len(weights) < size:
            weights[word] = odds
    return weights


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, size: int = LEXICON) -> tuple[np.ndarray, dict[str, float], tuple[float, float]]:
    """Character counts of all documents; lexicon and curve from a bounded labelled sample outside the held-out fold."""
    spark = docs.sparkSession
    counts = character_counts(docs, text=text)
    drawn = labelled_sample(docs, labels, label, held_out(F.col(key), FOLDS, FOLD), key=key, text=text, sample=sample).select("text", "label")
    shared = spark.sparkContext.broadcast(counts)
    words = drawn.mapInArrow(lambda it: word_batches(it, shared), "word string, label int, n bigint")
    words = words.groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("good"))
    n = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return counts, {}, (30.0 if bad else -30.0 if good else 0.0, 0.0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    share = (F.col("bad") + F.col("good")) / (bad + good)
    z = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / bad + 1 / good))
    rows = words.filter((F.col("bad") >= max(LEAST_TEXTS, LEAST_SHARE * bad)) & (z >= LEAST_Z) & (odds >= LEAST_ODDS)).orderBy(z.desc(), "word").limit(8 * size).select("word", odds.alias("odds"), z.alias("z")).collect()
    weights = choose([(r["word"], r["odds"], r["z"]) for r in rows], size)
    model = spark.sparkContext.broadcast((counts, weights, (0.0, 1.0)))
    seen = drawn.mapInArrow(lambda it: hit_batches(it, model), "label int, evidence double").groupBy("label", "evidence").count().toPandas() if weights else None
    if seen is None:
        return counts, {}, (math.log(bad / good), 0.0)
    times = seen["count"].to_numpy()
    return counts, weights, logistic(np.repeat(seen["evidence"].to_numpy(), times), np.repeat(seen["label"].to_numpy(np.float64), times))


def score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(*model.value)
    for batch in by_bytes(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["key", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``key, held_out, score, predicted`` per row of ``docs``; only whole texts enter a score.

    Null and empty texts show no lexicon word and get the curve's lowest score. Repeated rows and null keys
    each give their row (a null key is not held out). Null labels and labels without a document are passed over, of
    repeated ones the larger counts; with one class only every score is near that class. Empty tables
    give no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key=key, text=text, label=label, sample=sample))
    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lambda it: score_batches(it, model), f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_batches(batches: Iterator[pa.RecordBatch], model, column: int, threshold: float) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(*model.value)
    for batch in by_bytes(batches, column):
        yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(column).to_pylist()], pa.bool_()))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that ``score_toxicity`` would mark; all columns kept, in one narrow pass after the fit."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key=key, text=text, label=label, sample=sample))
    column = docs.columns.index(text)
    return docs.mapInArrow(lambda it: keep_batches(it, model, column, threshold), docs.schema)

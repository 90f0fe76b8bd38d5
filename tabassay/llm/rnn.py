"""LM scoring with a gated recurrent language model in numpy.

Words are counted over all training documents. The most frequent (the head) are predicted one by one, all
others through their band, words of about equal length and ending: the output softmax is factored into classes, of which head
classes hold sixteen words with a softmax of their own and bands share out their probability by counts,
each with one part for a word never seen. Every document becomes numbers once. Training documents are dealt by a
hash to shards, whose number follows from the tokens counted and whose rows are sorted, so what is learned hangs neither on the
partitioning nor on the order of rows. Weights are trained by backpropagation truncated to windows,
with the state carried on through the document: every shard trains from common
weights, and weights are averaged by tokens, in two rounds (an eighth of the documents, then all). A document's score is the
log-probability of all its tokens with the state carried from window to window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabassay.llm.common import by_bytes, checkpointed

FOLDS, FOLD = 7, 2
HIDDEN, WINDOW, GROUP, RUN_TOKENS = 16, 24, 1024, 1 << 22
#: Training tokens to a shard; its number of shards makes the model of a corpus, whatever cluster it is trained on.
SHARD_TOKENS = 1 << 22
CLASS, CLASSES = 16, 16
#: Bands: lengths in bytes up to LENGTHS, by the last ENDINGS-th of the last byte's values.
LENGTHS, ENDINGS = 16, 4
BANDS = LENGTHS * ENDINGS
HEAD = CLASS * CLASSES  # the end of a document is word 0
START = HEAD + BANDS
OUTPUTS = CLASSES + BANDS
RATE, ROUNDS = 0.01, (8, 1)
#: Counts of so many frequent words are broadcast; all others are joined.
KNOWN = 400_000
END = b""


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of UTF-8; for bytes, white space is just what ends a word."""
    return (text or b"").lower().split()


def band_of(word: bytes) -> int:
    return (min(len(word), LENGTHS) - 1) * ENDINGS + word[-1] % ENDINGS if word else 0


def bands_of(words: list[bytes]) -> np.ndarray:
    """The bands of words that aren't empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    last = np.fromiter((w[-1] for w in words), np.int64, len(words))
    return (np.minimum(lengths, LENGTHS) - 1) * ENDINGS + last % ENDINGS


def band_column(word: str) -> Column:
    """The same of a column of words."""
    last = F.conv(F.hex(F.substring(F.col(word).cast("binary"), -1, 1)), 16, 10).cast("int") % ENDINGS
    return F.when(F.octet_length(word) > 0, (F.least(F.octet_length(word), F.lit(LENGTHS)) - 1) * ENDINGS + last).otherwise(F.lit(0))


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


# ---- the network ----

SHAPES = {"x": (START + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, OUTPUTS), "cb": (OUTPUTS,), "d": (CLASSES, HIDDEN, CLASS), "db": (CLASSES, CLASS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def first_weights() -> np.ndarray:
    return (np.random.default_rng(5).standard_normal(SIZE) * 0.1).astype(np.float32)


def masks(n_head: int) -> tuple[np.ndarray, np.ndarray]:
    """What to add to the logits so that slots and classes without a word have no probability."""
    slots = np.where(np.arange(HEAD) < max(n_head, 1), 0.0, -1e9).astype(np.float32).reshape(CLASSES, CLASS)
    return np.concatenate([slots.max(axis=1), np.zeros(BANDS, np.float32)]), slots


def recur(p: dict, h: np.ndarray, inputs: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after each input (steps, rows, HIDDEN); ``keep``: what the way back needs."""
    n, out, kept = HIDDEN, np.empty((inputs.shape[1], len(h), HIDDEN), h.dtype), []
    for t in range(inputs.shape[1]):
        x, hu = p["x"][inputs[:, t]], h @ p["u"]
        gates = x[:, : 2 * n] + hu[:, : 2 * n]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
        if keep:
            kept.append((h, z, r, new, hu[:, 2 * n :]))
        h = new + z * (h - new)
        out[t] = h
    return out, kept


def softmax_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits and their sums; logits stay far below where exp overflows. The sum as a product is the quickest."""
    np.minimum(x, 60, out=x)
    e = np.exp(x)
    return e, e @ np.ones(x.shape[1], x.dtype)


def output(p: dict, states: np.ndarray, target: np.ndarray, mask: tuple, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probabilities of the targets (head words, or their bands), and the gradient at the states."""
    group = np.where(target < HEAD, target // CLASS, CLASSES + target - HEAD)
    rows = np.arange(len(target))
    x = states @ p["c"]
    x += p["cb"] + mask[0]
    e, total = softmax_parts(x)
    got = (x[rows, group] - np.log(total)).astype(np.float64)
    back = None
    if grad is not None:
        e *= (1 / total)[:, None]
        e[rows, group] -= 1
        grad["c"] += states.T @ e
        grad["cb"] += np.ones(len(e), e.dtype) @ e
        back = e @ p["c"].T
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
    for k in range(CLASSES):
        own = order[ends[k] : ends[k + 1]]
        if not len(own):
            continue
        slot, s, each = target[own] % CLASS, states[own], np.arange(len(own))
        x = s @ p["d"][k]
        x += p["db"][k] + mask[1][k]
        e, total = softmax_parts(x)
        got[own] += x[each, slot] - np.log(total)
        if grad is not None:
            e *= (1 / total)[:, None]
            e[each, slot] -= 1
            grad["d"][k] += s.T @ e
            grad["db"][k] += np.ones(len(e), e.dtype) @ e
            back[own] += e @ p["d"][k].T
    return got, back


def back_through(p: dict, kept: list, inputs: np.ndarray, dstates: np.ndarray, grad: dict) -> None:
    """Gradients of a window; nothing goes back beyond its first step."""
    n, carry, dx = HIDDEN, np.zeros_like(dstates[0]), np.empty((inputs.shape[1], len(inputs), 3 * HIDDEN), dstates.dtype)
    for t in range(inputs.shape[1] - 1, -1, -1):
        h, z, r, new, hn = kept[t]
        dh = dstates[t] + carry
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dx[t, :, :n], dx[t, :, n : 2 * n], dx[t, :, 2 * n :] = dz, dr, dn
        du = np.concatenate([dz, dr, dn * r], axis=1)
        grad["u"] += h.T @ du
        carry = dh * z + du @ p["u"].T
    flat, dx = inputs.T.reshape(-1), dx.reshape(-1, 3 * n)
    order = np.argsort(flat, kind="stable")
    found, first = np.unique(flat[order], return_index=True)
    grad["x"][found] += np.add.reduceat(dx[order], first, axis=0)


def windows(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in falling order of length, WINDOW steps at a time: how many go on, inputs, targets, which are real."""
    for at in range(0, int(lengths[0]) if len(lengths) else 0, WINDOW):
        live = int(np.searchsorted(-lengths, -at, side="left"))
        steps = np.arange(at, min(at + WINDOW, int(lengths[0])))
        real = steps[None] < lengths[:live, None]
        place = starts[:live, None] + np.minimum(steps[None], lengths[:live, None] - 1)
        target = flat[place]
        inputs = np.where(steps[None] > 0, flat[np.maximum(place - 1, 0)], START)
        yield live, inputs, target, real


def groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), GROUP):
        yield order[at : at + GROUP]


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


class Trainer:
    """Adam over windows; the state goes on, the gradient does not."""

    def __init__(self, weights: np.ndarray, n_head: int):
        self.w, self.mask = weights.astype(np.float32).copy(), masks(n_head)
        self.m, self.v, self.t, self.tokens = np.zeros_like(self.w), np.zeros_like(self.w), 0, 0

    def run(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        starts = starts_of(lengths)
        for rows in groups(lengths):
            h = np.zeros((len(rows), HIDDEN), np.float32)
            for live, inputs, target, real in windows(flat, starts[rows], lengths[rows]):
                h = self.step(h[:live], inputs, target, real)

    def step(self, h: np.ndarray, inputs: np.ndarray, target: np.ndarray, real: np.ndarray) -> np.ndarray:
        p, flat_grad = views(self.w), np.zeros_like(self.w)
        grad = views(flat_grad)
        states, kept = recur(p, h, inputs, True)
        chosen = np.flatnonzero(real.T)
        _, back = output(p, states.reshape(-1, HIDDEN)[chosen], target.T.reshape(-1)[chosen], self.mask, grad)
        dstates = np.zeros((states.shape[0] * states.shape[1], HIDDEN), states.dtype)
        dstates[chosen] = back
        back_through(p, kept, inputs, dstates.reshape(states.shape), grad)
        n = len(chosen)
        self.tokens += n
        self.t += 1
        flat_grad /= n
        self.m += 0.1 * (flat_grad - self.m)
        self.v += 0.01 * (flat_grad * flat_grad - self.v)
        self.w -= RATE * min(1.0, n / 2048) * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)
        return states[-1]


def document_scores(weights: np.ndarray, n_head: int, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-probability of each document's head words and bands."""
    p, mask, out, starts = views(weights), masks(n_head), np.zeros(len(lengths)), starts_of(lengths)
    for rows in groups(lengths):
        h = np.zeros((len(rows), HIDDEN), np.float32)
        for live, inputs, target, real in windows(flat, starts[rows], lengths[rows]):
            states, _ = recur(p, h[:live], inputs, False)
            chosen = real.T.reshape(-1)
            got = np.zeros(chosen.shape)
            got[chosen] = output(p, states.reshape(-1, HIDDEN)[chosen], target.T.reshape(-1)[chosen], mask)[0]
            out[rows[:live]] += got.reshape(real.T.shape).sum(axis=0)
            h = states[-1]
    return out


# ---- tables ----


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words; an end for every document."""
    sums: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        words, n = [w.decode() for w in sums], list(sums.values())
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    for batch in by_bytes(batches, 0):
        for text in texts_of(batch.column(0)):
            sums.update(words_of(text))
            sums[END] += 1
        if len(sums) > 500_000:
            yield flush()
    yield flush()


class Lexicon:
    """Places of the frequent words: head first, and what the network sees of each."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.place = {w: k for k, w in enumerate(words)}
        self.log_count = np.log10(np.array([*counts, 0], np.float64) + 1)
        self.band = np.array([*map(band_of, words), 0])
        self.seen_as = np.where(np.arange(len(words) + 1) < HEAD, np.arange(len(words) + 1), HEAD + self.band).astype(np.int16)
        self.n_head = min(len(words), HEAD)

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))


def encode_batches(batches: Iterator[pa.RecordBatch], lexicon, sums) -> Iterator[pa.RecordBatch]:
    """Per document: what the network sees of its words and end, all that frequent words give, and the words whose counts must be joined."""
    words, band_log, row = lexicon.value, np.log10(np.asarray(sums.value) + 1), TaskContext.get().partitionId() << 36
    places_beyond = np.arange(len(words.log_count)) >= HEAD
    tail = np.where(places_beyond, words.log_count - band_log[words.band], 0.0)
    for batch in by_bytes(batches, 2):
        own = [words_of(t) for t in texts_of(batch.column(2))]
        n = np.fromiter(map(len, own), np.int64, len(own))
        every = list(chain.from_iterable(own))
        places = words.places(every)
        starts = np.cumsum(n + 1) - (n + 1)
        at = np.arange(len(every)) + np.repeat(np.arange(len(own)), n)
        ids, known, logs, model = np.zeros(len(every) + len(own), np.int16), *np.zeros((3, len(every) + len(own)))
        ids[at], known[at] = words.seen_as[places], places >= 0
        logs[at], model[at] = np.where(places >= 0, words.log_count[places], 0.0), np.where(places >= 0, tail[places], 0.0)
        unknown = np.flatnonzero(places < 0)
        rare = list(map(every.__getitem__, unknown.tolist()))
        ids[at[unknown]] = HEAD + bands_of(rare)
        cuts = np.searchsorted(unknown, np.concatenate([[0], np.cumsum(n)])).tolist()
        far = [Counter(rare[a:b]) if b > a else {} for a, b in pairwise(cuts)]
        data, ends = ids.tobytes(), (starts + n + 1).tolist()
        columns = [
            pa.array(range(row, row + len(own)), pa.int64()),
            pa.array(n),
            *[pa.array(np.add.reduceat(v, starts).astype(kind)) for v, kind in ((known, np.int64), (logs, np.float64), (model, np.float64))],
            pa.array([[w.decode() for w in f] for f in far], pa.list_(pa.string())),
            pa.array([list(f.values()) for f in far], pa.list_(pa.int32())),
            pa.array([data[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary()),
        ]
        row += len(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["key", "learns", *ENCODED])


ENCODED = ("row", "n_words", "n_known", "log_counts", "model", "words", "times", "ids")
ENCODED_KINDS = "learns boolean, row bigint, n_words bigint, n_known bigint, log_counts double, model double, words array<string>, times array<int>, ids binary"

#: Weights are added as whole numbers of 1 / WEIGHT, so the order of shards leaves no trace in their sum.
WEIGHT = 1 << 24


def train_batches(batches: Iterator[pa.RecordBatch], weights, n_head: int) -> Iterator[pa.RecordBatch]:
    """Per shard, whose documents stand together: the weights after it, times its tokens. A large shard trains in runs of RUN_TOKENS."""
    trainer, shard, held, tokens = None, -1, [], 0

    def run() -> None:
        if held:
            trainer.run(np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held)))

    def done() -> pa.RecordBatch:
        total = np.round(trainer.w.astype(np.float64) * WEIGHT).astype(np.int64) * trainer.tokens
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([trainer.tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "tokens", "weights"])

    for batch in batches:
        for k, own in enumerate(batch.column(0).to_pylist()):
            if own != shard:
                run()
                if trainer is not None:
                    yield done()
                trainer, shard, held, tokens = Trainer(weights.value, n_head), own, [], 0
            held.append(np.frombuffer(batch.column(1)[k].as_buffer(), np.int16))
            tokens += len(held[-1])
            if tokens >= RUN_TOKENS:
                run()
                held, tokens = [], 0
    run()
    if trainer is not None:
        yield done()


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, total = 0, np.zeros(SIZE, np.int64)
    for batch in batches:
        tokens += sum(batch.column(1).to_pylist())
        for w in batch.column(2).to_pylist():
            total += np.frombuffer(w, np.int64)
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "tokens", "weights"])


def train(encoded: DataFrame, shards: int, n_head: int) -> np.ndarray:
    """Weights after the rounds, from ``key, learns, ids``; at most 16 sums of weights reach the driver in each."""
    spark, weights = encoded.sparkSession, first_weights()
    schema = "part bigint, tokens bigint, weights binary"
    learning = encoded.filter("learns").select(F.pmod(F.xxhash64("key", "ids"), F.lit(shards)).cast("int").alias("shard"), "ids", F.xxhash64("ids").alias("hash"))
    for share in ROUNDS:
        shared = spark.sparkContext.broadcast(weights)
        dealt = learning.filter(F.pmod("hash", F.lit(share)) == 0).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.desc(F.octet_length("ids")), "hash", "ids")
        rows = dealt.select("shard", "ids").mapInArrow(lambda it, w=shared: train_batches(it, w, n_head), schema).repartition(16, F.col("part")).mapInArrow(sum_batches, schema).collect()
        tokens = sum(r["tokens"] for r in rows)
        if tokens:
            weights = (sum(np.frombuffer(r["weights"], np.int64).astype(object) for r in rows) / tokens / WEIGHT).astype(np.float32)
    return weights


def score_batches(batches: Iterator[pa.RecordBatch], weights, n_head: int) -> Iterator[pa.RecordBatch]:
    """The same rows with the network's log-probability added to ``model``, in place of ids."""
    held, tokens = [], 0

    def run() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        column = table["ids"]
        rows = [np.frombuffer(v.as_buffer(), np.int16) for v in column]
        scores = document_scores(weights.value, n_head, np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))) / np.log(10)
        at = table.column_names.index("model")
        yield from table.set_column(at, "model", pa.array(table["model"].to_numpy() + scores)).drop_columns(["ids"]).to_batches(10_000)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            tokens += batch.column("ids").nbytes // 2
        if tokens >= RUN_TOKENS:
            yield from run()
            held, tokens = [], 0
    if held:
        yield from run()


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, count), the most frequent first: all words above a count that ``most`` at most reach, and the end of documents.

    Counts fall into sixteen classes to the doubling, so the cut is found from at most about a thousand sums.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    cut, reached = 1 << 30, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        reached += r["count"]
        if reached > most - 1:
            break
        cut = r["level"]
    rows = counts.filter((level >= cut) | (F.col("word") == "")).toPandas()
    return sorted(((w.encode(), int(n)) for w, n in zip(rows["word"], rows["n"], strict=True)), key=lambda r: (-r[1], r[0]))


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", known: int = KNOWN) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    Null and empty texts are one end. Repeated rows and null keys each give their row; a null key is not
    held out. Ties in counts go by the word. Without training documents every probability of the
    base is 1 and the network stays at its first weights. Empty tables give no rows; other columns are
    not read. Words beyond the ``known`` most frequent are joined by word; none of them is
    frequent, so no key is hot.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col("key").cast("string")) % FOLDS == FOLD, F.lit(False))
    whole = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    learning = whole.filter(~held_out).select("text")

    counts = checkpointed(learning.mapInArrow(count_batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = most_frequent(counts, known)
    ends = [n for w, n in frequent if w == END]
    frequent = [(w, n) for w, n in frequent if w != END]
    lexicon = Lexicon([END, *(w for w, _ in frequent)], [*(ends or [0]), *(n for _, n in frequent)])
    if not total:
        lexicon = Lexicon([END], [0])
    head = [w.decode() for w in list(lexicon.place)[:HEAD]]
    sums = [0.0] * BANDS
    for r in counts.filter(~F.col("word").isin(head)).groupBy(band_column("word").alias("band")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        sums[r["band"]] = float(r["n"])
    shared, band_sums, n_head = spark.sparkContext.broadcast(lexicon), spark.sparkContext.broadcast(sums), lexicon.n_head

    learns = whole.select("key", (~held_out).alias("learns"), "text")
    encoded = checkpointed(learns.mapInArrow(lambda it: encode_batches(it, shared, band_sums), f"key {kind}, {ENCODED_KINDS}"))
    weights = spark.sparkContext.broadcast(train(encoded.select("key", "learns", "ids"), max(-(-int(total) // SHARD_TOKENS), 1), n_head))
    scored = encoded.select("key", "row", "n_words", "n_known", "log_counts", "model", "ids").mapInArrow(lambda it: score_batches(it, weights, n_head), f"key {kind}, row bigint, n_words bigint, n_known bigint, log_counts double, model double")
    each = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    joined = each.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    log_sum = F.element_at(F.array(*[F.lit(float(np.log10(s + 1))) for s in sums]), band_column("word") + 1)
    far = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("far_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("far_log"),
        F.sum(F.col("times") * (F.log10(F.col("n") + 1) - log_sum)).alias("far_model"),
    )
    out = scored.join(far, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_tokens = F.col("n_words") + 1
    end_known, end_log = int(bool(ends)), float(lexicon.log_count[0])
    return out.select(
        F.col("key").alias(key),
        held_out.alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + zero("far_known") + end_known).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") + zero("far_log") + end_log - n_tokens * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + zero("far_model")).alias("score"),
    )

"""SimHash near-dedup: tiled exact comparison of fingerprints.

Equal fingerprints are merged first. Two that differ in at most 3 of 64 bits agree in at least one of
four quarters (pigeonhole), so comparing within blocks of an equal quarter loses no pair. Fingerprints
stand by block and population count, cut into tiles; tiles are compared by numpy's
exclusive-or and bit counts, and pairs of tiles whose population counts differ beyond the radius are
skipped. A block beyond a tile row's size is split into chunks, and every pair of chunks is dealt on
its own. A task returns a spanning forest of the links it finds, never all pairs of a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabassay.llm.common import by_bytes, checkpointed, small_side

SEED = 42
RADIUS = 3
SHINGLE = 3
#: Fingerprints of a block that are compared in one place; larger blocks are split into pairs of chunks.
CHUNK = 2048
TILE = 256


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 if it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return int.from_bytes(digest(joined, SEED), "big")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends, ones, n = ends.tolist(), np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, 1 << 16):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + (1 << 16))], ends[at + size - 1 :], strict=False)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1):
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["key", "same", "fp"])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, same, fp`` per row: a hash that tells texts apart, and the 64 bits as a bigint."""
    kind = docs.schema[key].dataType.simpleString()
    body = F.col(text).cast("string")
    return docs.select(F.col(key).alias("key"), body.alias("text"), F.xxhash64(body).alias("same")).mapInArrow(fingerprint_batches, f"key {kind}, same bigint, fp bigint")


def union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[k] and j[k] for all k; parent points every member straight at its set's smallest."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def tile_links(block: np.ndarray, prints: np.ndarray, chunk: np.ndarray, cross: np.ndarray, radius: int, seen: Counter | None = None) -> np.ndarray:
    """parent of each fingerprint within its block; blocks stand one after another.

    Rows are ordered by population count inside their block and cut into tiles, so a tile holds many small blocks or a
    part of a large one. A tile meets itself and those after it that still hold its last block; of these, the first
    whose population counts lie beyond the radius ends the row of tiles. ``seen`` counts the pairs of tiles met and skipped.
    """
    counts = np.bitwise_count(prints).astype(np.int64)
    place = np.cumsum(np.concatenate([[0], block[1:] != block[:-1]]))
    order = np.lexsort((counts, place))
    prints, counts, chunk = prints[order], counts[order], chunk[order]
    parent, n = np.arange(len(prints)), len(prints)
    ends = np.searchsorted(place, place, side="right")
    for a in range(0, n, TILE):
        last = min(a + TILE, n) - 1
        for b in range(a, int(ends[last]), TILE):
            if b > a and counts[b] - counts[last] > radius:
                if seen is not None:
                    seen["skipped"] += -(-(int(ends[last]) - b) // TILE)
                break
            if seen is not None:
                seen["met"] += 1
            near = np.bitwise_count(prints[a : last + 1, None] ^ prints[None, b : b + TILE]) <= radius
            near &= place[a : last + 1, None] == place[None, b : b + TILE]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            keep = (i < j) & (~cross[i] | (chunk[i] != chunk[j]))
            union(parent, i[keep], j[keep])
    back = np.empty_like(parent)
    back[order] = order[parent]
    return back


def block_links(block: np.ndarray, prints: np.ndarray, chunk: np.ndarray, cross: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, another of its set) of whole blocks that follow one another."""
    parent = tile_links(block, prints, chunk, cross, radius)
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return prints[linked], prints[parent[linked]]


def link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by block; the last, unfinished block of a batch waits for the next."""

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        block, prints, chunk, cross = columns
        a, b = block_links(block, prints.view(np.uint64), chunk, cross.astype(bool), radius)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if columns[0][-1] != (held[-1] if held else columns)[0][0 if not held else -1]:
            joined = [np.concatenate(c) for c in zip(*held, columns, strict=True)]
            whole = int(np.flatnonzero(joined[0] != joined[0][-1])[-1]) + 1
            yield emit([c[:whole] for c in joined])
            held = [[c[whole:] for c in joined]]
        else:
            held.append(columns)
    if held:
        yield emit([np.concatenate(c) for c in zip(*held, strict=True)])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b`` (a > b): links that connect exactly what fingerprints within ``radius`` (at most 3) connect."""
    if radius > 3:
        raise ValueError("four quarters find pairs of at most 3 differing bits")
    quarter = lambda q: F.lit(q * 65536) + F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(65535)).cast("int")
    keyed = distinct.select("fp", F.explode(F.array(*map(quarter, range(4)))).alias("quarter"))
    large = keyed.groupBy("quarter").count().filter(F.col("count") > CHUNK).select("quarter", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    keyed = keyed.join(large, "quarter", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = keyed.select("quarter", "fp", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    block = (F.col("quarter").cast("bigint") * F.lit(1 << 44)) + low.cast("bigint") * F.lit(1 << 22) + high.cast("bigint")
    dealt = dealt.select(block.alias("block"), "fp", "chunk", (low != high).cast("int").alias("cross"))
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: link_batches(it, radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, b``: for every end of an edge but a component's smallest, that smallest; by alternating large and small stars.

    Each round is written to the checkpoint folder. Rounds grow with the logarithm of a component's width.
    """
    edges, last = checkpointed(edges), None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == last or now[0] == 0:
            return edges
        last = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).distinct())


def grouped(docs: DataFrame, *, key: str, text: str, radius: int) -> DataFrame:
    """``key, same, fp, best`` per row: a hash of its text, its fingerprint, and the first row of its component.

    First is the smallest key, null ones last, then the least hash of a text. Rows are reduced to one of each
    fingerprint, and these to one of each component, before anything is joined back, so a large group costs no task its size.
    """
    prints = checkpointed(fingerprints(docs, key=key, text=text))
    row = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("same").alias("same"))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(row).alias("first")))
    stars = components(links(distinct, radius))
    rooted = distinct.join(stars, distinct["fp"] == stars["a"], "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return prints.join(rooted.join(best, "root").select("fp", "best"), "fp").select("key", "same", "fp", "best")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key, fingerprint, component_id`` per row: 16 hex digits, and the smallest key reachable over links.

    Texts without a word (null, empty, blank) have fingerprint zero, which links like any other. Repeated
    rows keep their row each; null keys are passed over as smallest keys, and a component of only null
    keys has a null one. Empty tables give no rows; other columns of ``docs`` are not read.
    """
    found = grouped(docs, key=key, text=text, radius=radius)
    return found.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.key").alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the smallest key's, null keys last, ties by a hash of the text.

    Rows are told apart by key and text, so a key that stands on several texts loses only those that go, and a
    row that comes several times stays once. All columns are kept.
    """
    found = grouped(docs, key=key, text=text, radius=radius)
    marked = found.withColumn("wins", F.col("key").eqNullSafe(F.col("best.key")) & (F.col("same") == F.col("best.same")))
    each = checkpointed(marked.groupBy(F.col("key").alias("__key"), F.col("same").alias("__same"), "wins").count())
    losers = small_side(each.filter(~F.col("wins")).select("__key", "__same"))
    repeated = small_side(each.filter(F.col("wins") & (F.col("count") > 1)).select("__key", "__same"), none=True)
    same = F.xxhash64(F.col(text).cast("string"))
    on = lambda side, other: side[key].eqNullSafe(other["__key"]) & (same == other["__same"])
    kept = docs.join(losers, on(docs, losers), "left_anti")
    if repeated is None:
        return kept
    once = kept.join(repeated, on(kept, repeated), "left_anti")
    several = kept.join(repeated, on(kept, repeated), "left_semi").withColumn("__same_text", same)
    return once.unionByName(several.dropDuplicates([key, "__same_text"]).drop("__same_text"))

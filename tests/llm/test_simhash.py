import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import docs, odd_texts, rows

from tabassay.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(prints, radius=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    out = defaultdict(set)
    for i in range(len(prints)):
        out[root(i)].add(i)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("clash", [False, True])
def test_components_equal_brute_force(spark, clash):
    rng = np.random.default_rng(5)
    base = " ".join(f"w{k}" for k in rng.integers(0, 900, 2500))
    near = [base.replace(f"w{k} ", f"v{k} ", 1) for k in range(25)]
    texts = [*odd_texts(20_000), base, *near, *[" ".join(f"u{k}" for k in rng.integers(0, 50, 40)) for _ in range(60)]]
    got = {r["doc_id"]: r for r in rows(simhash.near_duplicates(docs(spark, texts, clash=clash)))}
    prints = [plain(t) for t in texts]
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    for g in groups(prints):
        assert {got[k]["component_id"] for k in g} == {min(g)}


@pytest.mark.parametrize("n", [40, 700])
def test_blocks_of_any_size(spark, n, monkeypatch):
    """Fingerprints around a few centres, so that blocks hold thousands and are split into chunks."""
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    prints = set()
    while len(prints) < n:
        p = int(rng.choice(centres))
        for b in rng.choice(64, rng.integers(0, 12), replace=False).tolist():
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "CHUNK", 90)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint")
    edges = [(int(np.int64(r["a"]).astype(np.uint64)), int(np.int64(r["b"]).astype(np.uint64))) for r in simhash.links(df).collect()]
    place = {p: k for k, p in enumerate(prints)}
    parent = np.arange(len(prints))
    simhash.union(parent, np.array([place[a] for a, _ in edges], int), np.array([place[b] for _, b in edges], int))
    found = defaultdict(set)
    for k, r in enumerate(parent.tolist()):
        found[r].add(k)
    assert {frozenset(v) for v in found.values()} == groups(prints)


def brute_parent(block, prints, chunk, cross):
    parent = np.arange(len(prints))
    for i in range(len(prints)):
        for j in range(i):
            if block[i] == block[j] and (not cross[i] or chunk[i] != chunk[j]) and (int(prints[i]) ^ int(prints[j])).bit_count() <= 3:
                parent[parent == parent[i]] = parent[j]
    return parent


def test_every_block_goes_through_tiles(monkeypatch):
    """Small blocks share tiles, large ones take several, and far pairs of tiles are skipped; links equal brute force."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(simhash, "TILE", 16)
    sizes = [1, 2, 5, 90, 1, 3, 40, 2, 200]
    block = np.repeat(np.arange(len(sizes)), sizes)
    bits = rng.integers(0, 64, len(block))
    prints = np.array([(1 << int(b)) - 1 for b in bits], np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, len(block)).astype(np.uint64))
    chunk, cross = rng.integers(0, 2, len(block)), np.repeat(rng.integers(0, 2, len(sizes)), sizes).astype(bool)
    seen = Counter()
    got, want = simhash.tile_links(block, prints, chunk, cross, 3, seen), brute_parent(block, prints, chunk, cross)
    sets = lambda parent: {frozenset(np.flatnonzero(parent == p).tolist()) for p in set(parent.tolist())}
    assert sets(got) == sets(want) and seen["skipped"] > seen["met"] > 0


def test_rows_are_told_apart_by_key_and_text(spark):
    long = " ".join(f"t{k}" for k in range(40))
    d = docs(spark, [long, long, long, "own words of a key", long, "x y z w", "x y z w"], [None, None, 4, 4, 8, None, None])
    got = sorted(((r["doc_id"], r["text"]) for r in rows(simhash.keep_one(d))), key=str)
    assert got == sorted([(4, long), (4, "own words of a key"), (None, "x y z w")], key=str)
    again = docs(spark, ["p q r s", "p q r s", "u v w"], [1, 1, 1])
    assert sorted(r["text"] for r in rows(simhash.keep_one(again))) == ["p q r s", "u v w"]


def test_chains_become_one_component(spark):
    chain = [(k + 1, k) for k in range(60)] + [(200, 100)]
    got = {r["a"]: r["b"] for r in simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {200: 100}


def test_keep_one_of_each(spark):
    d = docs(spark, ["a b c d", "a b c d", "A  B c d", "other words stand here", None, "", "z"], [5, 3, 4, 9, None, 7, 9], clash=True)
    got = rows(simhash.keep_one(d))
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, "a b c d"), (7, ""), (9, "other words stand here"), (9, "z")]
    assert simhash.keep_one(d).columns == d.columns
    assert rows(simhash.near_duplicates(docs(spark, []))) == []
    lone = rows(simhash.near_duplicates(docs(spark, ["a", "a"], [None, None])))
    assert [r["component_id"] for r in lone] == [None, None]

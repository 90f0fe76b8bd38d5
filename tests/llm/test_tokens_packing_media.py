import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import docs, odd_texts, rows
from public_tokenizers import path

from tabassay.llm import bpe, common, media, packing, tokens, webp

VOCABULARY = path("word_bpe_49k.json")


def ids_of(text):
    return bpe.load(VOCABULARY).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("clash", [False, True])
def test_token_counts_equal_the_library(spark, clash):
    texts = [*odd_texts(), "It's <|endoftext|> he'LL <|EndOfText|> 12 ½", "x" * 70_000]
    got = {r["doc_id"]: r for r in rows(tokens.count_tokens(docs(spark, texts, clash=clash), VOCABULARY))}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        n = len(ids_of(t))
        assert got[k] == {"doc_id": k, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 2048}


def test_token_counts_of_null_ids_repeats_and_nothing(spark):
    assert [r["n_tokens"] for r in rows(tokens.count_tokens(docs(spark, ["a b", "a b", "a b"], [None, 1, 1]), VOCABULARY))] == [2, 2, 2]
    assert rows(tokens.count_tokens(docs(spark, []), VOCABULARY)) == []


def test_long_texts_are_cut_where_words_end(monkeypatch):
    """Long pieces without blanks, in scripts beyond Latin-1: the counts stay the library's."""
    monkeypatch.setattr(bpe, "LONG_PIECE", 40)
    rnd = random.Random(5)
    memo = bpe.Memo(VOCABULARY, len)
    for letters in ("日本語、。「」12", "αβγ,;'s'll_-İ\u0307", "क़ख़।,'tİ.é\u0301-", "<|endoftext|>é日,.", "가각힣\u1100\u1161!?"):
        for _ in range(20):
            text = "".join(rnd.choice(letters) for _ in range(600))
            parts = bpe.safe_pieces(text, 40)
            assert "".join(parts) == text
            assert sum(memo.of(text)) == len(ids_of(text))
    assert len(bpe.safe_pieces("日本語、" * 100, 40)) > 5


def test_batches_are_balanced_by_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 5000, 0, 3, 900, 900, 900, 20_000, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    parts = list(common.by_bytes(iter([batch, batch.slice(0, 0)]), 1, 2000))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts and len(parts) > 4
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 2000 for p in parts)


def test_the_session_s_bound_is_only_lowered(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for given, want in (("64m", common.TRAVEL_BYTES), ("1g", common.TRAVEL_BYTES), ("2m", "2m"), ("4096", "4096"), ("67108864b", common.TRAVEL_BYTES)):
        spark.conf.set(name, given)
        assert spark.conf.get(common.session(spark) and name) == str(want)
    spark.conf.set(name, before)


def test_memo_survives_being_full():
    memo = bpe.Memo(VOCABULARY, len, limit=5)
    for t in ("a b c d e f g h", "a zz b", "one two three four five six seven"):
        assert sum(memo.of(t)) == len(ids_of(t))


@pytest.mark.parametrize("clash", [False, True])
def test_packing_is_a_round_trip(spark, clash):
    texts = [*odd_texts(60_000), *[f"word{k} " * (k * 7 % 300) for k in range(60)]]
    got = rows(packing.pack_documents(docs(spark, texts, clash=clash), VOCABULARY, with_ids=True))
    for k, t in enumerate(texts):
        want = np.asarray([*ids_of(t), 0], "<u4")
        pieces = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["piece"])
        assert b"".join(p["ids"] for p in pieces) == want.tobytes()
        assert [p["start"] for p in pieces] == list(range(0, len(want), 2048))
        assert all(p["ids_crc32"] == zlib.crc32(p["ids"]) and p["length"] == len(p["ids"]) // 4 for p in pieces)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // 2048) + 1


@pytest.mark.parametrize("partitions", [1, 200])
def test_sequences_do_not_hang_on_session_settings(spark, partitions):
    d = docs(spark, [f"word{k} " * (k * 37 % 900) for k in range(300)])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = rows(packing.pack_documents(d.repartition(partitions), VOCABULARY))
    spark.conf.set("spark.sql.adaptive.enabled", before["spark.sql.adaptive.enabled"])
    spark.conf.set("spark.sql.shuffle.partitions", before["spark.sql.shuffle.partitions"])
    assert len({r["sequence_id"] for r in got}) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert {k: spark.conf.get(k) for k in before} == before


def test_packing_of_repeats_and_nothing(spark):
    got = rows(packing.pack_documents(docs(spark, ["a b", "a b"], [None, None]), VOCABULARY))
    assert sorted((r["offset"], r["length"]) for r in got) in ([(0, 3), (3, 3)], [(0, 3), (0, 3)])
    assert rows(packing.pack_documents(docs(spark, []), VOCABULARY)) == []


def test_fullest_combination_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 30, rng.integers(1, 9))
        room = int(rng.integers(0, 60))
        best = max(s for m in range(1 << len(lengths)) if (s := sum(int(v) for k, v in enumerate(lengths) if m >> k & 1)) <= room)
        chosen = packing.fullest(packing.Lengths(lengths), room)
        assert sum(chosen) == best
        left = lengths.tolist()
        for c in chosen:
            left.remove(c)


def images():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (5, 3), (9, 16), (12, 33)):
        for colours in (2, 4, 16, 60, None):
            image = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
            yield rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (h, w))] if colours else image, colours


@pytest.mark.parametrize("transforms", [(), (2,), (0,), (1,), (3,), (0, 1, 2), (2, 1, 0), (3, 0)])
@pytest.mark.parametrize("cache_bits", [0, 4, 11])
def test_webp_round_trips(transforms, cache_bits):
    for image, colours in images():
        if 3 in transforms and not colours:
            continue
        for references in (False, True):
            back = webp.images(webp.encode(image, transforms=transforms, cache_bits=cache_bits, references=references))
            assert len(back) == 1 and np.array_equal(back[0], image)


def plain_inverse(p, width, modes, bits):
    """The predictor transform undone pixel by pixel in plain integers, from the text of the specification."""
    across, out = -(-width // (1 << bits)), []
    for i, rest in enumerate(p.tolist()):
        y, x = divmod(i, width)
        if i == 0:
            guess = [255, 0, 0, 0]
        elif y == 0:
            guess = out[i - 1]
        elif x == 0:
            guess = out[i - width]
        else:
            left, top, right, corner = out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1]
            mean = lambda a, b: [(v + w) // 2 for v, w in zip(a, b, strict=True)]
            clamp = lambda v: min(max(v, 0), 255)
            mode = int(modes[(y >> bits) * across + (x >> bits)])
            if mode == 11:
                toward = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
                guess = left if sum(abs(a - b) for a, b in zip(toward, left, strict=True)) < sum(abs(a - b) for a, b in zip(toward, top, strict=True)) else top
            elif mode == 12:
                guess = [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
            elif mode == 13:
                guess = [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
            else:
                guess = {
                    0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner),
                    7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)),
                }[mode]
        out.append([(a + b) & 255 for a, b in zip(rest, guess, strict=True)])
    return np.array(out, np.uint8)


@pytest.mark.parametrize("width,bits", [(16, 2), (16, 4), (16, 6), (7, 2), (1, 3), (33, 3)])
def test_predictors_equal_plain_integers(width, bits):
    rng = np.random.default_rng(width + bits)
    height = 41
    p = rng.integers(0, 256, (width * height, 4), dtype=np.uint8)
    tiles = -(-width // (1 << bits)) * -(-height // (1 << bits))
    for modes in [np.full(tiles, m) for m in range(14)] + [rng.integers(0, 14, tiles)]:
        want = plain_inverse(p, width, modes, bits)
        assert np.array_equal(webp.invert_prediction(p, width, modes, bits), want), modes
        assert np.array_equal(webp.apply_prediction(want, width, modes, bits), p)


def test_streams_of_another_encoder():
    """The lossless sample that browsers are commonly probed with: 1 x 1 pixel, written by the format's own tools."""
    sample = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert [i.shape for i in webp.images(sample)] == [(1, 1, 4)]
    with pytest.raises(ValueError):
        webp.images(b"RIFF0000WEBPVP8 ")


def test_files_use_the_tools_of_the_format(monkeypatch):
    """What the query writes goes through palette, predictor, cross-colour, back-references and colour cache."""
    used = Counter()
    for name in ("invert_prediction", "cross_colour", "read_symbols"):
        whole = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, whole=whole, name=name: (used.update([name]), whole(*a))[1])
    line = "the quick brown fox jumps over the lazy dog and more of the same words go here. "
    rnd = random.Random(6)
    texts = [line * 90, " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(2000)) + line * 3, "ab" * 3000]
    kinds = set()
    for t in texts:
        payload, _ = media.payload_of(t)
        file = media.store(payload)
        assert media.load(file).tobytes() == payload and len(file) < len(payload)
        r = webp.Reader(file[20:], 40)
        kinds.add((r.bits(1), r.bits(2)))
    assert kinds == {(1, webp.PALETTE), (1, webp.PREDICTOR)} and min(used.values()) > 0 and len(used) == 3


def test_long_codes_and_a_stream_that_ends_early():
    counts = [1 << min(k, 40) for k in range(60)]
    lengths = webp.code_lengths(counts, 15)
    assert max(lengths) <= 15 and sum(2.0**-n for n in lengths) == 1
    rng = np.random.default_rng(9)
    skewed = np.minimum(rng.geometric(0.35, (300, 64, 4)) * 7, 255).astype(np.uint8)
    skewed[::7, ::5] = rng.integers(0, 256, skewed[::7, ::5].shape)
    file = webp.encode(skewed)
    assert np.array_equal(webp.images(file)[0], skewed)
    with pytest.raises(ValueError):
        webp.decode_stream(file[20 : len(file) // 3])


@pytest.mark.parametrize("clash", [False, True])
def test_media_columns(spark, clash):
    texts = [*odd_texts(), "x" * 1_100_000, "y" * 64, "y" * 65]
    got = {r["doc_id"]: r for r in rows(media.media_columns(docs(spark, texts, clash=clash), keep=True))}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\0" * (max(-(-len(data) // 64), 1) * 64 - len(data))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert bytes(r["pixels"]) == padded and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert media.load(bytes(r["media"])).tobytes() == padded
    same = [k for k, t in enumerate(texts) if t == "same text here"]
    assert len({tuple(v for n, v in got[k].items() if n != "doc_id") for k in same}) == 1
    assert rows(media.media_columns(docs(spark, []))) == []


def test_meta_prefix_codes():
    """Two groups of codes by blocks of four pixels, written by hand."""
    rng = np.random.default_rng(7)
    width = height = 8
    argb = rng.integers(0, 1 << 32, width * height, dtype=np.uint64).astype(np.uint32)
    group = [0, 1, 1, 0]
    of = [group[(k // width // 4) * 2 + k % width // 4] for k in range(len(argb))]
    w = webp.Writer()
    webp.header(w, width, height)
    w.bits(0, 1)  # no transform
    w.bits(0, 1)  # no cache
    w.bits(1, 1)
    w.bits(0, 3)
    webp.write_image(w, np.array([g << 8 for g in group], np.uint32), 2, False)
    codes = []
    for g in (0, 1):
        own = [int(p) for p, o in zip(argb, of, strict=True) if o == g]
        codes.append([])
        for n, shift in zip(webp.ALPHABETS, (8, 16, 0, 24, None), strict=True):
            counts = [0] * n
            for p in own if shift is not None else []:
                counts[p >> shift & 255] += 1
            codes[g].append(webp.write_code(w, webp.code_lengths(counts)))
    for p, g in zip(argb.tolist(), of, strict=True):
        for code, shift in zip(codes[g], (8, 16, 0, 24), strict=False):
            w.bits(*code[p >> shift & 255])
    back = webp.decode_stream(w.bytes())
    assert np.array_equal(back.reshape(-1, 4), webp.planes(argb)[:, [1, 2, 3, 0]])

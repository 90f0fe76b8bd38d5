"""Images written and read together: the same files and pixels as one by one."""

import random

import numpy as np
import pytest
from helpers import docs, rows

from tabassay.llm import media, webp, webp_many


def payloads():
    """Texts of all sizes: many small ones, frequent lines, few colours, one of several tiles, random bytes, zeros."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("etaoinshrdlucmfwyp,.") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(rnd.choices(words[: rnd.choice((5, 60, 400))], k=rnd.choice((1, 9, 60, 200, 700)))) for _ in range(90)]
    texts += ["", "a", "ab" * 3000, "\n".join(rnd.choices(words[:30], k=8)) * 40, " ".join(rnd.choices(words, k=9000)), "é中\U0001f600 " * 300, *["one and the same text " * 9] * 3]
    noise = np.random.default_rng(3)
    return [media.payload_of(t)[0] for t in texts] + [noise.integers(0, 256, 64 * k, dtype=np.uint8).tobytes() for k in (1, 2, 40, 300)]


@pytest.fixture(params=[2, 48, 1000])
def side(request, monkeypatch):
    """Streams side by side down to the last two, to the 48th, or none."""
    monkeypatch.setattr(webp_many, "SIDE_BY_SIDE", request.param)


def test_same_files_and_pixels(side):
    images = [np.frombuffer(p, np.uint8).reshape(-1, 16, 4) for p in payloads()]
    files = webp_many.encode(images)
    assert files == [webp.encode_by_content(i) for i in images]
    back = webp_many.decode([s for f in files for s in webp.streams_of(f)])
    assert all(np.array_equal(b, i) and b.shape == i.shape and np.array_equal(webp.images(f)[0], i) for b, i, f in zip(back, images, files, strict=True))
    assert webp_many.encode([]) == [] and webp_many.decode([]) == []


def test_more_than_are_held_at_a_time(monkeypatch):
    monkeypatch.setattr(webp_many, "MOST_ROWS", 150)
    images = [np.frombuffer(p, np.uint8).reshape(-1, 16, 4) for p in payloads()]
    files = webp_many.encode(images)
    assert files == [webp.encode_by_content(i) for i in images]
    assert all(np.array_equal(b, i) for b, i in zip(webp_many.decode([s for f in files for s in webp.streams_of(f)]), images, strict=True))


def test_files_of_other_settings(side):
    """Streams with all predictors, smaller tiles, other caches, other widths and orders among the usual ones."""
    rng = np.random.default_rng(5)
    image = lambda h, w: np.minimum(rng.geometric(0.02, (h, w, 4)), 255).astype(np.uint8)
    images, files = [], []
    for k, kinds in enumerate([(0, 1), (0, 1), (0, 1), (1, 0), (0,), (2,), (), (0, 1, 2)]):
        for bits in (2, 4, 5):
            for cache_bits in (0, 4, 6, 9):
                images.append(image(int(rng.integers(1, 90)), 16 if k else 9))
                files.append(webp.encode(images[-1], transforms=kinds, cache_bits=cache_bits, references=True, bits=bits, modes=None if k % 2 else np.array([8, 1, 2]), factors=np.array([[250, 3, 99]])))
    back = webp_many.decode([s for f in files for s in webp.streams_of(f)])
    assert all(np.array_equal(b, i) for b, i in zip(back, images, strict=True))


def test_a_stream_that_ends_early(side):
    images = [np.frombuffer(p, np.uint8).reshape(-1, 16, 4) for p in payloads()[:60]]
    streams = [s for f in webp_many.encode(images) for s in webp.streams_of(f)]
    largest = max(range(60), key=lambda k: len(streams[k]))
    streams[largest] = streams[largest][: len(streams[largest]) // 2]
    with pytest.raises(ValueError):
        webp_many.decode(streams)


def test_images_of_a_query_go_together(spark, monkeypatch):
    """One call for many rows, and values that do not hang on which rows stand beside them."""
    texts = [p.decode("utf-8", "ignore").rstrip("\0") for p in payloads()[:97]]
    calls = []
    monkeypatch.setattr(webp_many, "predicted", lambda images, whole=webp_many.predicted: (calls.append(len(images)), whole(images))[1])
    stored = media.store_many([media.payload_of(t)[0] for t in texts])
    assert len(calls) == 1 and calls[0] > 40
    got = {r["doc_id"]: r for r in rows(media.media_columns(docs(spark, texts), keep=True))}
    assert [bytes(got[k]["media"]) for k in range(len(texts))] == stored == [media.store(media.payload_of(t)[0]) for t in texts]

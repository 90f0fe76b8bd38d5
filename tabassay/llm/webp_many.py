"""Many lossless WebP files at once, byte for byte as ``webp`` writes them and pixel for pixel as it reads them.

Steps of one image cost little beside the calls that they take, so they are taken for all images of a batch together: transforms
are chosen on all pixels, codes are made and written in rows of a matrix, and all streams are read side by side, a pixel each a turn.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from tabassay.llm import webp

WIDTH = 16
#: Below so many streams side by side the rest is read one by one.
SIDE_BY_SIDE = 48
#: Rows of pixels that are held at a time; a taller image is alone. More images than 16 bits number never meet.
MOST_ROWS = 1 << 16
#: Pixels whose colours are counted first.
FIRST = 400
TURNED = webp.reversed_order(15)
ORDER = np.array(webp.LENGTH_ORDER)


# ---- writing ----


def code_lengths(counts: np.ndarray, longest: int = 10) -> np.ndarray:
    """``webp.code_lengths`` for every row."""
    counts = np.asarray(counts, np.float64)
    out = np.zeros(counts.shape, np.int64)
    used = np.count_nonzero(counts, axis=1)
    alone = np.flatnonzero(used <= 1)
    out[alone, counts[alone].argmax(axis=1)] = 1
    many = np.flatnonzero(used > 1)
    if not len(many):
        return out
    some, k = counts[many], int(used.max())
    own = np.where(some > 0, np.maximum(some, some.sum(axis=1, keepdims=True) / (1 << (longest - 1))), 0.0)
    order = np.argsort(-own, axis=1, kind="stable")[:, :k]
    real = np.arange(k) < used[many][:, None]
    ranked = np.where(real, np.take_along_axis(own, order, axis=1), 1.0)
    n = np.clip(np.ceil(np.log2(own.sum(axis=1, keepdims=True) / ranked) - 1e-9).astype(np.int64), 1, longest)
    parts = np.ascontiguousarray(np.where(real, 1 << (longest - n), 0).T)  # of the whole, a row a rank
    free = (1 << longest) - parts.sum(axis=0)
    odd = np.flatnonzero(free < 0)
    free[odd] = 0
    limit = 1 << (longest - 1)
    while free.any():
        for part in parts:
            more = np.where((part <= free) & (part < limit), part, 0)
            part += more
            free -= more
    sizes = np.where(real, longest + 1 - np.frexp(np.maximum(parts.T, 1))[1], 0)
    made = np.zeros(some.shape, np.int64)
    np.put_along_axis(made, order, sizes, axis=1)
    for row in odd.tolist():  # rounding of the logarithms
        made[row] = webp.code_lengths(some[row], longest)
    out[many] = made
    return out


def code_bits(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``webp.Codes`` for every row: bits as they stand in the stream, and how many."""
    d, s = lengths.shape
    used = np.count_nonzero(lengths, axis=1)
    longest = lengths.max(axis=1)
    order = np.argsort(np.where(lengths > 0, lengths, 99) * s + np.arange(s), axis=1)[:, : int(used.max())]
    n = np.take_along_axis(lengths, order, axis=1)
    width = np.where(n > 0, 1 << (longest[:, None] - n), 0)
    starts = np.cumsum(width, axis=1) - width
    bits = np.where(n > 0, TURNED[np.minimum(starts, len(TURNED) - 1)] >> (15 - longest[:, None]), 0)
    out, sizes = np.zeros((d, s), np.int64), np.zeros((d, s), np.int64)
    np.put_along_axis(out, order, bits, axis=1)
    several = used > 1
    return np.where(several[:, None], out, 0), np.where(several[:, None], lengths, sizes)


def code_headers(lengths: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``webp.code_header`` for every row of so many symbols: rows, values and sizes, by row."""
    d, s = lengths.shape
    used = np.count_nonzero(lengths, axis=1)
    last = s - 1 - (lengths[:, ::-1] > 0).argmax(axis=1)
    simple = (used <= 2) & (last < 256)
    first = (lengths > 0).argmax(axis=1)
    own = np.flatnonzero(simple)
    two = used[own] == 2
    rows, values, sizes = [own], [1 | (used[own] - 1) << 1 | 1 << 2 | first[own] << 3 | np.where(two, last[own] << 11, 0)], [np.where(two, 19, 11)]
    rest = np.flatnonzero(~simple)
    if len(rest):
        keep = np.arange(s) < alphabet[rest][:, None]
        flat, row = lengths[rest][keep], np.repeat(np.arange(len(rest)), alphabet[rest])
        at = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])
        n, row, length = flat[at], row[at], np.diff(np.r_[at, len(flat)])
        # The last length that is not zero, before each run; 8 at the start of a row.
        place = np.maximum.accumulate(np.where(n > 0, np.arange(len(n)), -1))
        before = np.r_[-1, place[:-1]]
        past = np.where((before >= 0) & (row[before] == row), n[before], 8)
        new = ((n > 0) & (n != past)).astype(np.int64)
        most = np.where(n > 0, 6, 138)
        full, left = np.divmod(length - new, most)
        again = left >= 3
        code = np.where(n > 0, 16 | left - 3 << 5 | 2 << 12, np.where(left <= 10, 17 | left - 3 << 5 | 3 << 12, 18 | left - 11 << 5 | 7 << 12))
        tokens = np.column_stack([n, np.where(n > 0, 16 | 3 << 5 | 2 << 12, 18 | 127 << 5 | 7 << 12), code, n])
        times = np.column_stack([new, full, again, np.where(again, 0, left)])
        every, at_row = np.repeat(tokens.reshape(-1), times.reshape(-1)), np.repeat(row, times.sum(axis=1))
        symbols = every & 31
        small = code_lengths(np.bincount(at_row * 19 + symbols, minlength=19 * len(rest)).reshape(-1, 19), 7)
        bits, size = code_bits(small)
        took = size[at_row, symbols]
        # Nineteen lengths of three bits each, and five bits before them and one after, in two values.
        head = np.column_stack([30 | (small[:, ORDER[:9]] << (3 * np.arange(9))).sum(axis=1) << 5, (small[:, ORDER[9:]] << (3 * np.arange(10))).sum(axis=1)])
        rows += [np.repeat(rest, 2), rest[at_row]]
        values += [head.reshape(-1), bits[at_row, symbols] | (every >> 5 & 127) << took]
        sizes += [np.tile([32, 31], len(rest)), took + (every >> 12)]
    rows, values, sizes = (np.concatenate(v) for v in (rows, values, sizes))
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    return rows[order], values[order], sizes[order]


def streams(sections: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], d: int) -> list[bytes]:
    """Each row's bits, section after section; a section has its values of at most 63 bits by row."""
    own = [np.bincount(rows, sizes, d).astype(np.int64) for rows, _, sizes in sections]
    total = sum(own)
    words = (total >> 6) + 2
    base, at = np.cumsum(words) - words, np.zeros(d, np.int64)
    out = np.zeros(int(words.sum()), np.uint64)
    for (rows, values, sizes), bits in zip(sections, own, strict=True):
        if not len(rows):
            continue
        before = np.cumsum(bits) - bits
        place = np.cumsum(sizes) - sizes + (base * 64 + at - before)[rows]
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        edges = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        values = values.astype(np.uint64)
        out[word[edges]] |= np.bitwise_or.reduceat(values << shift, edges)
        over = np.flatnonzero((place & 63) + sizes > 64)  # the last of a word only
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        at += bits
    data = out.astype("<u8").tobytes()
    return [data[8 * b : 8 * b + n] for b, n in zip(base.tolist(), ((total + 7) >> 3).tolist(), strict=True)]


@lru_cache(4096)
def small_image(argb: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of an image a pixel wide."""
    w = webp.Writer()
    webp.write_image(w, np.frombuffer(argb, np.uint32), 1, False)
    w.many(np.zeros(0, np.int64), np.zeros(0, np.int64))
    values, sizes = (np.concatenate(v) for v in zip(*w.parts, strict=True))
    return values, sizes


def small_images(argb: np.ndarray, first: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The images of modes or factors, a pixel a tile, as a section."""
    ends = first + high
    alike = np.minimum.reduceat(argb, first) == np.maximum.reduceat(argb, first)  # five codes of a lone symbol
    one = np.flatnonzero(alike)
    pixel, value = argb[first[one]].astype(np.int64), np.zeros(len(one), np.int64)
    for k, shift in enumerate((8, 16, 0, 24)):
        value |= (5 | (pixel >> shift & 255) << 3) << (1 + 11 * k)
    rows, values, sizes = [one], [value | 5 << 45], [np.full(len(one), 56)]
    for row in np.flatnonzero(~alike).tolist():
        v, n = small_image(argb[first[row] : ends[row]].tobytes())
        rows.append(np.full(len(v), row))
        values.append(v)
        sizes.append(n)
    rows, values, sizes = (np.concatenate(v) for v in (rows, values, sizes))
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    return rows[order], values[order], sizes[order]


def last_equal(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The place of the last equal key of the same image before each, or -1; keys have zeros in their lower 24 bits."""
    both = np.sort(keys | np.arange(len(keys), dtype=np.uint64))
    at = (both & np.uint64(0xFFFFFF)).astype(np.int64)
    same = (both[1:] >> np.uint64(24) == both[:-1] >> np.uint64(24)) & (doc[at[1:]] == doc[at[:-1]])
    out = np.full(len(keys), -1, np.int64)
    out[at[1:][same]] = at[:-1][same]
    return out


def matches(argb: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """``webp.matches`` of every image, places in all of them."""
    wide = argb.astype(np.uint64)
    keys = np.zeros(len(argb), np.uint64)
    keys[:-2] = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (wide[2:] * np.uint64(0x165667B19E3779F9))
    before = last_equal(keys >> np.uint64(24) << np.uint64(24), doc)
    at = np.flatnonzero(before >= 0)
    source, stop = before[at], ends[doc[at]]
    # Three equal pixels, the third before the end of its image.
    inside = at + 2 < stop
    at, source, stop = at[inside], source[inside], stop[inside]
    equal = (argb[at] == argb[source]) & (argb[at + 1] == argb[source + 1]) & (argb[at + 2] == argb[source + 2])
    out, end = [], 0
    for place, start, stop in zip(at[equal].tolist(), source[equal].tolist(), stop[equal].tolist(), strict=True):
        if place < end:
            continue
        length, step, most = 3, 13, min(4096, stop - place)
        while length < most:
            step = min(step, most - length)
            apart = (argb[start + length : start + length + step] != argb[place + length : place + length + step]).nonzero()[0]
            if len(apart):
                length += int(apart[0])
                break
            length, step = length + step, step * 4
        out.append((place, length, place - start))
        end = place + length
    return out


def encode(images: Sequence[np.ndarray]) -> list[bytes]:
    """``webp.encode_by_content`` of images 16 pixels wide, those of few colours one by one."""
    out: list[bytes] = [b""] * len(images)
    many, at = [], 0
    for k, image in enumerate(images):
        if image.shape[1] != WIDTH or few_colours(image):
            out[k] = webp.encode_by_content(image)
        else:
            many.append(k)
    while at < len(many):
        size, upto = 0, at
        while upto < len(many) and (upto == at or size + len(images[many[upto]]) <= MOST_ROWS):
            size, upto = size + len(images[many[upto]]), upto + 1
        for k, file in zip(many[at:upto], predicted([images[k] for k in many[at:upto]]), strict=True):
            out[k] = file
        at = upto
    return out


def few_colours(image: np.ndarray) -> bool:
    """Whether ``webp.encode_by_content`` takes a palette; the first pixels alone may have too many colours for it."""
    pixels = np.ascontiguousarray(image).view(np.uint32).reshape(-1)
    for some in (pixels[:FIRST], pixels) if len(pixels) > FIRST else (pixels,):
        colours = len(np.unique(some))
        if colours > 256 or 2 * colours > len(pixels):
            return False
    return True


def chosen_modes(p: np.ndarray, n: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each tile the predictor of least cost, and what the predictors leave."""
    around = webp.neighbours(p, WIDTH)
    first = np.cumsum(n) - n
    edge = np.arange(0, len(p), WIDTH)
    top = (first[:, None] + np.arange(1, WIDTH)).reshape(-1)
    left = []
    for mode in webp.MODES:
        guess = np.array(webp.predict(mode, *around))
        guess[edge] = around[1][edge]
        guess[top] = p[top - 1]
        guess[first] = webp.BLACK
        left.append(p - guess)
    costs = []
    for r in left:
        a, b, c, e = (webp.COST[r[:, k]] for k in range(4))
        costs.append(np.bincount(tile, a + b + c + e))
    which = np.argmin(costs, axis=0)
    out, own = left[0], which[tile]
    for k in range(1, len(left)):
        here = own == k
        out[here] = left[k][here]
    return np.array(webp.MODES)[which], out


def chosen_factors(p: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``webp.least_factors`` of every tile, and the pixels that they leave."""
    green, red = webp.signed(p[:, 2]), webp.signed(p[:, 1])

    def best(plane: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tried = [plane - ((f * by) >> 5).astype(np.uint8) for f in webp.FACTORS]
        which = np.argmin([np.bincount(tile, webp.COST[t]) for t in tried], axis=0)
        own = which[tile]
        return np.array(webp.FACTORS)[which], np.where(own == 0, tried[0], np.where(own == 1, tried[1], tried[2]))

    to_red, left_red = best(p[:, 1], green)
    to_blue, blue = best(p[:, 3], green)
    red_to_blue, left_blue = best(blue, red)
    return np.column_stack([to_red, to_blue, red_to_blue]), np.column_stack([p[:, 0], left_red, p[:, 2], left_blue])


def predicted(images: Sequence[np.ndarray]) -> list[bytes]:
    d, bits = len(images), webp.TILE_BITS
    high = np.array([len(i) for i in images])
    n = high * WIDTH
    ends = np.cumsum(n)
    p = np.concatenate([i.reshape(-1, 4) for i in images])[:, [3, 0, 1, 2]]
    doc = np.repeat(np.arange(d), n)
    tiles = (high + (1 << bits) - 1) >> bits
    first = np.cumsum(tiles) - tiles
    row = np.arange(len(p)) - (ends - n)[doc]
    tile = first[doc] + (row // WIDTH >> bits)
    modes, p = chosen_modes(p, n, tile)
    factors, p = chosen_factors(p, tile)
    argb = webp.join(p)
    every, one = np.arange(d), np.ones(d, np.int64)
    sections = [
        (every, 0x2F | (WIDTH - 1) << 8 | high - 1 << 22 | 1 << 36, 40 * one),
        (every, (1 | webp.PREDICTOR << 1 | bits - 2 << 3) * one, 6 * one),
        small_images((modes.astype(np.uint32) << 8) | np.uint32(0xFF000000), first, tiles),
        (every, (1 | webp.CROSS_COLOUR << 1 | bits - 2 << 3) * one, 6 * one),
        small_images(webp.join(np.column_stack([np.full(len(factors), 255), factors[:, [2, 1, 0]]]) & 255), first, tiles),
    ]
    # The cache, where it pays.
    size = webp.CACHE_BITS
    slots = argb.astype(np.uint64) * np.uint64(webp.CACHE_FACTOR) << np.uint64(32) >> np.uint64(64 - size)
    before = last_equal(doc.astype(np.uint64) << np.uint64(24 + size) | slots << np.uint64(24), doc)
    hit = (before >= 0) & (argb[before] == argb)
    cached = np.bincount(doc[hit], minlength=d) * 16 >= n
    hit &= cached[doc]
    sections.append((every, np.where(cached, 2 | size << 2, 0), np.where(cached, 7, 3)))
    green, literal, starts = p[:, 2].astype(np.int64), ~hit, np.ones(len(p), bool)
    green[hit] = 280 + slots[hit].astype(np.int64)
    copies, near = matches(argb, doc, ends), webp.near_codes(WIDTH)
    far = []
    for at, length, distance in copies:
        starts[at + 1 : at + length] = False
        literal[at : at + length] = False
        far.append((at, *webp.prefix_of(length), *webp.prefix_of(near.get(distance, distance + 120))))
    far = np.array(far, np.int64).reshape(-1, 7)
    green[far[:, 0]] = 256 + far[:, 1]
    s = 280 + (1 << size)
    counts = [np.bincount(doc[starts] * s + green[starts], minlength=d * s).reshape(d, s)]
    at_literal = doc[literal] << 8
    counts += [np.bincount(at_literal | p[literal, k], minlength=d << 8).reshape(d, 256) for k in (1, 3, 0)]
    counts.append(np.bincount(doc[far[:, 0]] * 40 + far[:, 4], minlength=d * 40).reshape(d, 40))
    shared = np.min([np.count_nonzero(c, axis=1) for c in counts[1:4]], axis=0) > 2
    lengths = [code_lengths(counts[0]), code_lengths(np.where(shared[:, None], counts[1] + counts[2] + counts[3], counts[1]))]
    own = np.flatnonzero(~shared)
    for c in counts[2:4]:
        made = lengths[1].copy()
        made[own] = code_lengths(c[own]) if len(own) else made[own]
        lengths.append(made)
    lengths.append(code_lengths(counts[4]))
    together = not len(own)
    codes = []
    for k, (made, alphabet) in enumerate(zip(lengths, (np.where(cached, s, 280), 256 * one, 256 * one, 256 * one, 40 * one), strict=True)):
        again = together and k in (2, 3)
        sections.append(sections[-1] if again else code_headers(made, alphabet))
        codes.append(codes[-1] if again else code_bits(made))
    place = doc * s + green
    value, size = codes[0][0].reshape(-1)[place], codes[0][1].reshape(-1)[place]
    for plane, (code, n_bits) in zip((1, 3, 0), codes[1:4], strict=True):
        place = doc << 8 | p[:, plane]
        value |= np.where(literal, code.reshape(-1)[place] << size, 0)
        size += np.where(literal, n_bits.reshape(-1)[place], 0)
    at, doc_at = far[:, 0], doc[far[:, 0]]
    for more, took in ((far[:, 2], far[:, 3]), (codes[4][0][doc_at, far[:, 4]], codes[4][1][doc_at, far[:, 4]]), (far[:, 5], far[:, 6])):
        value[at] |= more << size[at]
        size[at] += took
    sections.append((doc[starts], value[starts], size[starts]))
    return [webp.riff(stream) for stream in streams(sections, d)]


# ---- reading ----

#: What an image of equal pixels without a cache has at the place of its five codes: each a lone symbol of eight bits.
LONE = sum(7 << (1 + 11 * k) for k in range(5)) | 1
LONE_IS = sum(5 << (1 + 11 * k) for k in range(5))
#: Of prefixes of lengths and distances: what they begin at, and how many bits follow.
FOLLOW = np.array([max(k - 2, 0) >> 1 for k in range(40)])
BEGIN = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])
NEAR = np.array([0, *[max(dx + dy * WIDTH, 1) for dx, dy in webp.NEAR]])


def lone_pixel(v: int) -> int | None:
    """The pixel of an image of equal ones, from its bits."""
    if v & LONE != LONE_IS:
        return None
    green, red, blue, alpha = (v >> (4 + 11 * k) & 255 for k in range(4))
    return alpha << 24 | red << 16 | green << 8 | blue


class Front:
    """What stands before the pixels of a stream with predictor and cross-colour; ``at`` is None for any other."""

    def __init__(self, data: bytes):
        self.at = None
        r = webp.Reader(data, 8)
        v = int.from_bytes(data[:32], "little")
        self.height = (v >> 22 & 0x3FFF) + 1
        if v & 255 != 0x2F or v >> 37 & 7 or (v >> 8 & 0x3FFF) + 1 != WIDTH or v >> 40 & 7 != 1:
            return
        r.at, self.images = 43, []
        for kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            v = int.from_bytes(data[r.at >> 3 : (r.at >> 3) + 16], "little") >> (r.at & 7)
            if kind == webp.CROSS_COLOUR:
                if v & 7 != 3:
                    return
                v, r.at = v >> 3, r.at + 3
            bits = (v & 7) + 2
            if bits < 4:
                return
            high = webp.blocks(self.height, bits)
            r.at += 3
            pixel = lone_pixel(v >> 3)
            if pixel is None:
                image = webp.read_image(r, 1, high, False)
            else:
                image, r.at = [pixel] * high, r.at + 56
            self.images.append((bits, image))
        v = int.from_bytes(data[r.at >> 3 : (r.at >> 3) + 2], "little") >> (r.at & 7)
        self.cache_bits = v >> 2 & 15 if v & 2 else 0
        r.at += 6 if v & 2 else 2
        meta = v >> (6 if v & 2 else 2) & 1
        if not v & 1 and not meta and self.cache_bits <= webp.CACHE_BITS:
            self.at = r.at + 1


def tables(lengths: np.ndarray, fixed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lookup tables of all rows, one after another (symbol, and its length above 16 bits), where each begins, and the masks."""
    used = np.count_nonzero(lengths, axis=1)
    longest = np.where(used > 1, lengths.max(axis=1), 0)
    wide = np.full(len(lengths), fixed) if fixed else longest
    d, s = lengths.shape
    order = np.argsort(np.where(lengths > 0, lengths, 99) * s + np.arange(s), axis=1)[:, : max(int(used.max()), 1)]
    n = np.take_along_axis(lengths, order, axis=1)
    alone = used <= 1
    n[alone] = 0
    width = np.where(n > 0, 1 << np.maximum(wide[:, None] - n, 0), 0)
    width[alone, 0] = 1 << wide[alone]
    order[used == 0] = 0
    size = 1 << wide
    if (width.sum(axis=1) != size).any():
        raise ValueError("prefix code is not complete")
    straight = np.repeat((order | n << 16).reshape(-1), width.reshape(-1)).astype(np.int32)
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(d), size)
    place = np.arange(len(straight)) - base[row]
    return straight[(TURNED[place] >> (15 - wide)[row]) + base[row]], base, size - 1


def read_codes(words: np.ndarray, at: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The lengths of the code that stands at each place; the places move behind them."""
    d, s = len(at), int(alphabet.max())
    out = np.zeros((d, s), np.int64)
    w = words[at >> 3] >> (at & 7)
    simple = np.flatnonzero(w & 1)
    v = w[simple]
    two, wide = v >> 1 & 1, v >> 2 & 1
    first, second = v >> 3 & np.where(wide, 255, 1), v >> np.where(wide, 11, 4) & 255
    if (first >= alphabet[simple]).any() or (two & (second >= alphabet[simple])).any():
        raise ValueError("symbol beyond its alphabet")
    out[simple, first] = 1
    out[simple[two > 0], second[two > 0]] = 1
    at[simple] += 4 + 7 * wide + 8 * two
    rows = np.flatnonzero(~w & 1)
    if not len(rows):
        return out
    place, most = at[rows], alphabet[rows]
    count = 4 + (w[rows] >> 1 & 15)
    w = words[place + 5 >> 3] >> (place + 5 & 7)
    small = np.zeros((len(rows), 19), np.int64)
    small[:, ORDER] = np.where(np.arange(19) < count[:, None], w[:, None] >> (3 * np.arange(19)) & 7, 0)
    table, base, _ = tables(small, 7)
    place = place + 5 + 3 * count
    w = words[place >> 3] >> (place & 7)
    limited, n = w & 1, 2 + 2 * (w >> 1 & 7)
    left = np.where(limited, 2 + (w >> 4 & (1 << n) - 1), most)
    place += np.where(limited, 4 + n, 1)
    filled, last, end = np.zeros(len(rows), np.int64), np.full(len(rows), 8), 8 * len(words) - 8
    more, begin = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])
    values, times = [], []
    for turn in range(s):
        live = (filled < most) & (left > turn)
        if not live.any():
            break
        if (place > end).any():
            raise ValueError("the stream ends early")
        w = words[place >> 3] >> (place & 7)
        e = table[base + (w & 127)]
        symbol, used = e & 0xFFFF, e >> 16
        plain = symbol < 16
        many = begin[symbol] + (w >> used & (1 << more[symbol]) - 1)
        values.append(np.where(plain, symbol, np.where(symbol == 16, last, 0)))
        many = np.where(live, np.minimum(many, most - filled), 0)
        times.append(many)
        filled += many
        last = np.where(plain & (symbol > 0), symbol, last)
        place += np.where(live, used + more[symbol], 0)
    values.append(np.zeros(len(rows), np.int64))
    times.append(s - filled)
    out[rows] = np.repeat(np.array(values).T.reshape(-1), np.array(times).T.reshape(-1)).reshape(-1, s)
    at[rows] = place
    return out


def repeated(buffer: bytes, first: list[int], behind: list[int]) -> np.ndarray:
    """Whether the bits from first to behind stand there twice more."""

    def same(a: int, b: int) -> bool:
        n = b - a
        v = int.from_bytes(buffer[a >> 3 : (a + 3 * n >> 3) + 1], "little") >> (a & 7)
        own, mask = v & (1 << n) - 1, (1 << n) - 1
        return v >> n & mask == own == v >> 2 * n & mask

    return np.array([same(a, b) for a, b in zip(first, behind, strict=True)], bool)


def read_pixels(data: list[bytes], fronts: list[Front]) -> list[np.ndarray]:
    """Entropy-coded pixels of streams, the largest first, read side by side."""
    d, n = len(data), np.array([f.height * WIDTH for f in fronts])
    sizes = np.array([len(s) for s in data])
    starts = np.cumsum(sizes) - sizes
    buffer = b"".join(data) + bytes(512)
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buffer, np.uint8), 8).copy().view("<i8")[:, 0]
    at, ends = starts * 8 + np.array([f.at for f in fronts]), (starts + sizes) * 8
    cache_bits = np.array([f.cache_bits for f in fronts])
    lengths = [read_codes(words, at, 280 + np.where(cache_bits > 0, 1 << cache_bits, 0))]
    before = at.copy()
    lengths.append(read_codes(words, at, np.full(d, 256)))
    again = repeated(buffer, before.tolist(), at.tolist())
    at[again] += 2 * (at - before)[again]
    rest = np.flatnonzero(~again)
    for _ in range(2):
        made, place = lengths[1].copy(), at[rest]
        if len(rest):
            made[rest] = read_codes(words, place, np.full(len(rest), 256))
            at[rest] = place
        lengths.append(made)
    lengths.append(read_codes(words, at, np.full(d, 40)))
    if (at > ends).any():
        raise ValueError("the stream ends early")
    built = [tables(lengths[0]), tables(lengths[1])]
    built += [built[1], built[1]] if not len(rest) else [tables(k) for k in lengths[2:4]]
    built.append(tables(lengths[4]))
    (green_at, green_base, green_mask), (red_at, red_base, red_mask), (blue_at, blue_base, blue_mask), (alpha_at, alpha_base, alpha_mask), (far_at, far_base, far_mask) = built
    if (np.log2((green_mask + 1.0) * (red_mask + 1) * (blue_mask + 1) * (alpha_mask + 1)) > 56).any():  # more bits than a word surely holds
        return [webp.read_symbols(webp.Reader(s, int(a)), [codes_of(lengths, k)], None, 0, WIDTH, int(n[k]) // WIDTH, int(cache_bits[k])) for k, (s, a) in enumerate(zip(data, at - starts * 8, strict=True))]
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int64)
    todo, apart = np.zeros(d, np.int64), np.ones(d, np.int64)
    keeps = np.flatnonzero(cache_bits)
    slots, down = np.zeros((d, 1 << webp.CACHE_BITS), np.int64), 32 - cache_bits
    turns, smaller = int(n[min(SIDE_BY_SIDE, d) - 1]) if d >= SIDE_BY_SIDE else 0, np.sort(n)
    live = kept = 0
    for turn in range(turns):
        if turn % WIDTH == 0:
            live = d - int(np.searchsorted(smaller, turn, side="right"))
            kept = int(np.searchsorted(keeps, live))
            if (at > ends).any():
                raise ValueError("the stream ends early")
            place, goal, waits = at[:live], first[:live], todo[:live]
        w = words[place >> 3] >> (place & 7)
        e = green_at[green_base[:live] + (w & green_mask[:live])]
        green, took = e & 0xFFFF, e >> 16
        w >>= took
        e = red_at[red_base[:live] + (w & red_mask[:live])]
        red = e & 0xFFFF
        took += e >> 16
        w >>= e >> 16
        e = blue_at[blue_base[:live] + (w & blue_mask[:live])]
        blue = e & 0xFFFF
        took += e >> 16
        w >>= e >> 16
        e = alpha_at[alpha_base[:live] + (w & alpha_mask[:live])]
        took += e >> 16
        pixel = blue | green << 8 | red << 16 | (e & 0xFFFF).astype(np.int64) << 24
        copying = waits > 0
        other = np.flatnonzero((green > 255) | copying)
        if len(other):
            took[other] = 0
            begin = other[~copying[other]]
            s = green[begin]
            hits, refs = begin[s >= 280], begin[s < 280]
            for k in (hits, refs):
                a = place[k]
                place[k] = a + (green_at[green_base[k] + (words[a >> 3] >> (a & 7) & green_mask[k])] >> 16)
            if len(hits):
                pixel[hits] = slots[hits, green[hits] - 280]
            if len(refs):
                s, a = green[refs] - 256, place[refs]
                length = BEGIN[s] + (words[a >> 3] >> (a & 7) & (1 << FOLLOW[s]) - 1)
                a += FOLLOW[s]
                e = far_at[far_base[refs] + (words[a >> 3] >> (a & 7) & far_mask[refs])]
                s, a = e & 0xFFFF, a + (e >> 16)
                gap = BEGIN[s] + (words[a >> 3] >> (a & 7) & (1 << FOLLOW[s]) - 1)
                place[refs] = a + FOLLOW[s]
                gap = np.where(gap > 120, gap - 120, NEAR[np.minimum(gap, 120)])
                if (gap > turn).any():
                    raise ValueError("back-reference before the first pixel")
                waits[refs], apart[refs] = length, gap
            copied = np.flatnonzero(waits)
            pixel[copied] = out[goal[copied] + turn - apart[copied]]
            waits[copied] -= 1
        place += took
        out[goal + turn] = pixel
        if kept:
            k = keeps[:kept]
            slots[k, (pixel[k] * webp.CACHE_FACTOR & 0xFFFFFFFF) >> down[k]] = pixel[k]
    if (at > ends).any():
        raise ValueError("the stream ends early")
    done = []
    for k in range(d):
        own = out[first[k] : first[k] + n[k]]
        if n[k] > turns:
            pixels, copy = own[:turns].tolist(), min(int(todo[k]), int(n[k]) - turns)
            for _ in range(copy):
                pixels.append(pixels[-int(apart[k])])
            r = webp.Reader(data[k], int(at[k] - starts[k] * 8))
            own = webp.read_symbols(r, [codes_of(lengths, k)], None, 0, WIDTH, fronts[k].height, int(cache_bits[k]), pixels)
        done.append(own)
    return done


def codes_of(lengths: list[np.ndarray], row: int) -> list[webp.PrefixCode]:
    return [webp.code_of(k[row].astype(np.uint8).tobytes()) for k in lengths]


def decode(data: Sequence[bytes]) -> list[np.ndarray]:
    """``webp.decode_stream`` of every stream; those with other transforms than ``predicted`` writes are read one by one."""
    out: list[np.ndarray] = [np.zeros(0)] * len(data)
    fronts = [Front(s) for s in data]
    order = sorted((k for k, f in enumerate(fronts) if f.at is not None), key=lambda k: -fronts[k].height)
    for k, f in enumerate(fronts):
        if f.at is None:
            out[k] = webp.decode_stream(data[k])
    at = 0
    while at < len(order):
        size, upto = 0, at
        while upto < len(order) and (upto == at or size + fronts[order[upto]].height <= MOST_ROWS):
            size, upto = size + fronts[order[upto]].height, upto + 1
        some = order[at:upto]
        for k, image in zip(some, restored([data[k] for k in some], [fronts[k] for k in some]), strict=True):
            out[k] = image
        at = upto
    return out


def restored(data: list[bytes], some: list[Front]) -> list[np.ndarray]:
    """The images of streams that ``predicted`` could have written, the tallest first."""
    argb = np.concatenate(read_pixels(data, some))
    p = webp.planes(argb)
    high = np.array([f.height for f in some])
    doc, row = np.repeat(np.arange(len(some)), high), np.arange(int(high.sum())) - np.repeat(np.cumsum(high) - high, high)
    tiles = []
    for k in (0, 1):
        bits, count = np.array([f.images[k][0] for f in some]), np.array([len(f.images[k][1]) for f in some])
        pixels = np.concatenate([np.asarray(f.images[k][1], np.uint32) for f in some])
        tiles.append(pixels[(np.cumsum(count) - count)[doc] + (row >> bits[doc])])
    p = webp.cross_colour(p, 1, np.repeat(webp.planes(tiles[1])[:, [3, 2, 1]], WIDTH, axis=0), 0, True)
    rows = unpredicted(p.reshape(-1, WIDTH, 4), high, (tiles[0] >> 8 & 255).astype(np.int64), some)
    return [np.ascontiguousarray(image[:, :, [1, 2, 3, 0]]) for image in np.split(rows, np.cumsum(high)[:-1])]


def unpredicted(rest: np.ndarray, high: np.ndarray, modes: np.ndarray, fronts: list[Front]) -> np.ndarray:
    """Residuals to pixels, the same row of all images at a time (``high`` falls); ``modes`` by row. The tallest images, and those with other predictors than ``webp.MODES``, go alone."""
    out, first = np.empty_like(rest), np.cumsum(high) - high
    head = rest[first]
    head[:, 0] += webp.BLACK
    out[first] = np.cumsum(head, axis=1, dtype=np.uint8)
    turns, smaller = int(high[SIDE_BY_SIDE - 1]) if len(high) >= SIDE_BY_SIDE else 1, np.sort(high)
    for turn in range(1, turns):
        at = first[: len(high) - int(np.searchsorted(smaller, turn, side="right"))] + turn
        over, part, mode = out[at - 1], rest[at], modes[at]
        part[:, 0] += over[:, 0]
        for k in np.flatnonzero(np.bincount(mode)).tolist():
            own = np.flatnonzero(mode == k)
            if k == 1:
                part[own] = np.cumsum(part[own], axis=1, dtype=np.uint8)
            elif k in webp.MODES:
                above = over[own]
                part[own, 1:] += webp.predict(k, above[:, 1:], above[:, 1:], above[:, 1:], above[:, :-1])
        out[at] = part
    odd = np.add.reduceat((~np.isin(modes, webp.MODES)).astype(np.int64), first) > 0
    for k in np.flatnonzero(odd | (high > turns)).tolist():
        a, b, (bits, image) = first[k], first[k] + high[k], fronts[k].images[0]
        out[a:b] = webp.invert_prediction(rest[a:b].reshape(-1, 4), WIDTH, np.asarray(image, np.uint32) >> 8 & 255, bits).reshape(-1, WIDTH, 4)
    return out

"""Lossless WebP (VP8L) after its public specification: a decoder, and an encoder that chooses its tools by content.

Images are uint8 arrays (height, width, 4) in the order red, green, blue, alpha. The decoder reads prefix
codes, back-references, the colour cache and meta prefix codes symbol by symbol through lookup tables, and inverts
the predictor, cross-colour, subtract-green and colour-indexing (palette) transforms on whole rows of
pixels. Only predictors that look at the pixel to the left have to go pixel by pixel.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import cache, lru_cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MOST = 1 << 14  # pixels of a side
WINDOW = 1 << 15  # bytes of a stream that are laid out for reading at a time

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)  # green with lengths, red, blue, alpha, distance
CACHE_FACTOR = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


@cache
def reversed_order(n: int) -> np.ndarray:
    """The n-bit numbers with their bits turned round."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class Codes:
    """A canonical prefix code by its lengths: bits as they stand in the stream, and how many. A lone symbol takes none."""

    def __init__(self, lengths: Sequence[int]):
        lengths = np.asarray(lengths, np.int64)
        self.bits, self.n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        self.used = used = np.flatnonzero(lengths)
        self.longest = 0
        if len(used) > 1:
            n = lengths[used]
            self.longest = longest = int(n.max())
            order = np.argsort(n, kind="stable")
            self.sorted, width = used[order], 1 << (longest - n[order])
            ends = np.cumsum(width)
            if ends[-1] != 1 << longest:
                raise ValueError("prefix code is not complete")
            self.width = width
            self.bits[self.sorted], self.n[self.sorted] = reversed_order(longest)[ends - width], n[order]

    def __getitem__(self, symbol: int) -> tuple[int, int]:
        return int(self.bits[symbol]), int(self.n[symbol])


def blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


# ---- decoding ----


class Reader:
    """Bits of a stream; ``word`` gives at least 57 of them from any place."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.first, self.words = bytes(data), at, 0, []

    def layout(self, at: int) -> None:
        """Lay out the 64 bits that start at each byte of a window."""
        self.first = at >> 3
        if self.first > len(self.data):
            raise ValueError("the stream ends early")
        part = self.data[self.first : self.first + WINDOW + 8]
        padded = np.frombuffer(part + bytes(16), np.uint8)
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: min(WINDOW, len(part) + 1)].copy().view("<u8")[:, 0].tolist()

    def word(self, at: int) -> int:
        k = (at >> 3) - self.first
        if not 0 <= k < len(self.words):
            self.layout(at)
            k = 0
        return self.words[k] >> (at & 7)

    def bits(self, n: int) -> int:
        value = self.word(self.at) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, code: PrefixCode) -> int:
        e = code.table[self.word(self.at) & code.mask]
        self.at += e >> 32
        return e & 0xFFFFFFFF


class PrefixCode:
    """A lookup table over as many bits as the longest code has: the symbol, and its length above 32 bits."""

    def __init__(self, lengths: bytes | Sequence[int]):
        codes = Codes(np.frombuffer(bytes(lengths), np.uint8))
        self.mask = (1 << codes.longest) - 1
        if not codes.longest:
            self.entries = codes.used[:1] if len(codes.used) else np.zeros(1, np.int64)
        else:
            entries = np.repeat(codes.sorted | codes.n[codes.sorted] << 32, codes.width)
            self.entries = entries[reversed_order(codes.longest)]
        self.table = self.entries.tolist()
        self.moved: dict[int, list[int]] = {}

    def shifted(self, shift: int) -> list[int]:
        """The table with every symbol moved to its place in a pixel; symbols beyond 255 are negative."""
        if shift not in self.moved:
            symbol, length = self.entries & 0xFFFFFFFF, self.entries >> 32
            self.moved[shift] = np.where(symbol < 256, symbol << shift | length << 32, -self.entries).tolist()
        return self.moved[shift]


@lru_cache(4096)
def simple_lengths(alphabet: int, *symbols: int) -> list[int]:
    return [int(s in symbols) for s in range(alphabet)]


@lru_cache(4096)
def simple_code(alphabet: int, *symbols: int) -> PrefixCode:
    return PrefixCode(simple_lengths(alphabet, *symbols))


@lru_cache(4096)
def simple_codes(alphabet: int, *symbols: int) -> Codes:
    return Codes(simple_lengths(alphabet, *symbols))


_SEVEN = reversed_order(7).tolist()


def length_table(lengths: bytearray) -> tuple[list[int], int]:
    """Table and mask of the small code that code lengths are written in, as ``PrefixCode`` lays them out."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [used[0][1] if used else 0], 0
    longest, at = used[-1][0], 0
    size = 1 << longest
    table = [0] * size
    for n, s in used:
        if at >= size:
            break
        table[_SEVEN[at << (7 - longest)] :: 1 << n] = [s | n << 32] * (size >> n)
        at += size >> n
    if at != size:
        raise ValueError("prefix code is not complete")
    return table, size - 1


@lru_cache(64)
def code_of(lengths: bytes) -> PrefixCode:
    """The table of a code; channels often share one."""
    return PrefixCode(lengths)


def read_code(r: Reader, alphabet: int) -> PrefixCode:
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        first = r.bits(8 if wide else 1)
        symbols = {first, r.bits(8)} if two else {first}
        if max(symbols) >= alphabet:
            raise ValueError("symbol beyond its alphabet")
        return simple_code(alphabet, *sorted(symbols))
    lengths = [0] * alphabet
    own, n = bytearray(19), 4 + r.bits(4)
    w = r.word(r.at)  # 57 bits at least: all nineteen lengths
    r.at += 3 * n
    for k in LENGTH_ORDER[:n]:
        own[k] = w & 7
        w >>= 3
    table, mask = length_table(own)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    if (r.at >> 3) - r.first + 8 * alphabet // 4 > len(r.words):  # a symbol takes 14 bits at most
        r.layout(r.at)
    words, place, base = r.words, r.at - 8 * r.first, 8 * r.first
    at, last, end = 0, 8, 8 * len(words)
    while at < alphabet and left:
        left -= 1
        if place >= end:
            raise ValueError("the stream ends early")
        w = words[place >> 3] >> (place & 7)
        e = table[w & mask]
        n, used = e & 31, e >> 32
        if n < 16:
            lengths[at] = n
            at, last, place = at + 1, n or last, place + used
            continue
        w >>= used
        times, wide = (3 + (w & 3), 2) if n == 16 else (3 + (w & 7), 3) if n == 17 else (11 + (w & 127), 7)
        if n == 16:
            lengths[at : at + times] = [last] * times
        at, place = at + times, place + used + wide
    r.at = place + base
    return code_of(bytes(lengths[:alphabet]))


def extra(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + r.bits(n) + 1


def read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as uint32 ARGB, one after another."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    group_of, group_bits, n_groups = None, 0, 1
    if main and r.bits(1):
        group_bits = r.bits(3) + 2
        group_of = ((read_image(r, blocks(width, group_bits), blocks(height, group_bits), False) >> 8) & 0xFFFF).tolist()
        n_groups = max(group_of) + 1
    groups = [[read_code(r, n + ((1 << cache_bits) if k == 0 and cache_bits else 0)) for k, n in enumerate(ALPHABETS)] for _ in range(n_groups)]
    return read_symbols(r, groups, group_of, group_bits, width, height, cache_bits)


def read_symbols(r: Reader, groups: list[list[PrefixCode]], group_of: list[int] | None, group_bits: int, width: int, height: int, cache_bits: int, known: Sequence[int] = ()) -> np.ndarray:
    """Runs of literal pixels in a tight loop, as far as one group of codes reaches; other symbols one by one. ``known``: the pixels before the place of ``r``."""
    n, pixels, slots, cached = width * height, list(known), [0] * (1 << cache_bits), 0
    if len(groups) == 1 and not any(c.mask for c in groups[0][:4]) and groups[0][0].table[0] < 256:
        return np.full(n, sum(c.table[0] << shift for c, shift in zip(groups[0], (8, 16, 0, 24), strict=False)), np.uint32)
    across, down = blocks(width, group_bits), 32 - cache_bits
    laid = [(c[0].shifted(8), c[0].mask, c[1].shifted(16), c[1].mask, c[2].table, c[2].mask, c[3].shifted(24), c[3].mask, c[4]) for c in groups]
    green_at, green_mask, red_at, red_mask, blue_at, blue_mask, alpha_at, alpha_mask, far = laid[0]
    append, end, codes = pixels.append, n, groups[0]
    wide = max(sum(c.mask.bit_length() for c in g[:4]) for g in groups) > 57
    while len(pixels) < n:
        if group_of is not None:
            y, x = divmod(len(pixels), width)
            codes = groups[group_of[(y >> group_bits) * across + (x >> group_bits)]]
            green_at, green_mask, red_at, red_mask, blue_at, blue_mask, alpha_at, alpha_mask, far = laid[group_of[(y >> group_bits) * across + (x >> group_bits)]]
            end = min(len(pixels) - x + min(((x >> group_bits) + 1) << group_bits, width), n)
        r.word(r.at)
        words, at = r.words, r.at - 8 * r.first
        limit, green = 8 * len(words), 0
        if wide:  # more bits than a word surely holds
            green = green_at[r.word(r.at) & green_mask]
            if green >= 0:
                argb = 0
                for k, shift in enumerate((8, 16, 0, 24)):
                    argb |= r.symbol(codes[k]) << shift
                append(argb)
                continue
        for _ in range(0 if wide else end - len(pixels)):
            if at >= limit:
                break
            w = words[at >> 3] >> (at & 7)
            green = green_at[w & green_mask]
            if green < 0:
                break
            w >>= green >> 32
            red = red_at[w & red_mask]
            w >>= red >> 32
            blue = blue_at[w & blue_mask]
            w >>= blue >> 32
            whole = green + red + blue + alpha_at[w & alpha_mask]
            at += whole >> 32
            append(whole & 0xFFFFFFFF)
        r.at = at + 8 * r.first
        if green >= 0:
            if at >= limit:
                r.layout(r.at)
            continue
        r.at += -green >> 32
        s = -green & 0xFFFFFFFF
        if s < 280:
            length = extra(r, s - 256)
            d = extra(r, r.symbol(far))
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(dx + dy * width, 1)
            if d > len(pixels):
                raise ValueError("back-reference before the first pixel")
            length = min(length, n - len(pixels))
            if d >= length:
                pixels += pixels[len(pixels) - d : len(pixels) - d + length]
            else:
                pixels += (pixels[-d:] * (length // d + 1))[:length]
        else:
            for p in pixels[cached:]:
                slots[(CACHE_FACTOR * p & 0xFFFFFFFF) >> down] = p
            cached = len(pixels)
            append(slots[s - 280])
    return np.array(pixels, np.uint32)


def planes(argb: np.ndarray) -> np.ndarray:
    """uint32 ARGB -> (n, 4) uint8 of alpha, red, green, blue."""
    return argb.astype(">u4").view(np.uint8).reshape(-1, 4)


def join(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p, np.uint8).view(">u4")[..., 0].astype(np.uint32)


BLACK = np.array([255, 0, 0, 0], np.uint8)


def half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean of bytes, rounded down, without leaving them."""
    return (a & b) + ((a ^ b) >> 1)


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The fourteen predictors of the format for uint8 pixels (..., 4)."""
    if mode == 11:
        l, t, c = (v.astype(np.int16) for v in (left, top, top_left))
        nearer = np.abs(t - c).sum(axis=-1, keepdims=True) < np.abs(l - c).sum(axis=-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left.astype(np.int16) + top - top_left, 0, 255).astype(np.uint8)
    if mode == 13:
        mean = half(left, top).astype(np.int16)
        apart = mean - top_left
        return np.clip(mean + np.sign(apart) * (np.abs(apart) >> 1), 0, 255).astype(np.uint8)
    simple = {
        1: lambda: left,
        2: lambda: top,
        3: lambda: top_right,
        4: lambda: top_left,
        5: lambda: half(half(left, top_right), top),
        6: lambda: half(left, top_left),
        7: lambda: half(left, top),
        8: lambda: half(top_left, top),
        9: lambda: half(top, top_right),
        10: lambda: half(half(left, top_left), half(top, top_right)),
    }
    return simple[mode]() if mode in simple else np.broadcast_to(BLACK, left.shape)


#: Predictors that look at the pixel to the left and can't be summed along a row.
STEPWISE = frozenset((5, 6, 7, 10, 11, 12, 13))


def invert_prediction(p: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """Residuals (n, 4) to pixels: whole tiles where sums do, else rows of a tile, pixel by pixel only for STEPWISE modes."""
    rest = p.reshape(-1, width, 4)
    out, height, across = np.empty_like(rest), len(rest), blocks(width, bits)
    first = rest[0].copy()
    first[0] += BLACK
    out[0] = np.cumsum(first, axis=0, dtype=np.uint8)
    edge = rest[:, 0].copy()
    edge[0] = out[0, 0]
    out[:, 0] = np.cumsum(edge, axis=0, dtype=np.uint8)
    for tile in range(blocks(height, bits)):
        y0, y1 = max(tile << bits, 1), min((tile + 1) << bits, height)
        if y0 >= y1:
            continue
        row_modes = modes[tile * across : (tile + 1) * across].tolist()
        if across == 1 and row_modes[0] in (0, 1, 2):
            part = rest[y0:y1]
            if row_modes[0] == 0:
                out[y0:y1, 1:] = part[:, 1:] + BLACK
            elif row_modes[0] == 1:
                part = part.copy()
                part[:, 0] = out[y0:y1, 0]
                out[y0:y1] = np.cumsum(part, axis=1, dtype=np.uint8)
            else:
                part = part.copy()
                part[0] += out[y0 - 1]
                out[y0:y1, 1:] = np.cumsum(part, axis=0, dtype=np.uint8)[:, 1:]
            continue
        for y in range(y0, y1):
            over, own = out[y - 1], out[y]
            right = np.concatenate([over[1:], own[:1]])
            for k, mode in enumerate(row_modes):
                x0, x1 = max(k << bits, 1), min((k + 1) << bits, width)
                if x0 >= x1:
                    continue
                part = rest[y, x0:x1]
                if mode == 1:
                    own[x0:x1] = np.cumsum(part, axis=0, dtype=np.uint8) + own[x0 - 1]
                elif mode in STEPWISE:
                    for x in range(x0, x1):
                        own[x] = rest[y, x] + predict(mode, own[x - 1], over[x], right[x], over[x - 1])
                else:
                    own[x0:x1] = part + predict(mode, part, over[x0:x1], right[x0:x1], over[x0 - 1 : x1 - 1])
    return out.reshape(-1, 4)


def signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int16)


def cross_colour(p: np.ndarray, width: int, factors: np.ndarray, bits: int, decode: bool) -> np.ndarray:
    """p: (n, 4) uint8; factors: (tiles, 3) of green to red, green to blue, red to blue."""
    f = signed(factors)
    if len(f) > 1:
        at = np.arange(len(p))
        f = f[((at // width) >> bits) * blocks(width, bits) + ((at % width) >> bits)]
    sign = 1 if decode else -1
    out, green = p.copy(), signed(p[:, 2])
    out[:, 1] += (sign * ((f[:, 0] * green) >> 5)).astype(np.uint8)
    red = signed(out[:, 1] if decode else p[:, 1])
    out[:, 3] += (sign * (((f[:, 1] * green) >> 5) + ((f[:, 2] * red) >> 5))).astype(np.uint8)
    return out


def decode_stream(data: bytes) -> np.ndarray:
    """VP8L data -> (height, width, 4) uint8."""
    if data[:1] != b"\x2f":
        raise ValueError("no VP8L stream")
    r = Reader(data, 8)
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    done, across = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            done.append((kind, bits, across, read_image(r, blocks(across, bits), blocks(height, bits), False)))
        elif kind == PALETTE:
            n = r.bits(8) + 1
            table = join(np.cumsum(planes(read_image(r, n, 1, False)), axis=0, dtype=np.uint8))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            done.append((kind, bits, across, table))
            across = blocks(across, bits)
        else:
            done.append((kind, 0, across, None))
    argb = read_image(r, across, height, True)
    p = None if done and done[-1][0] == PALETTE else planes(argb)
    for kind, bits, across, image in reversed(done):
        if kind == PALETTE:
            index = (argb >> 8) & 0xFF if p is None else p[:, 2].astype(np.uint32)
            if bits:
                per, step = 1 << bits, 8 >> bits
                index = ((index[:, None] >> (step * np.arange(per, dtype=np.uint32))) & ((1 << step) - 1)).reshape(height, -1)[:, :across].reshape(-1)
            p = planes(np.concatenate([image, np.zeros(256, np.uint32)])[index])
        elif kind == PREDICTOR:
            p = invert_prediction(p, across, (image >> 8) & 0xFF, bits)
        elif kind == CROSS_COLOUR:
            p = cross_colour(p, across, planes(image)[:, [3, 2, 1]], bits, True)
        else:
            p = p.copy()
            p[:, 1] += p[:, 2]
            p[:, 3] += p[:, 2]
    return np.ascontiguousarray(p[:, [1, 2, 3, 0]]).reshape(height, width, 4)


def images(data: bytes) -> list[np.ndarray]:
    """The images of one or more lossless WebP files, one after another."""
    return [decode_stream(stream) for stream in streams_of(data)]


def streams_of(data: bytes) -> list[bytes]:
    """The VP8L data of one or more files, one after another."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("no lossless WebP file")
        size, n = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<I", data, at + 16)[0]
        out.append(data[at + 20 : at + 20 + n])
        at += 8 + size + (size & 1)
    return out


# ---- encoding ----


class Writer:
    """Values of up to 32 bits, put together all at once in the end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values, self.sizes = [], []

    def bits(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []
        self.parts.append((values, sizes))

    def bytes(self) -> bytes:
        self.many(np.zeros(0, np.int64), np.zeros(0, np.int64))
        values, sizes = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        ends = np.cumsum(sizes)
        starts, total = ends - sizes, int(ends[-1]) if len(ends) else 0
        moved = values.astype(np.uint64) << (starts & 31).astype(np.uint64)
        place, n = starts >> 5, (total >> 5) + 2
        low = np.bincount(place, (moved & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = np.bincount(place + 1, (moved >> np.uint64(32)).astype(np.float64), n + 1)[:n]
        return (low + high).astype(np.uint64).astype("<u4").tobytes()[: (total + 7) // 8]


def code_lengths(counts: Sequence[int], longest: int = 10) -> np.ndarray:
    """Lengths of a complete prefix code: the logarithms of the shares rounded up, then shortened from the most frequent on."""
    counts = np.asarray(counts, np.float64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used[0] if len(used) else 0] = 1
        return lengths
    own = counts[used]
    own = np.maximum(own, own.sum() / (1 << (longest - 1)))
    n = np.ceil(np.log2(own.sum() / own) - 1e-9).astype(np.int64)
    n = np.clip(n, 1, longest)
    order = np.argsort(-own, kind="stable")
    n = n[order].tolist()
    free = (1 << longest) - sum(1 << (longest - k) for k in n)
    while free < 0:  # rounding of the logarithms alone could lead here
        k = max((k for k in range(len(n)) if n[k] < longest), key=lambda k: n[k])
        free += 1 << (longest - n[k] - 1)
        n[k] += 1
    while free:
        for k, size in enumerate(n):
            if size > 1 and 1 << (longest - size) <= free:
                free -= 1 << (longest - size)
                n[k] -= 1
    lengths[used[order]] = n
    return lengths


def code_header(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The stream's bits for a code, values and sizes: simple if it can be, else with repeats of equal lengths."""
    values = np.asarray(lengths, np.int64)
    used = np.flatnonzero(values).tolist()
    if len(used) <= 2 and used[-1] < 256:
        return np.array([1 | (len(used) - 1) << 1 | 1 << 2, *used]), np.array([3, *[8] * len(used)])
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)).tolist()
    runs, at, last = [], 0, 8  # symbol, then what follows it and its size above 5 and 12 bits
    for end, n in zip(ends, values[[0, *ends[:-1]]].tolist(), strict=True):
        if n and n != last:
            runs.append(n)
            at, last = at + 1, n
        while end - at >= 3:
            times = min(end - at, 6 if n else 138)
            runs.append(16 | times - 3 << 5 | 2 << 12 if n else 17 | times - 3 << 5 | 3 << 12 if times <= 10 else 18 | times - 11 << 5 | 7 << 12)
            at += times
        while end > at:
            runs.append(n)
            at += 1
    every = np.array(runs)
    symbols, rest, sizes = every & 31, every >> 5 & 127, every >> 12
    own = code_lengths(np.bincount(symbols, minlength=19), 7)
    of_lengths = Codes(own)
    n = of_lengths.n[symbols]
    return np.concatenate([[0, 15], own[list(LENGTH_ORDER)], [0], of_lengths.bits[symbols] | rest << n]), np.concatenate([[1, 4], np.full(19, 3), [1], n + sizes])


def write_code(w: Writer, lengths: Sequence[int]) -> Codes:
    w.many(*code_header(lengths))
    used = np.flatnonzero(lengths)
    return simple_codes(len(lengths), *used.tolist()) if len(used) <= 2 else Codes(lengths)


def prefix_of(value: int) -> tuple[int, int, int]:
    """length or distance -> (prefix, extra bits' value, their number)."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


@cache
def near_codes(width: int) -> dict[int, int]:
    """distance in pixels -> its short code, for an image so wide."""
    return {max(dx + dy * width, 1): k for k, (dx, dy) in reversed(list(enumerate(NEAR, 1)))}


def last_equal(keys: np.ndarray) -> np.ndarray:
    """The place of the last equal key before each, or -1."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def matches(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy back-references of at least three pixels to the last place of the same three: place, length, distance."""
    if len(argb) < 4:
        return []
    wide = argb.astype(np.uint64)
    before = last_equal((wide[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (wide[2:] * np.uint64(0x165667B19E3779F9)))
    out, end, n = [], 0, len(argb)
    for at in np.flatnonzero(before >= 0).tolist():
        if at < end:
            continue
        source, length, step = int(before[at]), 0, 16
        while length < 4096 and at + length < n:
            most = min(step, 4096 - length, n - at - length)
            apart = np.flatnonzero(argb[source + length : source + length + most] != argb[at + length : at + length + most])
            if len(apart):
                length += int(apart[0])
                break
            length, step = length + most, step * 4
        if length >= 3:
            out.append((at, length, at - source))
            end = at + length
    return out


def cache_slots(argb: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's slot, and whether the cache holds the pixel there when its turn comes."""
    slots = ((argb.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
    before = last_equal(slots)
    return slots, (before >= 0) & (argb[before] == argb)


def write_image(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    w.bits(int(cache_bits > 0), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if main:
        w.bits(0, 1)
    n = len(argb)
    if n == 1 and not cache_bits:  # five codes of a lone symbol
        pixel = int(argb[0])
        for value in (pixel >> 8 & 255, pixel >> 16 & 255, pixel & 255, pixel >> 24, 0):
            w.bits(5 | value << 3, 11)
        return
    p = planes(argb).astype(np.int64)
    green, literal, starts = p[:, 2].copy(), np.ones(n, bool), np.ones(n, bool)
    if cache_bits:
        slots, hit = cache_slots(argb, cache_bits)
        green[hit], literal[hit] = 280 + slots[hit], False
    copies = matches(argb) if references else []
    values, sizes = np.zeros((n, 4), np.int64), np.zeros((n, 4), np.int64)
    far, near = [], near_codes(width)
    for at, length, distance in copies:
        starts[at + 1 : at + length] = False
        literal[at : at + length] = False
        prefix, rest, size = prefix_of(length)
        green[at], values[at, 1], sizes[at, 1] = 256 + prefix, rest, size
        prefix, rest, size = prefix_of(near.get(distance, distance + 120))
        far.append((at, prefix))
        values[at, 3], sizes[at, 3] = rest, size
    counts = [np.bincount(green[starts], minlength=280 + ((1 << cache_bits) if cache_bits else 0))]
    counts += [np.bincount(p[literal, k], minlength=256) for k in (1, 3, 0)]
    counts.append(np.bincount([f for _, f in far], minlength=40) if far else np.zeros(40, np.int64))
    shared = min(np.count_nonzero(c) for c in counts[1:4]) > 2  # red, blue and alpha share a code
    codes = [write_code(w, code_lengths(counts[0]))]
    if shared:
        lengths = code_lengths(counts[1] + counts[2] + counts[3])
        part = code_header(lengths)
        for _ in range(3):
            w.many(*part)
        codes += [Codes(lengths)] * 3
    else:
        codes += [write_code(w, code_lengths(c)) for c in counts[1:4]]
    codes.append(write_code(w, code_lengths(counts[4])))
    values[:, 0], sizes[:, 0] = codes[0].bits[green], codes[0].n[green]
    for column, (code, plane) in enumerate(zip(codes[1:4], (1, 3, 0), strict=True), 1):
        if code.longest:
            values[literal, column], sizes[literal, column] = code.bits[p[literal, plane]], code.n[p[literal, plane]]
    for at, prefix in far:
        values[at, 2], sizes[at, 2] = codes[4].bits[prefix], codes[4].n[prefix]
    w.many(values[starts].reshape(-1), sizes[starts].reshape(-1))


def riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def header(w: Writer, width: int, height: int) -> None:
    w.bits(0x2F, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(1, 1)
    w.bits(0, 3)


def neighbours(p: np.ndarray, width: int) -> list[np.ndarray]:
    """Left, top, top right and top left of every pixel in reading order; zeros before the first."""
    return [np.concatenate([np.zeros((d, 4), np.uint8), p[: max(len(p) - d, 0)]])[: len(p)] for d in (1, width, width - 1, width + 1)]


def residual(p: np.ndarray, width: int, mode: int, around: list[np.ndarray]) -> np.ndarray:
    """What ``mode`` leaves of every pixel; the edges have predictors of their own."""
    guess = np.array(predict(mode, *around))
    guess[1:width] = p[: width - 1]
    guess[::width][1:] = p[::width][:-1]
    guess[0] = BLACK
    return p - guess


def tiles_of(n: int, width: int, bits: int) -> np.ndarray:
    at = np.arange(n)
    return ((at // width) >> bits) * blocks(width, bits) + ((at % width) >> bits)


def apply_prediction(p: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    around, tiles = neighbours(p, width), tiles_of(len(p), width, bits)
    out, own = np.empty_like(p), np.asarray(modes)[tiles]
    for mode in np.unique(modes).tolist():
        chosen = own == mode
        out[chosen] = residual(p, width, mode, around)[chosen]
    return out


#: Bits that a residual is taken to cost when modes and factors are chosen.
COST = np.log2(1 + np.minimum(np.arange(256), 256 - np.arange(256))).astype(np.float32)
#: Predictors that rows or sums invert, and the factors (in 32nds) that are tried.
MODES, FACTORS = (0, 1, 2, 4, 8), (0, 16, 32)
TILE_BITS, CACHE_BITS = 6, 6


def least_modes(p: np.ndarray, width: int, bits: int) -> np.ndarray:
    """For each tile the predictor of least cost."""
    around, tiles = neighbours(p, width), tiles_of(len(p), width, bits)
    costs = [np.bincount(tiles, COST[residual(p, width, mode, around)].sum(axis=1)) for mode in MODES]
    return np.array(MODES)[np.argmin(costs, axis=0)]


def least_factors(p: np.ndarray, width: int, bits: int) -> np.ndarray:
    """For each tile the factors of least cost, one after another: green to red, green to blue, red to blue."""
    tiles, green, red = tiles_of(len(p), width, bits), signed(p[:, 2]), signed(p[:, 1])

    def best(plane: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tried = [plane - ((f * by) >> 5).astype(np.uint8) for f in FACTORS]
        which = np.argmin([np.bincount(tiles, COST[t]) for t in tried], axis=0)
        return np.array(FACTORS)[which], np.choose(which[tiles], tried)

    to_red, _ = best(p[:, 1], green)
    to_blue, blue = best(p[:, 3], green)
    return np.column_stack([to_red, to_blue, best(blue, red)[0]])


def encode(image: np.ndarray, *, transforms: Sequence[int] = (), cache_bits: int = 0, references: bool = False, modes: np.ndarray | None = None, factors: np.ndarray | None = None, bits: int = 2) -> bytes:
    """A lossless WebP file with the transforms named, in order; modes and factors by block of 2**bits pixels."""
    height, width = image.shape[:2]
    w = Writer()
    header(w, width, height)
    p = np.ascontiguousarray(image.reshape(-1, 4)[:, [3, 0, 1, 2]])
    across = width
    for kind in transforms:
        w.bits(1, 1)
        w.bits(kind, 2)
        n = blocks(across, bits) * blocks(height, bits)
        if kind == PREDICTOR:
            own = np.resize(np.arange(14), n) if modes is None else least_modes(p, across, bits) if isinstance(modes, str) else np.resize(modes, n)
            w.bits(bits - 2, 3)
            write_image(w, (own.astype(np.uint32) << 8) | np.uint32(0xFF000000), blocks(across, bits), False)
            p = apply_prediction(p, across, own, bits)
        elif kind == CROSS_COLOUR:
            own = np.resize(np.array([[7, 250, 33]]), (n, 3)) if factors is None else least_factors(p, across, bits) if isinstance(factors, str) else np.resize(factors, (n, 3))
            w.bits(bits - 2, 3)
            write_image(w, join(np.column_stack([np.full(n, 255), own[:, [2, 1, 0]]]) & 255), blocks(across, bits), False)
            p = cross_colour(p, across, own, bits, False)
        elif kind == SUBTRACT_GREEN:
            p = p.copy()
            p[:, 1] -= p[:, 2]
            p[:, 3] -= p[:, 2]
        else:
            table, index = np.unique(join(p), return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette holds 256 colours")
            w.bits(len(table) - 1, 8)
            write_image(w, join(np.diff(planes(table), axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), False)
            pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            index = np.pad(index.reshape(height, across), ((0, 0), (0, blocks(across, pack) * (1 << pack) - across)))
            index = (index.reshape(height, -1, 1 << pack) << ((8 >> pack) * np.arange(1 << pack))).sum(axis=2).reshape(-1)
            across = blocks(across, pack)
            p = np.zeros((len(index), 4), np.uint8)
            p[:, 0], p[:, 2] = 255, index
    w.bits(0, 1)
    argb = join(p)
    if cache_bits < 0:  # a cache that pays: one pixel in sixteen is found in it
        cache_bits = -cache_bits if cache_slots(argb, -cache_bits)[1].sum() * 16 >= len(argb) else 0
    write_image(w, argb, across, True, cache_bits, references)
    return riff(w.bytes())


def encode_by_content(image: np.ndarray) -> bytes:
    """A palette for images of few colours, else predictor and cross-colour by tile; back-references always, a colour cache where it pays."""
    colours = len(np.unique(np.ascontiguousarray(image).view(np.uint32)))
    if colours <= 256 and 2 * colours <= image.shape[0] * image.shape[1]:
        return encode(image, transforms=(PALETTE,), cache_bits=-CACHE_BITS, references=True)
    return encode(image, transforms=(PREDICTOR, CROSS_COLOUR), modes="least", factors="least", bits=TILE_BITS, cache_bits=-CACHE_BITS, references=True)

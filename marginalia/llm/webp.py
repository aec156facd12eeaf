"""A lossless WebP codec for many small images at once (the VP8L bitstream in a RIFF container).

All images of a call are coded side by side: prefix codes are written and read for all of them at once, and each step of
decoding reads the next pixel of every image that is not yet complete, so that numpy's cost of a call is shared. The decoder knows prefix codes (simple and coded), groups of codes chosen by an
entropy image, back-references with the short-distance table, the colour cache, and the inverse transforms:
predictor, cross-colour, subtract-green and palette with packed indices. The encoder writes literals with one group of
prefix codes for each image, fitted to its bytes. Images of few colours for their size are written with back-references, once
with a colour cache and, if there are at most MOST_COLOURS, once with a palette, and the shorter file is kept. Predictor and cross-colour, which
model gradients, are read but not written: they lengthen files of text.

Pixels are arrays of uint32, alpha << 24 | red << 16 | green << 8 | blue.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (dx, dy) of the 120 short distances: the neighbours above and to the left, nearest first.
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
LENGTHS, DISTANCES, LITERALS = 24, 40, 256
LONGEST = 15

#: An image has few colours for its size if it has so many times more pixels, and enough of these.
FEW, LEAST_PIXELS = 5, 128
MOST_COLOURS, CACHE_BITS = 64, 6
LONGEST_COPY = 4_096


class Bits:
    """Reads a bitstream, least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the bitstream ends early")
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 8], "little")
        out = word >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out


class Writer:
    def __init__(self) -> None:
        self.word, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.word |= value << self.n
        self.n += n


# --- prefix codes -----------------------------------------------------------


_REVERSED: dict[int, np.ndarray] = {}


def reversed_bits(n: int) -> np.ndarray:
    if n not in _REVERSED:
        k = np.arange(1 << n)
        _REVERSED[n] = sum(((k >> i & 1) << (n - 1 - i) for i in range(n)), np.zeros(1 << n, np.int64))
    return _REVERSED[n]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """[rows, symbols] lengths -> codes, bit-reversed as they stand in the stream."""
    most = int(lengths.max(initial=1))
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    own = np.take_along_axis(lengths, order, 1)
    share = np.where(own > 0, 1 << (most - own), 0)
    start = np.cumsum(share, 1) - share
    codes = np.zeros_like(lengths)
    np.put_along_axis(codes, order, np.where(own > 0, reversed_bits(most)[np.minimum(start, (1 << most) - 1)], 0), 1)
    return codes


def lookup(lengths: np.ndarray) -> np.ndarray:
    """For the next bits, as many as the longest code has, symbol << 4 | length. A single symbol takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.array([int(used[0]) << 4], np.uint16)
    used = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[used]
    most = int(own.max(initial=0))
    share = 1 << (most - own)
    if not len(used) or most > LONGEST or share.sum() != 1 << most:
        raise ValueError("a prefix code is not complete")
    return np.repeat(used << 4 | own, share).astype(np.uint16)[reversed_bits(most)]


def lookups(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lookup of each row of [rows, symbols] lengths: all tables end to end, where each begins, and how many bits it takes."""
    row, symbol = np.nonzero(lengths)
    used = np.bincount(row, minlength=len(lengths))
    if not used.all():
        raise ValueError("a prefix code is not complete")
    key = np.sort(row << 20 | lengths[row, symbol] << 12 | symbol)
    row, symbol = key >> 20, key & 4095
    own = np.where(used[row] == 1, 0, key >> 12 & 255)
    most = own[np.cumsum(used) - 1]
    share = 1 << (most[row] - own)
    if most.max(initial=0) > LONGEST or (np.bincount(row, share, len(lengths)) != 1 << most).any():
        raise ValueError("a prefix code is not complete")
    values = np.repeat((symbol << 4 | own).astype(np.uint16), share)
    start = np.cumsum(1 << most) - (1 << most)
    out = np.empty_like(values)
    for m in np.unique(most).tolist():
        which = start[most == m][:, None]
        out[which + np.arange(1 << m)] = values[which + reversed_bits(m)]
    return out, start, most


def read_code(bits: Bits, size: int) -> np.ndarray:
    """Lengths of a prefix code's symbols."""
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        for s in symbols:
            lengths[s] = 1
        return lengths
    own = np.zeros(19, np.int64)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    table = lookup(own)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and most:
        most -= 1
        word = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 4], "little") >> (bits.at & 7)
        got = int(table[word & len(table) - 1])
        bits.at += got & 15
        s = got >> 4
        if s < 16:
            lengths[at] = s
            at, before = at + 1, s or before
        else:
            n = bits.read((2, 3, 7)[s - 16]) + (3, 3, 11)[s - 16]
            if at + n > size:
                raise ValueError("a prefix code has too many lengths")
            lengths[at : at + n] = before if s == 16 else 0
            at += n
    return lengths


# The lengths' own code: sixteen symbols of 4 bits each, 0 to 13 and the runs of zeros.
OWN = np.full(19, 4, np.int64)
OWN[[14, 15, 16]] = 0
#: What stands before a code that isn't simple: 0, the number of own lengths less 4, and these.
OWN_CODE, OWN_BITS = 15 << 1 | sum(int(OWN[k]) << 5 + 3 * i for i, k in enumerate(CODE_LENGTH_ORDER)), 62


@cache
def _own_codes() -> np.ndarray:
    return canonical(OWN[None])[0]


@cache
def _zeros() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits, their number and the number of symbols that stand for a run of zeros, of each length."""
    codes, rows = _own_codes().tolist(), []
    for left in range(LITERALS + LENGTHS + (1 << CACHE_BITS)):
        value = n = tokens = 0
        while left:
            run = min(left, 138) if left > 2 else 1
            s, extra, more = (0, 0, 0) if run < 3 else (17, run - 3, 3) if run < 11 else (18, run - 11, 7)
            value |= (codes[s] | extra << 4) << n
            n, tokens, left = n + 4 + more, tokens + 1, left - run
        rows.append((value, n, tokens))
    return tuple(np.array(rows, np.int64).T)


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (used < 256).all():
        used = used if len(used) else np.zeros(1, np.int64)
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(int(s), 8)
        return
    out.put(OWN_CODE, OWN_BITS)
    codes, (zeros, zeros_n, zeros_tokens) = _own_codes(), _zeros()
    gaps = np.diff(used, prepend=-1) - 1
    tokens = len(used) + int(zeros_tokens[gaps].sum())
    out.put(1 | 4 << 1 | max(0, tokens - 2) << 4, 14)
    for gap, n in zip(gaps.tolist(), lengths[used].tolist()):
        out.put(int(zeros[gap]), int(zeros_n[gap]))
        out.put(int(codes[n]), 4)
    if tokens == 1:
        out.put(int(codes[0]), 4)


def code_pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What write_code writes of each row of [rows, at most 256] lengths, none of them empty, all rows at once.

    Pieces of at most 32 bits: the place of each in its row's bits, its value, its row; and each row's number of bits.
    """
    row, symbol = np.nonzero(lengths)
    used = np.bincount(row, minlength=len(lengths))
    simple = used <= 2
    first = np.cumsum(used) - used  # each row's first symbol
    gap = np.diff(symbol, prepend=0) - 1
    gap[first] = symbol[first]
    zeros, zeros_n, zeros_tokens = _zeros()
    short = simple[row]
    value = np.where(short, symbol, zeros[gap] | _own_codes()[lengths[row, symbol]] << zeros_n[gap])
    n = np.where(short, 8, zeros_n[gap] + 4)
    tokens = used + np.add.reduceat(zeros_tokens[gap], first)
    heads = np.stack(
        [
            np.where(simple, 1 | (used - 1) << 1 | 1 << 2, OWN_CODE & 0xFFFFFFFF),
            np.where(simple, 0, OWN_CODE >> 32),
            np.where(simple, 0, 1 | 4 << 1 | (tokens - 2) << 4),
        ],
        1,
    )
    heads_at = np.where(simple[:, None], 0, [0, 32, OWN_BITS])
    head = np.where(simple, 3, OWN_BITS + 14)
    before = np.cumsum(n) - n
    at = head[row] + before - before[first][row]
    return np.r_[heads_at.ravel(), at], np.r_[heads.ravel(), value], np.r_[np.repeat(np.arange(len(lengths)), 3), row], head + np.add.reduceat(n, first)


def fitted(counts: np.ndarray, longest: int = 10) -> np.ndarray:
    """[rows, symbols] counts -> lengths of complete prefix codes, near to the shortest; all rows at once.

    Lengths are rounded up from the logarithms of shares, so there is room left; it goes to frequent symbols first, and what
    is still left is given bit by bit from the longest code on.
    """
    counts = counts.astype(np.float64)
    total = counts.sum(1, keepdims=True)
    used = counts > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = np.log2(total) - np.log2(counts)
    lengths = np.where(used, np.clip(np.ceil(exact - 1e-9), 1, longest), 0).astype(np.int64)
    order = np.argsort(-counts, axis=1, kind="stable")
    sorted_lengths = np.take_along_axis(lengths, order, 1)
    live = sorted_lengths > 0
    full = 1 << longest
    share = np.where(live, 1 << (longest - sorted_lengths), 0)
    room = full - share.sum(1)
    columns = np.flatnonzero(live.any(0))
    while (room < 0).any():  # codes cut to `longest` took too much: lengthen the rarest that can be
        for j in columns[::-1]:
            can = (room < 0) & live[:, j] & (sorted_lengths[:, j] < longest)
            room = room + np.where(can, share[:, j] >> 1, 0)
            share[:, j] = np.where(can, share[:, j] >> 1, share[:, j])
            sorted_lengths[:, j] += can
    while True:
        gave = np.zeros(len(room), bool)
        for j in columns:
            can = live[:, j] & (sorted_lengths[:, j] > 1) & (share[:, j] <= room)
            room = room - np.where(can, share[:, j], 0)
            share[:, j] = np.where(can, share[:, j] << 1, share[:, j])
            sorted_lengths[:, j] -= can
            gave |= can
        if not gave.any():
            break
    np.put_along_axis(lengths, order, sorted_lengths, 1)
    return lengths


# --- decoding ---------------------------------------------------------------


@dataclass
class Plane:
    """An entropy-coded image that is being read: its codes, where its pixels begin in the stream, then the pixels."""

    bits: Bits
    width: int
    height: int
    cache: int = 0
    groups: np.ndarray | None = None  # [groups, 5] numbers of tables
    tables: list[np.ndarray] = field(default_factory=list)
    chosen: np.ndarray | None = None  # group of each pixel
    pixels: np.ndarray | None = None


def _sizes(p: Plane) -> tuple[int, ...]:
    """Symbols of a group's five codes."""
    return LITERALS + LENGTHS + (1 << p.cache if p.cache else 0), 256, 256, 256, DISTANCES


def _header(p: Plane, main: bool) -> None:
    """Reads what stands before a plane's pixels; a main plane's entropy image is decoded on its own, and its codes are left to _codes if they are one group."""
    bits = p.bits
    if bits.read(1):
        p.cache = bits.read(4)
        if not 1 <= p.cache <= 11:
            raise ValueError("bad colour cache")
    groups = 1
    if main and bits.read(1):
        size = 2 + bits.read(3)
        small = Plane(bits, -(-p.width >> size), -(-p.height >> size))
        small.width, small.height = -(-p.width // (1 << size)), -(-p.height // (1 << size))
        _header(small, False)
        _pixels([small])
        which = (small.pixels >> np.uint32(8)).astype(np.int64) & 0xFFFF
        y, x = np.divmod(np.arange(p.width * p.height), p.width)
        p.chosen = which[(y >> size) * small.width + (x >> size)]
        groups = int(which.max()) + 1
    if not main or p.chosen is not None:
        p.tables = [lookup(read_code(bits, n)) for _ in range(groups) for n in _sizes(p)]


def _wide(data: bytes) -> np.ndarray:
    """The 8 bytes from each byte on, as a number."""
    return np.ndarray(len(data) - 7, "<i8", data, 0, (1,)).copy()


def _codes(planes: list[Plane]) -> None:
    """The codes of planes of one group, as read_code and lookup give them, read side by side: each step reads the next symbol of all."""
    if not planes:
        return
    sizes = np.array([_sizes(p) for p in planes])
    longest = int((82 + 14 * sizes).sum(1).max()) // 8 + 16  # bytes of the longest codes
    skipped = np.array([p.bits.at >> 3 for p in planes])
    chunks = [p.bits.data[k : k + longest] for p, k in zip(planes, skipped.tolist())]
    ends = np.cumsum([len(c) for c in chunks]) * 8
    base = np.r_[0, ends[:-1]]
    wide = _wide(b"".join(chunks) + bytes(longest + 16))
    at = base + np.array([p.bits.at & 7 for p in planes])

    def take(who: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        own = at[who]
        at[who] = own + n
        return wide[own >> 3] >> (own & 7) & (1 << n) - 1

    everyone, found = np.arange(len(planes)), []
    for size in sizes.T:
        lengths = np.zeros((len(planes), int(size.max())), np.int64)

        def single(who: np.ndarray, symbol: np.ndarray, size: np.ndarray = size, lengths: np.ndarray = lengths) -> None:
            if (symbol >= size[who]).any():
                raise ValueError("a prefix code has a symbol too many")
            lengths[who, symbol] = 1

        simple = take(everyone, 1) == 1
        who = everyone[simple]
        two = take(who, 1) == 1
        single(who, take(who, np.where(take(who, 1) == 1, 8, 1)))
        single(who[two], take(who[two], 8))
        who = everyone[~simple]
        if len(who):
            count, own = 4 + take(who, 4), np.zeros((len(who), 19), np.int64)
            for i, k in enumerate(CODE_LENGTH_ORDER):
                has = count > i
                own[has, k] = take(who[has], 3)
            table, start, bits = lookups(own)
            mask, limit = (1 << bits) - 1, size[who]
            few = take(who, 1) == 1
            most = limit.copy()
            most[few] = 2 + take(who[few], 2 + 2 * take(who[few], 3))
            place, before = np.zeros(len(who), np.int64), np.full(len(who), 8)
            live = np.arange(len(who))
            while len(live):
                w, spot = who[live], place[live]
                now = at[w]
                got = table[start[live] + (wide[now >> 3] >> (now & 7) & mask[live])].astype(np.int64)
                at[w] = now + (got & 15)
                s, n = got >> 4, 1
                plain = (s > 0) & (s < 16)
                lengths[w[plain], spot[plain]] = s[plain]
                before[live[plain]] = s[plain]
                if (runs := np.flatnonzero(s >= 16)).size:
                    n, kind = np.ones(len(live), np.int64), s[runs] - 16
                    n[runs] = np.array([3, 3, 11])[kind] + take(w[runs], np.array([2, 3, 7])[kind])
                    if (spot + n > limit[live]).any():
                        raise ValueError("a prefix code has too many lengths")
                    again = runs[kind == 0]
                    for k in range(6):
                        i = again[n[again] > k]
                        lengths[w[i], spot[i] + k] = before[live[i]]
                place[live] = spot = spot + n
                most[live] -= 1
                live = live[(spot < limit[live]) & (most[live] > 0)]
        table, start, bits = lookups(lengths)
        found.append((table, start.tolist(), (start + (1 << bits)).tolist()))
    if (at > ends).any():
        raise ValueError("the bitstream ends early")
    for i, (p, bit) in enumerate(zip(planes, (at - base + 8 * skipped).tolist())):
        p.bits.at = bit
        p.tables = [table[start[i] : end[i]] for table, start, end in found]


def _pixels(planes: list[Plane]) -> None:
    """Decodes all planes side by side, one pixel of each at a step; each stream's place moves behind its plane.

    A step in which every plane reads a literal takes a short way; back-references, caches and several groups of codes the
    general one.
    """
    if not planes:
        return
    planes = sorted(planes, key=lambda p: -p.width * p.height)  # those still read are the first ones
    n = len(planes)
    sizes = np.array([p.width * p.height for p in planes])
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    out = np.zeros(int(sizes.sum()), np.uint32)
    skipped = np.array([p.bits.at >> 3 for p in planes])
    chunks = [p.bits.data[k:] + bytes(16) for p, k in zip(planes, skipped.tolist())]
    base = np.r_[0, np.cumsum([len(c) for c in chunks])[:-1]] * 8
    wide = _wide(b"".join(chunks))
    tables = [t for p in planes for t in p.tables]
    start = np.r_[0, np.cumsum([len(p.tables) for p in planes])[:-1]]  # number of each plane's first table
    flat = np.concatenate(tables)
    origin = np.r_[0, np.cumsum([len(t) for t in tables])[:-1]]
    mask = np.array([len(t) - 1 for t in tables])
    own_origin, own_mask = [origin[start + k] for k in range(4)], [mask[start + k] for k in range(4)]
    plain_alpha = all(len(p.tables) == 5 and len(p.tables[3]) == 1 for p in planes)
    at = base + np.array([p.bits.at & 7 for p in planes])
    many = any(p.chosen is not None for p in planes)
    chosen = np.concatenate([p.chosen if p.chosen is not None else np.zeros(s, np.int64) for p, s in zip(planes, sizes)]) if many else None
    cache_bits = np.array([p.cache for p in planes])
    caches = np.zeros((n, 1 << int(cache_bits.max(initial=0))), np.uint32) if cache_bits.any() else None
    widths = np.array([p.width for p in planes])
    short = np.array(SHORT_DISTANCES)
    left, back = np.zeros(n, np.int64), np.ones(n, np.int64)
    copying = False

    def peek(where: np.ndarray) -> np.ndarray:
        """The next 57 bits; what stands above them means nothing."""
        return wide[where >> 3] >> (where & 7)

    def symbol(which: np.ndarray, table: np.ndarray) -> np.ndarray:
        got = flat[origin[table] + (peek(at[which]) & mask[table])]
        at[which] += got & 15
        return (got >> 4).astype(np.int64)

    def extra(which: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The value of a length or distance code."""
        n = np.maximum(code - 2, 0) >> 1
        value = np.where(code < 4, code, ((2 + (code & 1)) << n) + (peek(at[which]) & (1 << n) - 1)) + 1
        at[which] += n
        return value

    def literals(m: int, step: int) -> bool:
        """The short way; False, with nothing done, if some plane's next symbol is no literal."""
        now = at[:m]
        w = peek(now)
        g = flat[own_origin[0][:m] + (w & own_mask[0][:m])]
        if g.max() >= LITERALS << 4:
            return False
        used = g & 15
        w >>= used
        r = flat[own_origin[1][:m] + (w & own_mask[1][:m])]
        n = r & 15
        w >>= n
        used += n
        b = flat[own_origin[2][:m] + (w & own_mask[2][:m])]
        used += b & 15
        now += used
        if plain_alpha:
            a = alphas[:m]
        else:
            a = flat[own_origin[3][:m] + (peek(now) & own_mask[3][:m])]
            now += a & 15
            a = (a >> 4).astype(np.uint32) << np.uint32(24)
        a = a | b >> 4
        a |= g >> 4 << 8
        a |= (r >> 4).astype(np.uint32) << np.uint32(16)
        out[first[:m] + step] = a
        return True

    alphas = (flat[own_origin[3]] >> 4).astype(np.uint32) << np.uint32(24)
    active = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")
    for step, m in enumerate(active.tolist()):
        if not copying and not many and caches is None and literals(m, step):
            continue
        live = np.arange(m)
        where = first[:m] + step
        read = live
        if copying:
            busy = left[:m] > 0
            if busy.any():
                out[where[busy]] = out[where[busy] - back[live[busy]]]
                left[live[busy]] -= 1
                read, where = live[~busy], where[~busy]
            copying = bool((left[:m] > 0).any())
        if len(read):
            table = start[read] + (5 * chosen[where] if many else 0)
            green = symbol(read, table)
            lit = green < LITERALS
            who, spot, t = read[lit], where[lit], table[lit]
            red, blue, alpha = symbol(who, t + 1), symbol(who, t + 2), symbol(who, t + 3)
            out[spot] = _merge(alpha, red, green[lit], blue)
            if not lit.all():
                ref = (green >= LITERALS) & (green < LITERALS + LENGTHS)
                if ref.any():
                    who, spot, t = read[ref], where[ref], table[ref]
                    length = extra(who, green[ref] - LITERALS)
                    code = extra(who, symbol(who, t + 4))
                    near = code <= len(short)
                    d = short[np.where(near, code - 1, 0)]
                    distance = np.where(near, np.maximum(1, d[:, 0] + d[:, 1] * widths[who]), code - len(short))
                    if (distance > step).any() or (length > sizes[who] - step).any():
                        raise ValueError("a back-reference leaves the image")
                    out[spot] = out[spot - distance]
                    left[who], back[who] = length - 1, distance
                    copying = True
                hit = green >= LITERALS + LENGTHS
                if hit.any():
                    out[where[hit]] = caches[read[hit], green[hit] - LITERALS - LENGTHS]
        if caches is not None:
            cached = live[cache_bits[:m] > 0]
            value = out[first[cached] + step]
            with np.errstate(over="ignore"):
                caches[cached, (value * np.uint32(HASH) >> (32 - cache_bits[cached]).astype(np.uint32)).astype(np.int64)] = value
    for i, p in enumerate(planes):
        p.bits.at = int(at[i]) - int(base[i]) + 8 * int(skipped[i])
        if p.bits.at > 8 * len(p.bits.data):
            raise ValueError("the bitstream ends early")
        p.pixels = out[first[i] : first[i] + sizes[i]]


def _split(x: np.ndarray) -> list[np.ndarray]:
    return [(x >> np.uint32(s)).astype(np.int64) & 255 for s in (24, 16, 8, 0)]


def _merge(a, r, g, b) -> np.ndarray:
    return ((a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255).astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _predicted(mode: int, left, top, corner, right) -> np.ndarray:
    """[4] channels of a pixel from its neighbours, by one of the format's fourteen rules."""
    half = lambda x, y: (x + y) >> 1
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7, 8, 9):
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = np.abs(top - corner).sum()
        to_top = np.abs(left - corner).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = half(left, top)
    return np.clip(mean + np.fix((mean - corner) / 2).astype(np.int64), 0, 255)


def _unpredict(pixels: np.ndarray, width: int, size: int, modes: np.ndarray) -> np.ndarray:
    height, across = len(pixels) // width, -(-width // (1 << size))
    out = np.stack(_split(pixels), 1).reshape(height, width, 4)
    rules = (modes >> np.uint32(8)).astype(np.int64) & 15
    flat = out.reshape(-1, 4)
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if y == 0:
                p = flat[i - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                p = flat[i - width]
            else:
                p = _predicted(int(rules[(y >> size) * across + (x >> size)]), flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
            flat[i] = (flat[i] + p) & 255
    return _merge(*flat.T)


def _uncross(pixels: np.ndarray, width: int, size: int, factors: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(len(pixels)), width)
    own = factors[(y >> size) * -(-width // (1 << size)) + (x >> size)]
    _, red_blue, green_blue, green_red = (_signed(c) for c in _split(own))
    a, r, g, b = _split(pixels)
    r = r + (green_red * _signed(g) >> 5) & 255
    b = b + (green_blue * _signed(g) >> 5) + (red_blue * _signed(r) >> 5)
    return _merge(a, r, g, b)


def _ungreen(pixels: np.ndarray) -> np.ndarray:
    a, r, g, b = _split(pixels)
    return _merge(a, r + g, g, b + g)


def _unpalette(pixels: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    bits = pack_bits(len(colours))
    green = (pixels >> np.uint32(8)).astype(np.int64) & 255
    per = 8 >> bits
    rows = green.reshape(height, -1)
    index = (rows[:, :, None] >> (np.arange(1 << bits) * per) & ((1 << per) - 1)).reshape(height, -1)[:, :width] if bits else rows
    table = np.r_[colours, np.zeros(256, np.uint32)]
    return table[index.ravel()]


def pack_bits(colours: int) -> int:
    """How many indices, as a power of two, a pixel packs."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(files: list[bytes]) -> list[np.ndarray]:
    """[height, width] pixels of each file."""
    mains, todo = [], []
    for f in files:
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or f[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
        size = struct.unpack_from("<I", f, 16)[0]
        bits = Bits(f[20 : 20 + size], 8)
        width, height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        steps, now = [], width
        while bits.read(1):
            kind = bits.read(2)
            if kind in (PREDICTOR, CROSS):
                block = bits.read(3) + 2
                sub = Plane(bits, -(-now // (1 << block)), -(-height // (1 << block)))
                _header(sub, False)
                _pixels([sub])
                steps.append((kind, now, block, sub.pixels))
            elif kind == PALETTE:
                sub = Plane(bits, bits.read(8) + 1, 1)
                _header(sub, False)
                _pixels([sub])
                colours = _merge(*(np.cumsum(c) for c in _split(sub.pixels)))
                steps.append((kind, now, 0, colours))
                now = -(-now // (1 << pack_bits(len(colours))))
            else:
                steps.append((kind, now, 0, None))
        p = Plane(bits, now, height)
        _header(p, True)
        mains.append(p)
        todo.append((width, height, steps))
    _codes([p for p in mains if p.chosen is None])
    rich = [p.cache > 0 or p.chosen is not None or int(p.tables[0].max()) >> 4 >= LITERALS for p in mains]
    _pixels([p for p, is_rich in zip(mains, rich) if not is_rich])
    _pixels([p for p, is_rich in zip(mains, rich) if is_rich])
    out = []
    for p, (width, height, steps) in zip(mains, todo):
        x = p.pixels
        for kind, now, block, with_ in reversed(steps):
            if kind == PREDICTOR:
                x = _unpredict(x, now, block, with_)
            elif kind == CROSS:
                x = _uncross(x, now, block, with_)
            elif kind == PALETTE:
                x = _unpalette(x, now, height, with_)
            else:
                x = _ungreen(x)
        out.append(x.reshape(height, width))
    return out


# --- encoding ---------------------------------------------------------------


def riff(stream: bytes) -> bytes:
    pad = len(stream) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + pad) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(pad)


def _opened(width: int, height: int) -> Writer:
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1)  # no alpha
    out.put(0, 3)
    return out


def _single(symbol: int, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.int64)
    lengths[symbol] = 1
    return lengths


def _flat_image(width: int, height: int, colour: np.ndarray) -> bytes:
    """An image of one colour: a palette of one entry; all its indices take no bits."""
    out = _opened(width, height)
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(0, 8)
    red, green, blue = (int(c) for c in colour)
    out.put(0, 1)
    for s in (green, red, blue, 255, 0):
        write_code(out, _single(s, 280))
    out.put(0, 1)  # no further transform
    out.put(0, 2)  # no colour cache, one group
    for s in (0, 0, 0, 255, 0):
        write_code(out, _single(s, 280))
    return riff(out.word.to_bytes(-(-out.n // 8), "little"))


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    x = value - 1
    top = x.bit_length() - 1
    return 2 * top + (x >> (top - 1) & 1), x & ((1 << (top - 1)) - 1), top - 1


def _references(values: list[int], width: int, cache_bits: int) -> list[tuple[int, int, int]]:
    """Tokens of pixels: (0, pixel, 0), (1, length, distance code) of a copy, (2, place in the cache, 0)."""
    near = {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(SHORT_DISTANCES)))}
    out, last, cache, i = [], {}, [0] * (1 << cache_bits), 0
    while i < len(values):
        key, n = tuple(values[i : i + 3]), 1
        j = last.get(key, -1) if len(key) == 3 else -1
        if j >= 0:
            n = 3
            while i + n < len(values) and n < LONGEST_COPY and values[j + n] == values[i + n]:
                n += 1
            out.append((1, n, near.get(i - j, i - j + len(SHORT_DISTANCES))))
        else:
            place = (values[i] * HASH & 0xFFFFFFFF) >> (32 - cache_bits)
            out.append((2, place, 0) if cache_bits and cache[place] == values[i] else (0, values[i], 0))
        last[key] = i
        if cache_bits:
            for v in values[i : i + n]:
                cache[(v * HASH & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        i += n
    return out


def _even(symbols: list[int], size: int) -> np.ndarray:
    """Lengths of a complete code of nearly equal lengths."""
    own, out = sorted(set(symbols)), np.zeros(size, np.int64)
    longest = max(1, (len(own) - 1).bit_length())
    for k, s in enumerate(own):
        out[s] = longest - (len(own) > 1 and k < (1 << longest) - len(own))
    return out


def _with_palette(x: np.ndarray, colours: np.ndarray) -> tuple[Writer, list[tuple[int, int, int]]]:
    """The stream up to the index image's codes, and its tokens."""
    out = _opened(x.shape[1], x.shape[0])
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(len(colours) - 1, 8)
    steps = [(np.diff(c, prepend=0) & 255).tolist() for c in _split(colours)]
    out.put(0, 1)
    codes = [_even(steps[c], 280 if c == 2 else 256) for c in (2, 1, 3, 0)]  # green, red, blue, alpha
    for lengths in (*codes, _single(0, DISTANCES)):
        write_code(out, lengths)
    written = [(canonical(c[None])[0], c, (c > 0).sum() > 1) for c in codes]
    for pixel in zip(*(steps[c] for c in (2, 1, 3, 0))):
        for s, (code, lengths, many) in zip(pixel, written):
            if many:
                out.put(int(code[s]), int(lengths[s]))
    out.put(0, 1)  # no further transform
    out.put(0, 2)  # no colour cache, one group
    bits = pack_bits(len(colours))
    index = np.searchsorted(colours, _merge(255, *(x.reshape(-1, 3)[:, c].astype(np.int64) for c in range(3)))).reshape(x.shape[:2])
    index = np.pad(index, ((0, 0), (0, -x.shape[1] % (1 << bits))))
    packed = (index.reshape(len(x), -1, 1 << bits) << (np.arange(1 << bits) * (8 >> bits))).sum(2)
    return out, _references((packed.ravel() << 8).tolist(), packed.shape[1], 0)


def _of_few_colours(images: list[np.ndarray]) -> list[bytes]:
    """Files with back-references: with a colour cache, or with a palette where that is shorter."""
    if not images:
        return []
    heads, tokens, owner, sizes = [], [], [], []
    for i, x in enumerate(images):
        pixels = _merge(255, *(x.reshape(-1, 3)[:, c].astype(np.int64) for c in range(3)))
        out = _opened(x.shape[1], x.shape[0])
        out.put(0, 1)  # no transform
        out.put(1, 1)
        out.put(CACHE_BITS, 4)
        out.put(0, 1)  # one group
        heads.append(out), tokens.append(_references(pixels.tolist(), x.shape[1], CACHE_BITS)), owner.append(i), sizes.append(LITERALS + LENGTHS + (1 << CACHE_BITS))
        colours = np.unique(pixels)
        if len(colours) <= MOST_COLOURS:
            out, own = _with_palette(x, colours)
            heads.append(out), tokens.append(own), owner.append(i), sizes.append(LITERALS + LENGTHS)
    counts = [np.zeros((len(heads), n), np.int64) for n in (max(sizes), 256, 256, DISTANCES)]
    for k, own in enumerate(tokens):
        for kind, a, b in own:
            if kind == 0:
                counts[0][k, a >> 8 & 255] += 1
                counts[1][k, a >> 16 & 255] += 1
                counts[2][k, a & 255] += 1
            elif kind == 1:
                counts[0][k, LITERALS + _prefix(a)[0]] += 1
                counts[3][k, _prefix(b)[0]] += 1
            else:
                counts[0][k, LITERALS + LENGTHS + a] += 1
    for c in counts:
        c[c.sum(1) == 0, 0] = 1
    lengths = [fitted(c) for c in counts]
    codes = [canonical(c) for c in lengths]
    best: list[bytes | None] = [None] * len(images)
    for k, (out, own, i) in enumerate(zip(heads, tokens, owner)):
        mine = [c[k] for c in lengths]
        mine[0] = mine[0][: sizes[k]]
        for c in (*mine[:3], _single(255, 256), mine[3]):
            write_code(out, c)
        table = [(code[k].tolist(), (n if (n > 0).sum() > 1 else n * 0).tolist()) for code, n in zip(codes, mine)]

        def put(which: int, s: int, out: Writer = out, table: list = table) -> None:
            if n := table[which][1][s]:
                out.put(table[which][0][s], n)

        for kind, a, b in own:
            if kind == 0:
                put(0, a >> 8 & 255), put(1, a >> 16 & 255), put(2, a & 255)
            elif kind == 1:
                for which, first, value in ((0, LITERALS, a), (3, 0, b)):
                    s, more, n = _prefix(value)
                    put(which, first + s)
                    out.put(more, n)
            else:
                put(0, LITERALS + LENGTHS + a)
        file = riff(out.word.to_bytes(-(-out.n // 8), "little"))
        if best[i] is None or len(file) < len(best[i]):
            best[i] = file
    return best


def _few_colours(x: np.ndarray) -> bool:
    flat = x.reshape(-1, 3).astype(np.uint32)
    return len(flat) >= LEAST_PIXELS and len(np.unique(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2])) * FEW <= len(flat)


#: Simple codes of one symbol: alpha 255, distance 0.
LAST_CODES = (1 | 1 << 2 | 255 << 3) | (1 | 1 << 2) << 11


def _placed(at: np.ndarray, value: np.ndarray, words: int) -> np.ndarray:
    """Words of 32 bits, as doubles that hold them exactly, with each value (32 bits at most) at its bit; no two share a bit."""
    shifted = value.astype(np.uint64) << (at & 31).astype(np.uint64)
    word = at >> 5
    out = np.bincount(word, shifted & np.uint64(0xFFFFFFFF), words)
    out[1:] += np.bincount(word, shifted >> np.uint64(32), words)[:-1]
    return out


def encode_rgb(images: list[np.ndarray]) -> list[bytes]:
    """A file of each image ([height, width, 3] bytes): literals under prefix codes fitted to each image's channels, and other ways where there are few colours."""
    if not images:
        return []
    files: list[bytes | None] = [None] * len(images)
    rest, few = [], []
    for i, x in enumerate(images):
        flat = x.reshape(-1, 3)
        if (flat == flat[0]).all():
            files[i] = _flat_image(x.shape[1], x.shape[0], flat[0])
        elif _few_colours(x):
            few.append(i)
        else:
            rest.append(i)
    for i, file in zip(few, _of_few_colours([images[i] for i in few])):
        files[i] = file
    if not rest:
        return files
    sizes = np.array([images[i].shape[0] * images[i].shape[1] for i in rest])
    pixels = np.concatenate([images[i].reshape(-1, 3) for i in rest])
    owner = np.repeat(np.arange(len(rest)), sizes)
    cells = [owner * 768 + (256 * k + pixels[:, channel].astype(np.int64)) for k, channel in enumerate((1, 0, 2))]  # green, red, blue
    counts = sum(np.bincount(c, minlength=len(rest) * 768) for c in cells).reshape(-1, 256)
    lengths = fitted(counts)
    alone = (lengths > 0).sum(1, keepdims=True) == 1  # these take no bits
    table = np.where(alone, 0, canonical(lengths) | lengths << 16).astype(np.uint32).ravel()
    value, width = np.zeros((2, len(pixels)), np.uint32)
    for c in cells:
        got = table[c]
        value |= (got & 0xFFFF) << width
        width += got >> 16
    del cells
    # Each image: its opening (no transform, no colour cache, one group), three codes, those of alpha and distances, its pixels.
    opening, last = 8 + 14 + 14 + 1 + 3 + 3, 2 * 11
    at, piece, row, row_bits = code_pieces(lengths)
    row_bits = row_bits.reshape(-1, 3)
    code_at = opening + np.cumsum(row_bits, 1) - row_bits
    head = opening + row_bits.sum(1) + last
    first = np.cumsum(sizes) - sizes
    n = head + np.add.reduceat(width, first, dtype=np.int64)
    words = (n + 31) // 32 + 1
    origin = np.cumsum(words) - words
    start = 32 * origin
    before = np.cumsum(width, dtype=np.int64) - width
    total = int(words.sum()) + 1
    shape = np.array([images[i].shape[:2] for i in rest]) - 1
    stream = _placed(np.r_[start, start + 22, start + head - last], np.r_[0x2F | shape[:, 1] << 8, shape[:, 0], np.full(len(rest), LAST_CODES)], total)
    stream += _placed(start[row // 3] + code_at.ravel()[row] + at, piece, total)
    stream += _placed(before + (start + head - before[first])[owner], value, total)
    stream = stream.astype("<u4")
    for i, begin, bits in zip(rest, origin.tolist(), n.tolist()):
        files[i] = riff(stream[begin : begin + -(-bits // 32)].tobytes()[: -(-bits // 8)])
    return files

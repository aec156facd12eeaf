"""What needs no Spark: codecs, packing, apportionment, hashing, the classifier, against brute force."""

import cProfile
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import hpylm, jaccard, media, mixing, packing, quality, substring, webp
from marginalia.llm.common import window_hashes


@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 25))
@settings(max_examples=60, deadline=None)
def test_window_hashes_tell_windows_apart(words, k):
    h = window_hashes(np.array(words, np.uint64), k)
    own = [tuple(words[i : i + k]) for i in range(max(0, len(words) - k + 1))]
    assert len(h) == len(own)
    assert len(set(h.tolist())) == len(set(own))


@given(st.lists(st.integers(0, 9), min_size=1, max_size=50), st.integers(1, 12))
@settings(max_examples=50, deadline=None)
def test_sliding(x, k):
    if k <= len(x):
        assert substring.sliding(np.array(x), k).tolist() == [min(x[i : i + k]) for i in range(len(x) - k + 1)]


@given(st.lists(st.integers(1, 9000), max_size=40))
@settings(max_examples=80, deadline=None)
def test_packing_holds_every_id_once_without_padding(lengths):
    sequences = packing.pack(lengths)
    seen = {}
    for s in sequences:
        n = sum(p[2] for p in s)
        assert n <= 4096 and n & (n - 1) == 0
        for d, start, k in s:
            assert k > 0
            seen.setdefault(d, []).append((start, k))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at
            at += k
        assert at == n
    sizes = [sum(p[2] for p in s) for s in sequences]
    steps = packing.steps(sizes)
    loads = np.bincount(steps, sizes) if sizes else np.zeros(1)
    assert loads.max() - loads.min() <= 4096


@given(st.lists(st.tuples(st.floats(0, 1000), st.integers(0, 30)), min_size=1, max_size=9), st.integers(0, 120))
@settings(max_examples=120, deadline=None)
def test_sainte_lague_takes_the_highest_quotients(parties, seats):
    votes, most = [v for v, _ in parties], [m for _, m in parties]
    got = mixing.sainte_lague(votes, seats, most)
    assert sum(got) == min(seats, sum(most)) and all(g <= m for g, m in zip(got, most))
    taken = [v / (2 * g - 1) for v, g in zip(votes, got) if g]
    rest = [v / (2 * g + 1) for v, g, m in zip(votes, got, most) if g < m]
    assert not taken or not rest or min(taken) >= max(rest) * (1 - 1e-12)


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets_share_the_budget_up_to_the_cap(sizes):
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))
    free = [g / (3, 1, 2)[i % 3] for i, (g, n) in enumerate(zip(got, sizes)) if n and g < 2 * n * (1 - 1e-9)]
    assert all(g <= 2 * n * (1 + 1e-9) for g, n in zip(got, sizes))
    assert not free or max(free) == pytest.approx(min(free))


@given(st.binary(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(text):
    p = media.payload(text)
    assert len(p) % 192 == 0 and len(p) > 0 and p.startswith(text)
    stored = media.store([p])
    assert media.read(stored)[0].tobytes() == p


def test_media_of_many_lengths_at_once():
    rng = random.Random(3)
    texts = [bytes(rng.choices(range(97, 97 + rng.randint(1, 26)), k=n)) for n in (0, 1, 192, 193, 6144, 6145, 40_000, 7)] + [bytes(range(256)) * 9]
    stored = media.store([media.payload(t) for t in texts])
    assert [x.tobytes() for x in media.read(stored)] == [media.payload(t) for t in texts]
    assert media.store([media.payload(texts[6])])[0] == stored[6]  # equal texts, equal files
    assert len(media.files_of(stored[6])) == 7


def test_stored_files_hold_references_caches_and_palettes():
    rng = random.Random(4)
    words = [bytes(rng.choices(range(97, 123), k=3)) for _ in range(60)]
    texts = [b"abc" * 5000, b"ab" * 3000 + b"x", b"so it goes\n" * 900, b"".join(rng.choices(words, k=6000)), b"".join(rng.choices(words[:9], k=3000)), bytes(rng.choices(b"ab", k=9000))]
    texts += [b"".join(w + b"&&&" * rng.randint(0, 4) for w in rng.choices(words[:20], k=n)) for n in (40, 300, 3000)]
    stored = media.store([media.payload(t) for t in texts])
    assert [x.tobytes() for x in media.read(stored)] == [media.payload(t) for t in texts]
    found = set()
    for file in (f for m in stored for f in media.files_of(m)):
        bits = webp.Bits(file[20:], 8 + 29 + 3)
        found |= {"palette"} if bits.read(1) else {"cache"} if bits.read(1) else {"literals"}
    assert {"palette", "cache"} <= found
    literal = [webp.encode_rgb([np.frombuffer(rng.randbytes(6144), np.uint8).reshape(32, 64, 3)])[0]]
    assert max(len(f) for m in stored[:3] for f in media.files_of(m)) < len(literal[0]) / 20  # copies


# --- the decoder's other features, from streams written here ----------------


class Stream(webp.Writer):
    """Writes a plane with fixed 8-bit codes for literals, and codes for lengths, distances and cached colours as asked."""

    def codes(self, green, distance_symbols=()):
        self.tables = [self._code(green), *(self._code({s: 8 for s in range(256)}) for _ in range(3)), self._code({s: max(1, (len(distance_symbols) - 1).bit_length()) for s in distance_symbols} or {0: 1})]

    def _code(self, lengths):
        size = max(300 + (1 << 11), 40) if max(lengths) >= 256 else 256
        own = np.zeros(size, np.int64)
        for s, n in lengths.items():
            own[s] = n
        webp.write_code(self, own)
        return own, webp.canonical(own[None])[0]

    def symbol(self, table, s):
        own, codes = self.tables[table]
        if (own > 0).sum() > 1:
            self.put(int(codes[s]), int(own[s]))

    def literal(self, pixel):
        a, r, g, b = pixel >> 24, pixel >> 16 & 255, pixel >> 8 & 255, pixel & 255
        for table, s in ((0, g), (1, r), (2, b), (3, a)):
            self.symbol(table, s)

    def plane(self, pixels):
        """A sub-image: no cache, literals."""
        self.put(0, 1)
        self.codes({s: 8 for s in range(256)})
        for p in pixels:
            self.literal(int(p))

    def number(self, table, base, value):
        """A length or distance as its code and extra bits."""
        if value <= 4:
            self.symbol(table, base + value - 1)
            return
        v = value - 1
        n = v.bit_length() - 2
        self.symbol(table, base + 2 * (n + 1) + (v >> n & 1))
        self.put(v & (1 << n) - 1, n)


def _opened(width, height):
    out = Stream()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out


def _file(out):
    return webp.riff(out.word.to_bytes(-(-out.n // 8), "little"))


def _image(width, height, seed=1, colours=None):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 32, width * height, dtype=np.uint64).astype(np.uint32)
    return rng.choice(x[:colours], width * height) if colours else x


def _literals(out, pixels):
    out.put(0, 1)  # no transform follows
    out.put(0, 1)
    out.put(0, 1)
    out.codes({s: 8 for s in range(256)})
    for p in pixels:
        out.literal(int(p))


def test_subtract_green():
    x = _image(5, 3)
    a, r, g, b = webp._split(x)
    out = _opened(5, 3)
    out.put(1, 1), out.put(webp.GREEN, 2)
    _literals(out, webp._merge(a, r - g, g, b - g))
    assert (webp.decode([_file(out)])[0].ravel() == x).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette(colours):
    w, h = 13, 6
    x = _image(w, h, 2, colours)
    table = np.unique(x)
    index = np.searchsorted(table, x).reshape(h, w)
    out = _opened(w, h)
    out.put(1, 1), out.put(webp.PALETTE, 2), out.put(len(table) - 1, 8)
    parts = [np.diff(np.r_[0, c]) for c in webp._split(table)]
    out.plane(webp._merge(*parts))
    bits = webp.pack_bits(len(table))
    per = 8 >> bits
    wide = -(-w // (1 << bits))
    padded = np.zeros((h, wide << bits), np.int64)
    padded[:, :w] = index
    packed = (padded.reshape(h, wide, -1) << (np.arange(1 << bits) * per)).sum(2)
    _literals(out, (packed.ravel() << 8 | 0xFF000000).astype(np.uint32))
    assert (webp.decode([_file(out)])[0].ravel() == x).all()


def test_cross_colour():
    w, h, size = 10, 9, 2
    x = _image(w, h, 4)
    factors = _image(-(-w // 4), -(-h // 4), 5)
    y, c = np.divmod(np.arange(w * h), w)
    own = factors[(y >> size) * -(-w // 4) + (c >> size)]
    signed = lambda v: ((v & 255) ^ 128) - 128
    a, r, g, b = webp._split(x)
    _, to_blue_r, to_blue_g, to_red = (signed(v) for v in webp._split(own))
    sent = webp._merge(a, r - (to_red * signed(g) >> 5), g, b - (to_blue_g * signed(g) >> 5) - (to_blue_r * signed(r) >> 5))
    out = _opened(w, h)
    out.put(1, 1), out.put(webp.CROSS, 2), out.put(size - 2, 3)
    out.plane(factors)
    _literals(out, sent)
    assert (webp.decode([_file(out)])[0].ravel() == x).all()


def _mean(a, b):
    return [(p + q) // 2 for p, q in zip(a, b)]


def _rule(mode, left, top, corner, right):
    """The fourteen predictors, written out once more."""
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode < 5:
        return [left, top, right, corner][mode - 1]
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode < 10:
        return _mean(*[(left, corner), (left, top), (corner, top), (top, right)][mode - 6])
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    guess = [p + q - c for p, q, c in zip(left, top, corner)]
    if mode == 11:
        far = lambda z: sum(abs(g - v) for g, v in zip(guess, z))
        return left if far(left) < far(top) else top
    if mode == 12:
        return [min(255, max(0, g)) for g in guess]
    return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(_mean(left, top), corner)]


def test_predictor_of_every_mode():
    w, h, size = 17, 16, 2
    x = _image(w, h, 6)
    across = -(-w // 4)
    modes = np.arange(across * (h // 4)) % 16
    p = np.stack(webp._split(x), 1).tolist()
    sent = []
    for i in range(w * h):
        r, c = divmod(i, w)
        if not r:
            guess = p[i - 1] if c else [255, 0, 0, 0]
        elif not c:
            guess = p[i - w]
        else:
            guess = _rule(int(modes[(r >> size) * across + (c >> size)]), p[i - 1], p[i - w], p[i - w - 1], p[i - w + 1])
        sent.append([(v - g) & 255 for v, g in zip(p[i], guess)])
    out = _opened(w, h)
    out.put(1, 1), out.put(webp.PREDICTOR, 2), out.put(size - 2, 3)
    out.plane((modes << 8 | 0xFF000000).astype(np.uint32))
    _literals(out, webp._merge(*np.array(sent).T))
    assert (webp.decode([_file(out)])[0].ravel() == x).all()


def test_back_references_and_colour_cache():
    w, h, bits = 16, 8, 4
    rng = random.Random(8)
    colours = [int(v) for v in _image(6, 1, 9)]
    files, images = [], []
    for _ in range(5):
        out = _opened(w, h)
        out.put(0, 1)
        out.put(1, 1), out.put(bits, 4)
        out.put(0, 1)
        green = {s: 9 for s in range(256 + 24 + (1 << bits))}
        for s in list(green)[: 512 - len(green)]:
            green[s] = 8  # 512 places of 9 bits: as many shorter codes as make the code complete
        out.codes(green, tuple(range(32)))
        pixels, cache = [], [0] * (1 << bits)
        slot = lambda v: (v * webp.HASH & 0xFFFFFFFF) >> (32 - bits)
        while len(pixels) < w * h:
            at, kind = len(pixels), rng.random()
            if kind < 0.3 and at > 20:
                n = rng.randint(1, min(20, w * h - at))
                short = rng.random() < 0.5
                if short:
                    k = rng.randrange(40)
                    dx, dy = webp.SHORT_DISTANCES[k]
                    distance, code = max(1, dx + dy * w), k + 1
                    if distance > at:
                        continue
                else:
                    distance = rng.randint(1, at)
                    code = distance + 120
                out.number(0, 256, n)
                out.number(4, 0, code)
                for _ in range(n):
                    pixels.append(pixels[-distance])
                    cache[slot(pixels[-1])] = pixels[-1]
                continue
            v = rng.choice(colours)
            if cache[slot(v)] == v:
                out.symbol(0, 280 + slot(v))
            else:
                out.literal(v)
            pixels.append(v)
            cache[slot(v)] = v
        files.append(_file(out))
        images.append(pixels)
    for got, pixels in zip(webp.decode(files), images):
        assert got.ravel().tolist() == pixels


def test_groups_of_codes():
    w, h, size = 12, 8, 2
    x = _image(w, h, 11)
    across = -(-w // 4)
    which = np.arange(across * (h // 4)) % 3
    out = _opened(w, h)
    out.put(0, 1), out.put(0, 1), out.put(1, 1), out.put(size - 2, 3)
    out.plane((which << 8 | 0xFF000000).astype(np.uint32))
    groups = []
    for k in range(3):
        out.codes({s: (8, 7 if s < 64 else 9 if s < 128 + 64 and s >= 64 else 8, 8)[k] if k != 1 else 8 for s in range(256)})
        groups.append(out.tables)
    for i, p in enumerate(x):
        r, c = divmod(i, w)
        out.tables = groups[which[(r >> size) * across + (c >> size)]]
        out.literal(int(p))
    assert (webp.decode([_file(out)])[0].ravel() == x).all()


def test_broken_files_are_refused():
    good = media.store([b"abc" * 64])[0]
    for bad in (b"", b"RIFF", good[:12] + b"VP8 " + good[16:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode([bad])
    cut = good[:40]
    with pytest.raises(ValueError):
        webp.decode([cut])


@given(st.lists(st.lists(st.integers(0, 400), min_size=2, max_size=120), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_fitted_codes_are_complete(rows):
    wide = max(map(len, rows))
    counts = np.zeros((len(rows), max(2, wide)), np.int64)
    for i, r in enumerate(rows):
        counts[i, : len(r)] = r
    counts[:, 0] += 1
    counts[:, 1] += 1
    for lengths in webp.fitted(counts):
        assert (1 << (10 - lengths[lengths > 0])).sum() == 1 << 10


def _lettered(n: int) -> list[bytes]:
    rng = random.Random(8)
    return [media.payload(bytes(rng.choices(range(32, 32 + rng.randint(30, 90)), k=rng.choice([700, 6144, 2000])))) for _ in range(n)]


def test_codes_of_all_images_are_coded_side_by_side():
    def calls(payloads: list[bytes]) -> int:
        profile = cProfile.Profile()
        profile.enable()
        media.read(media.store(payloads))
        profile.disable()
        return sum(s.callcount for s in profile.getstats())

    texts = _lettered(600)
    assert (calls(texts) - calls(texts[:200])) / 400 < 250  # 1,711 where each code was written and read by itself


def test_stored_bytes_stay_as_they_were():
    texts = [*_lettered(60), *(media.payload(t) for t in (b"", b"x", b"ab" * 4000, bytes(range(256)) * 50, b"\x00\xff" * 99 + b"abc"))]
    stored = media.store(texts)
    assert hashlib.sha256(b"".join(stored)).hexdigest() == "c65acba9f62e150c793883605d4a7275ce2258b9155f5e806f4da1e9f7494cbc"  # of the encoder before
    assert [x.tobytes() for x in media.read(stored)] == texts


@given(st.lists(st.dictionaries(st.integers(0, 255), st.integers(1, 99_999), min_size=1, max_size=200), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_codes_side_by_side_are_those_written_and_read_alone(rows):
    counts = np.zeros((len(rows), 256), np.int64)
    for i, own in enumerate(rows):
        counts[i, list(own)] = list(own.values())
    lengths = webp.fitted(counts)
    at, value, row, bits = webp.code_pieces(lengths)
    for i, own in enumerate(lengths):
        out = webp.Writer()
        webp.write_code(out, own)
        assert out.n == bits[i]
        assert out.word == sum(v << a for a, v, r in zip(at.tolist(), value.tolist(), row.tolist()) if r == i)
    tables, start, most = webp.lookups(lengths)
    for own, a, m in zip(lengths, start, most):
        assert (tables[a : a + (1 << m)] == webp.lookup(own)).all()


@given(st.lists(st.lists(st.tuples(st.integers(0, 15), st.integers(1, 150)), min_size=1, max_size=20), min_size=1, max_size=5), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_planes_codes_side_by_side_with_runs_and_limits(seeds, rng):
    """Codes with runs of all three kinds, with and without a limit of symbols, of planes with and without a cache."""
    streams, caches = [], []
    for runs in seeds:
        out, cache = webp.Writer(), rng.choice([0, 0, 3, 6])
        shift = rng.randrange(8)
        out.put(0, shift)
        for size in webp._sizes(webp.Plane(webp.Bits(b""), 1, 1, cache)):
            counts = np.zeros((1, size), np.int64)
            for s, n in runs:
                counts[0, (s * 17) % size : (s * 17) % size + n] = 1 + s
            _with_runs(out, webp.fitted(counts)[0], rng)
        streams.append((out.word.to_bytes(-(-out.n // 8), "little"), shift, out.n)), caches.append(cache)
    together, alone = ([webp.Plane(webp.Bits(b, k), 1, 1, c) for (b, k, _), c in zip(streams, caches)] for _ in range(2))
    webp._codes(together)
    for p, q, (_, _, end) in zip(together, alone, streams):
        tables = [webp.lookup(webp.read_code(q.bits, n)) for n in webp._sizes(q)]
        assert p.bits.at == q.bits.at == end
        assert all((a == b).all() for a, b in zip(p.tables, tables, strict=True))


def _with_runs(out: webp.Writer, lengths: np.ndarray, rng: random.Random) -> None:
    """A code that isn't simple, its lengths' own code of 19 symbols, repeats of lengths and of zeros where they can be."""
    own = np.array([4] * 13 + [5] * 6)
    codes = webp.canonical(own[None])[0]
    limited = rng.random() < 0.5
    values, tokens, before = lengths.tolist(), [], 8
    if limited:
        while not values[-1]:
            values.pop()
    at = 0
    while at < len(values):
        v, n = values[at], 1
        while at + n < len(values) and values[at + n] == v:
            n += 1
        if v == 0 and n >= 11:
            n = min(n, 138)
            tokens.append((18, n - 11, 7))
        elif v == 0 and n >= 3:
            tokens.append((17, n - 3, 3))
        elif v and v == before and n >= 3:
            n = min(n, 6)
            tokens.append((16, n - 3, 2))
        else:
            n = 1
            tokens.append((v, 0, 0))
            before = v or before
        at += n
    if limited and len(tokens) < 2:
        tokens.append((0, 0, 0))
    out.put(0, 1), out.put(15, 4)
    for k in webp.CODE_LENGTH_ORDER:
        out.put(int(own[k]), 3)
    out.put(int(limited), 1)
    if limited:
        out.put(4, 3), out.put(len(tokens) - 2, 10)
    for s, extra, n in tokens:
        out.put(int(codes[s]), int(own[s]))
        out.put(extra, n)


# --- similarity -------------------------------------------------------------


def test_schemes_satisfy_the_pigeonhole():
    for n in [*range(1, 400), 1000, 5000, 30_000]:
        k, low, high = jaccard.bands(n)
        assert low <= n <= high
        h, m, t = jaccard.scheme(low, high)
        assert m + t >= h + 1 and h >= (high + high * 100 // 80) * 20 // 180
        assert jaccard.bands(n * 100 // 80)[0] <= k + 1


def test_linked_sets_share_signatures():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        lost = int(rng.integers(0, n // 9 + 1))
        more = int(rng.integers(0, n // 9 + 1))
        y = np.r_[x[lost:], rng.integers(0, 1 << 63, more, dtype=np.uint64) * np.uint64(2)]
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        found = 0
        for s, lose, _ in jaccard.signatures(x):
            for u, other, _ in jaccard.signatures(y):
                shared = len(np.intersect1d(s, u))
                found = max(found, shared if shared > max(lose, other) else 0)
        assert found > 0, (len(x), len(y), both)


def test_common_elements_are_counted():
    rng = np.random.default_rng(6)
    core = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(core, rng.integers(0, 50), replace=False), rng.integers(0, 40, rng.integers(0, 9), dtype=np.uint64)]) for _ in range(70)]
    for left, right in ((sets, sets), (sets[:25], sets[25:]), (sets[:1], sets[1:])):
        got = jaccard.common(left, right)
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


# --- models -----------------------------------------------------------------


def test_classifier_learns_and_is_deterministic():
    rng = random.Random(2)
    good = [" ".join(rng.choices("the of and to in a is that for it".split(), k=40)).encode() for _ in range(80)]
    bad = [" ".join([rng.choice(["x$$", "y%%", "z##"])] * 40).encode() for _ in range(80)]
    w = quality.train(good[:60] + bad[:60], [1] * 60 + [0] * 60)
    assert (w == quality.train(good[:60] + bad[:60], [1] * 60 + [0] * 60)).all()

    def p(t):
        (at,) = quality.features([t])
        return quality.logistic(w[-1] + w[at].sum() / np.sqrt(max(1, len(at))))

    assert all(p(t) > 0.5 for t in good[60:]) and all(p(t) < 0.5 for t in bad[60:])


def test_classifier_equals_plain_ftrl():
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    rows = [(" ".join(rng.choices(words[: 60 - 30 * (k % 2)], k=rng.randint(0, 50))).encode(), k % 2) for k in range(60)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for t, y in rows:
            (at,) = quality.features([t])
            x = {int(i): float(np.float32(k / math.sqrt(len(at)))) for i, k in Counter(at.tolist()).items()} | {1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    got = quality.train([t for t, _ in rows], [y for _, y in rows])
    assert set(np.flatnonzero(got).tolist()) == {i for i in z if weight(i)}
    assert all(got[i] == pytest.approx(weight(i), rel=1e-4, abs=1e-6) for i in z)


def test_tables_stay_between_one_and_customers():
    rng = np.random.default_rng(1)
    c = rng.integers(0, 300, 500).astype(float)
    t = hpylm.seated(c, np.minimum(c, 1), np.full(500, 3.0), 0.5, rng)
    assert (t <= c).all() and (t[c > 0] >= 1).all() and (t[c == 0] == 0).all()
    assert t.mean() > 1.5



def test_a_sweep_reseats_all_customers_of_large_dishes():
    rng, n = np.random.default_rng(3), 400
    c, weight = np.full(n, 20_000.0), np.full(n, 3.0)
    few, many = np.ones(n), np.full(n, 2_000.0)
    for _ in range(40):
        few, many = hpylm.seated(c, few, weight, 0.5, rng), hpylm.seated(c, many, weight, 0.5, rng)
    assert few.mean() == pytest.approx(many.mean(), rel=0.15)  # whatever they start from
    turned = rng.integers(2, 40, 300).astype(float)  # turn by turn, as the docstring says
    t = np.ones(300)
    for turn in range(40):
        at = np.flatnonzero(turned > turn)
        k = t[at] - (rng.random(len(at)) < (t[at] - 1) * 0.5 / turned[at])
        join = np.maximum(turned[at] - 1 - 0.5 * k, 0)
        t[at] = np.clip(k + (rng.random(len(at)) * (join + 3) < 3), 1, turned[at])
    got = np.mean([hpylm.seated(turned, np.ones(300), np.full(300, 3.0), 0.5, rng).mean() for _ in range(20)])
    assert got == pytest.approx(t.mean(), rel=0.08)


def test_probabilities_of_all_words_add_up_to_one():
    rng = np.random.default_rng(2)
    c = rng.integers(0, 4, (500, hpylm.CLASSES))
    c = c[c.sum(1) > 0]
    state = object.__new__(hpylm.State)
    state.v, state.c, state.discount, state.discount0 = len(c), c.sum(0).astype(float), 0.6, 0.5
    t = np.minimum(c, 1 + rng.integers(0, 2, c.shape))
    t0 = np.minimum(t.sum(1), 1 + rng.integers(0, 3, len(c)))
    state.t, state.t0 = t.sum(0).astype(float), int(t0.sum())
    parent, unknown = state.parent_p(t.sum(1), t0), state.parent_p(np.zeros(1), np.zeros(1))[0]
    assert parent.sum() + unknown == pytest.approx(1)
    own = np.maximum(c - state.discount * t, 0) / (hpylm.STRENGTH + state.c)[None]
    p = own + state.passed_up()[None] * parent[:, None]
    assert p.sum(0) + state.passed_up() * unknown == pytest.approx(np.ones(hpylm.CLASSES))

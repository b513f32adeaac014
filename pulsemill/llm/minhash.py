"""Minwise signatures of the four-character stretches of a text's key form, vectorised in numpy.

``SIZE`` hash functions give one minimum each.  The first ``bands * rows`` of them make a
scheme's band keys (40 bits each, the band's number above them); one bit of every minimum makes
the ``SIZE``-bit sketch whose Hamming distance estimates similarity: two texts of Jaccard
similarity J differ in ``SIZE * (1 - J) / 2`` bits on average.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

STRETCH = 4
SIZE = 128
LEAST_LETTERS = 40
SIMILAR = 0.6
KEY_BYTES = 5


@dataclass(frozen=True)
class Scheme:
    """Band keys of ``rows`` minima each, and the distance of sketches up to which a pair is looked at.

    A pair of similarity J is missed by the bands with probability ``(1 - J ** rows) ** bands``.
    """

    bands: int
    rows: int
    radius: int

    @property
    def blob_bytes(self) -> int:
        return SIZE // 8 + self.bands * KEY_BYTES


#: a pair of 0.6 is missed with probability 0.045, one of 0.65 with 0.012, one of 0.7 with 0.002; mean distance at 0.6 is 25.6 with deviation 4.5
USUAL = Scheme(22, 4, 42)
#: a pair of 0.6 is missed with probability 0.00004
THOROUGH = Scheme(42, 3, 56)

_rng = np.random.default_rng(20200301)
_A = (_rng.integers(1, 2**31, SIZE, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 2**32, SIZE, dtype=np.uint64).astype(np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xD6E8FEB86659FD93)
#: texts are taken in runs of about so many characters, so that a run's hashes stay in the processor's cache
_RUN = 60_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def stretch_hashes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all stretches of all keys, and where each key's begin; every key has STRETCH characters or more."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    points = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - STRETCH + 1
    h = points[:n].copy()
    for i in range(1, STRETCH):
        h = h * _M + points[i : i + n]
    ends = np.cumsum(sizes)
    keep = np.ones(len(points), bool)
    for i in range(1, STRETCH):
        keep[ends - i] = False
    starts = np.concatenate(([0], np.cumsum(sizes - STRETCH + 1)[:-1]))
    return _mix(h[keep[:n]]), starts


def minima(keys: list[str]) -> np.ndarray:
    """The minima of each key, one row of SIZE values per key."""
    out = np.empty((len(keys), SIZE), np.uint32)
    at = 0
    while at < len(keys):
        to, size = at, 0
        while to < len(keys) and (size < _RUN or to == at):
            size += len(keys[to])
            to += 1
        h, starts = stretch_hashes(keys[at:to])
        x = (h >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for k in range(SIZE):
            np.multiply(x, _A[k], out=y)
            y += _B[k]
            out[at:to, k] = np.minimum.reduceat(y, starts)
        at = to
    return out


def blobs(keys: list[str], scheme: Scheme = USUAL) -> list[bytes]:
    """Per key the sketch and the band keys, packed into ``blob_bytes``."""
    if not keys:
        return []
    m = minima(keys)
    sketch = np.packbits(((m >> np.uint32(9)) & np.uint32(1)).astype(np.uint8), axis=1)
    bands = m[:, : scheme.bands * scheme.rows].reshape(len(keys), scheme.bands, scheme.rows).astype(np.uint64)
    h = np.full((len(keys), scheme.bands), np.uint64(0x51ED270B))
    for i in range(scheme.rows):
        h = _mix((h + bands[:, :, i]) * _M)
    low = h.astype("<u8").view(np.uint8).reshape(len(keys), scheme.bands, 8)[:, :, :KEY_BYTES]
    packed = np.concatenate([sketch, low.reshape(len(keys), -1)], axis=1)
    return [row.tobytes() for row in packed]


def unpack(packed: list[bytes], scheme: Scheme = USUAL) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as SIZE / 64 signed words a row, and band keys as signed longs, one a band."""
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), scheme.blob_bytes)
    words = np.ascontiguousarray(raw[:, : SIZE // 8]).view("<i8")
    keys = np.zeros((len(packed), scheme.bands, 8), np.uint8)
    keys[:, :, :KEY_BYTES] = raw[:, SIZE // 8 :].reshape(len(packed), scheme.bands, KEY_BYTES)
    keys[:, :, KEY_BYTES] = np.arange(scheme.bands, dtype=np.uint8)
    return words, keys.reshape(len(packed), -1).view("<i8")


def text_hash(key: str) -> int:
    """64-bit hash of a key form as a signed long."""
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) - 2**63


def stretches(key: str) -> set[str]:
    """The distinct stretches of a key form."""
    return {key[i : i + STRETCH] for i in range(len(key) - STRETCH + 1)}


def near(x: set[str], y: set[str], least: float = SIMILAR) -> bool:
    """Exact check: Jaccard similarity of two sets of stretches."""
    if not x or not y or min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= least * (len(x) + len(y) - both)


def alike(a: str, b: str, least: float = SIMILAR) -> bool:
    """``near`` of two key forms; equal ones are, however short."""
    return a == b or near(stretches(a), stretches(b), least)


def alike_each(left: list[str], right: list[str], least: float = SIMILAR) -> list[bool]:
    """``alike`` of each two of the lists; the stretches of a form that comes again are made once."""
    made: dict[str, set[str]] = {}

    def of(form: str) -> set[str]:
        if form not in made:
            made[form] = stretches(form)
        return made[form]

    return [a == b or near(of(a), of(b), least) for a, b in zip(left, right)]

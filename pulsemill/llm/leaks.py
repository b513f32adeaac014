"""Held-out passages inside a corpus, whole or in part and edited (problem 9).

Texts are compared as their key forms (consistent form, lower case, letters and digits only), so
case, punctuation, white space and look-alike characters do not matter.  An item's unit is the
word, in languages written without spaces the character.

Filtering by the q-gram lemma: a run of ``r`` characters that both hold has ``r - q + 1`` q-grams
on one diagonal (document position less item position).  Only the two ends of a run are looked
up: a shared q-gram begins a run unless the characters before it agree too, and ends one unless
those behind it do, so the q-grams of an item are kept by the character on either side and text
that repeats itself costs its runs, not its positions times positions.  The q-grams of all runs
are counted in two overlapping diagonal bands; a band of fewer q-grams than the item's shortest
run of units must have is dropped.  What is left is verified by alignment inside the band: along
each of its diagonals the stretches where both agree, and the item's units that lie in such a
stretch whole.  Runs of the least number of units or more count, each unit of the item once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .bktree import ranges
from .textform import consistent

LEAST_SHARE = 0.4
WORDS, CHARACTERS = 8, 16
#: languages whose unit is the character
UNSPACED = ("zh", "ja", "th", "lo", "km", "my")
#: q-gram lengths; an item takes the longest one that leaves its shortest run LEAST_GRAMS q-grams
QS = (16, 10, 5, 2, 1)
LEAST_GRAMS = 4
#: half the width of a diagonal band
HALF_BAND = 16
#: characters of items that are broadcast at once (a block); larger sets take several blocks
BLOCK_CHARS = 8_000_000
#: characters of documents searched at once
RUN_CHARS = 2_000_000

_NOT_KEY = re.compile(r"[\W_]+")
_B = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def units(text: str | None, by_character: bool) -> list[str]:
    """The units of a text, each in key form."""
    s = (consistent(text) or "").lower()
    if by_character:
        return list(_NOT_KEY.sub("", s))
    return [u for u in (_NOT_KEY.sub("", w) for w in s.split()) if u]


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position, by doubling; positions less than q from the end have none."""
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, h, size = None, 0, points.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        while size <= q:
            if q & size:
                shift = np.uint64(pow(int(_B), size, 2**64))
                out = h.copy() if out is None else out[: len(points) - have - size + 1] * shift + h[have : have + len(points) - have - size + 1]
                have += size
            shift = np.uint64(pow(int(_B), size, 2**64))
            h = h[: max(0, len(h) - size)] * shift + h[size:]
            size *= 2
    x = out[:n]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: stand before the first and behind the last character; no two of them agree
_ITEM_EDGE, _TEXT_EDGE = 0xFFFFFFFE, 0xFFFFFFFF


@dataclass
class Grams:
    """The q-grams of the items that use one q: distinct hashes, where each one's entries begin, and those by the character before (of a run's begin) and behind it (of its end)."""

    q: int
    hashes: np.ndarray
    first: np.ndarray
    sides: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]  # (hash number << 32 | character, item, position) sorted
    seen: np.ndarray

    @staticmethod
    def of(q: int, members: list[int], points: list[np.ndarray]) -> Grams:
        h = [gram_hashes(points[i], q) for i in members]
        n = [len(x) for x in h]
        item, at = np.repeat(np.array(members, np.int64), n), np.concatenate([np.arange(k) for k in n])
        edge = np.array([_ITEM_EDGE], np.uint64)
        before = np.concatenate([np.concatenate((edge, points[i].astype(np.uint64)))[: len(x)] for i, x in zip(members, h)])
        behind = np.concatenate([np.concatenate((points[i].astype(np.uint64)[q:], edge)) for i in members])
        hashes, number = np.unique(np.concatenate(h), return_inverse=True)
        sides = []
        for c in (before, behind):
            key = number.astype(np.uint64) << np.uint64(32) | c
            order = np.argsort(key, kind="stable")
            sides.append((key[order], item[order], at[order].astype(np.int64)))
        seen = np.zeros(1 << _BITS, bool)
        seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return Grams(q, hashes, np.searchsorted(np.sort(number), np.arange(len(hashes) + 1)), tuple(sides), seen)

    def ends(self, number: np.ndarray, c: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the q-grams ``number`` whose character on that side is not ``c``, and which q-gram each is of."""
        key, _, _ = self.sides[side]
        mine = number.astype(np.uint64) << np.uint64(32) | c
        a, b = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
        lo, hi = np.stack((self.first[number], b), 1).ravel(), np.stack((a, self.first[number + 1]), 1).ravel()
        entry, which = ranges(lo, hi)
        return entry, which // 2


@dataclass
class Items:
    """A block of items made ready: what the tasks search for."""

    ids: np.ndarray
    points: list[np.ndarray]
    unit_starts: list[np.ndarray]
    run: np.ndarray
    least: np.ndarray
    threshold: np.ndarray
    grams: list[Grams]


def prepare(ids: list[int], texts: list[str | None], langs: list[str | None]) -> Items:
    """Items with fewer units than a run needs can leak nothing and are left out of the q-grams."""
    points, starts, runs, least, threshold = [], [], [], [], []
    by_q: dict[int, list[int]] = {}
    for i, (text, lang) in enumerate(zip(texts, langs)):
        by_char = (lang or "").lower()[:2] in UNSPACED
        u, run = units(text, by_char), CHARACTERS if by_char else WORDS
        sizes = np.fromiter(map(len, u), np.int64, len(u))
        start = np.concatenate(([0], np.cumsum(sizes)))
        points.append(_points("".join(u)))
        starts.append(start)
        runs.append(run)
        least.append(LEAST_SHARE * len(u))
        threshold.append(0)
        if len(u) >= run:
            shortest = int((start[run:] - start[:-run]).min())
            q = next(q for q in QS if shortest - q + 1 >= min(LEAST_GRAMS, shortest))
            threshold[-1] = shortest - q + 1
            by_q.setdefault(q, []).append(i)
    grams = [Grams.of(q, members, points) for q, members in sorted(by_q.items())]
    return Items(np.array(ids, np.int64), points, starts, np.array(runs), np.array(least), np.array(threshold, np.int64), grams)


def search(items: Items, forms: list[str]) -> list[tuple[int, int]]:
    """(index of the form, index of the item) of every leak."""
    points = _points("".join(forms))
    ends = np.cumsum(np.fromiter(map(len, forms), np.int64, len(forms)))
    starts = np.concatenate(([0], ends))[:-1]
    found: list[tuple[int, int]] = []
    for g in items.grams:
        h = gram_hashes(points, g.q)
        pos = np.flatnonzero(g.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        number = np.minimum(np.searchsorted(g.hashes, h[pos]), len(g.hashes) - 1)
        keep = g.hashes[number] == h[pos]
        pos, number = pos[keep], number[keep]
        doc = np.searchsorted(ends, pos, "right")
        keep = pos + g.q <= ends[doc]
        pos, number, doc = pos[keep], number[keep], doc[keep]
        if not len(pos):
            continue
        edge = np.uint64(_TEXT_EDGE)
        before = np.where(pos == starts[doc], edge, points[np.maximum(pos - 1, 0)].astype(np.uint64))
        behind = np.where(pos + g.q == ends[doc], edge, points[np.minimum(pos + g.q, len(points) - 1)].astype(np.uint64))
        sides = []
        for side, c in enumerate((before, behind)):
            entry, which = g.ends(number, c, side)
            _, item, at = g.sides[side]
            pair, at = doc[which] * len(items.ids) + item[entry], at[entry]
            diagonal = pos[which] - starts[doc[which]] - at
            order = np.lexsort((at, diagonal, pair))
            sides.append((pair[order], diagonal[order], at[order]))
        (pair, diagonal, begin), (_, _, last) = sides  # the k-th begin and the k-th end of a diagonal are one run's
        found.extend(_bands(items, points, starts, pair, diagonal, begin, last - begin + 1, g.q))
    return found


def _bands(items: Items, points: np.ndarray, starts: np.ndarray, pair: np.ndarray, diagonal: np.ndarray, begin: np.ndarray, grams: np.ndarray, q: int) -> list[tuple[int, int]]:
    """Band counts of the runs, then verification of each (document, item) that has a band of enough q-grams."""
    band = np.floor_divide(diagonal, HALF_BAND)
    # a run counts in the band that begins at its half band and in the one before: all diagonals within HALF_BAND meet in one
    key = np.concatenate((np.stack((pair, band), 1), np.stack((pair, band - 1), 1)))
    order = np.lexsort((key[:, 1], key[:, 0]))
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
    count = np.add.reduceat(np.concatenate((grams, grams))[order], first)
    kept = count >= items.threshold[key[first][:, 0] % len(items.ids)]
    good = np.zeros(len(key), bool)
    good[order] = np.repeat(kept, np.diff(np.append(first, len(key))))
    good = good[: len(pair)] | good[len(pair) :]  # runs in a band that is kept
    pair, diagonal, begin, end = pair[good], diagonal[good], begin[good], begin[good] + grams[good] + q - 1
    out = []
    cuts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else []
    for a, b in zip(cuts, [*cuts[1:], len(pair)]):
        d, i = divmod(int(pair[a]), len(items.ids))
        at, run = items.unit_starts[i], int(items.run[i])
        lo, hi = np.searchsorted(at, begin[a:b], "left"), np.searchsorted(at, end[a:b], "right") - 1
        long = np.flatnonzero(hi - lo >= run)
        held = np.zeros(len(at) - 1, bool)
        for k in long[np.lexsort((lo[long] - hi[long], lo[long]))]:
            x, y = int(lo[k]), int(hi[k])
            if not held[x:y].all() and _agree(points, starts[d], items.points[i], int(diagonal[a + k]), int(at[x]), int(at[y])):
                held[x:y] = True
        if held.sum() >= items.least[i] - 1e-9:
            out.append((d, i))
    return out


def _agree(points: np.ndarray, start: int, form: np.ndarray, diagonal: int, lo: int, hi: int) -> bool:
    """Whether the item's characters lo to hi stand in the text on this diagonal: q-grams were compared by hash."""
    at = int(start) + diagonal
    return bool((points[at + lo : at + hi] == form[lo:hi]).all())


def _block(items: DataFrame, docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = items.collect()  # of bounded size: see ``leaks``
    ready = spark.sparkContext.broadcast(prepare([r["item_id"] for r in rows], [r["text"] for r in rows], [r["lang"] for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = ready.value

        def emit(ids: list, forms: list[str]) -> pd.DataFrame:
            hit = search(block, forms)
            return pd.DataFrame({"doc_id": np.array([ids[d] for d, _ in hit], np.int64), "item_id": np.array([block.ids[i] for _, i in hit], np.int64)})

        ids, forms, size = [], [], 0
        for b in batches:
            for i, t in zip(b["doc_id"].tolist(), b["text"]):
                form = _NOT_KEY.sub("", (consistent(t) or "").lower())
                ids.append(i)
                forms.append(form)
                size += len(form)
                if size >= RUN_CHARS:
                    yield emit(ids, forms)
                    ids, forms, size = [], [], 0
        if ids:
            yield emit(ids, forms)

    return spread(docs).mapInPandas(run, "doc_id long, item_id long")


def _blocks(items: DataFrame, block_chars: int) -> list[DataFrame]:
    """``items`` in parts of about ``block_chars`` characters: an item of an eighth of that or more is placed by its length, the others by a hash of the id."""
    items = items.withColumn("_n", F.length("text"))
    large = items.where(F.col("_n") * 8 >= block_chars)
    rows = large.select("item_id", "_n").collect()  # no more than eight for each block
    parts: list[tuple[int, list[int]]] = []
    for n, i in sorted(((r["_n"], r["item_id"]) for r in rows), reverse=True):
        if parts and parts[-1][0] + n <= block_chars:
            parts[-1] = (parts[-1][0] + n, [*parts[-1][1], i])
        else:
            parts.append((n, [i]))
    out = [large.where(F.col("item_id").isin(ids)) for _, ids in parts]
    small = items.where(F.col("_n") * 8 < block_chars)
    chars = small.agg(F.sum("_n").alias("n")).first()["n"]  # one row
    if chars is not None:
        k = max(1, -(-2 * chars // block_chars)) if chars > block_chars else 1
        out += [small.where(F.pmod(F.xxhash64("item_id"), F.lit(k)) == i) for i in range(k)]
    return [p.drop("_n") for p in out]


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): documents that hold LEAST_SHARE of an item's units or more in long runs.

    Null ids and null texts are no cases; a repeated row counts once; other columns are not read;
    empty tables give no rows.  A null item language means words.  Items are broadcast in blocks
    of about ``block_chars`` characters, whatever their number; each block passes over the corpus
    once.  An item longer than that is a block of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long"), "text", "lang").where("item_id is not null and text is not null")
    parts = [_block(p, docs) for p in _blocks(items, block_chars)]
    if not parts:
        return docs.select("doc_id", F.col("doc_id").alias("item_id")).limit(0)
    return reduce(DataFrame.unionByName, parts).distinct()

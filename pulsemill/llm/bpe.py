"""Byte-level byte-pair encoding of whole batches through one hierarchical-bitmap rank queue (problem 8).

A batch's distinct pre-tokens lie in one linked list of symbols.  The queue has a bucket for
each merge rank; a bucket holds list positions where that rank's pair was seen.  A bitmap of
three levels of 64-bit words marks the buckets in use, so the lowest rank is three
find-first-set steps away.  A rank's positions are merged together, whatever pre-token they
are in; positions whose pair has changed since are stale and skipped.  That gives each
pre-token its own merge order, since a merge only makes pairs of higher rank (a pair can be
listed only after the token it contains), and costs in proportion to the symbols, so a
pre-token of a million bytes is no special case.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: characters of text encoded at once, and pieces and pre-tokens a worker remembers: of each, and characters of both
RUN_CHARS = 24_000_000
REMEMBERED, REMEMBERED_CHARS = 200_000, 16_000_000
#: buckets of up to so many positions are merged one by one
FEW = 6


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    out.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(plain)))
    return out


class Merges:
    """The merge table: byte symbols, and for each rank its pair and the id it makes."""

    def __init__(self, source: bytes) -> None:
        model = json.loads(source)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in byte_letters().items():
            self.byte_id[b] = vocab[letter]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.none = len(pairs)
        made_at = np.full(max(vocab.values()) + 1, -1)
        made_at[self.made] = np.arange(self.none)
        if (np.maximum(made_at[self.left], made_at[self.right]) >= np.arange(self.none)).any():
            raise ValueError("a merge is listed before a token it contains")
        key = self.left.astype(np.int64) << 20 | self.right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.of = dict(zip(key.tolist(), range(self.none)))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``none`` where it is not in the table; a negative symbol is no symbol."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where((self.keys[at] == key) & (b >= 0) & (a >= 0), self.ranks[at], self.none)


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def put(self, rank: int, positions) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        bucket.append(positions)

    def put_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
        first = ranks[[0, *cuts]].tolist()
        for rank, a, b in zip(first, [0, *cuts], [*cuts, len(ranks)]):
            self.put(rank, positions[a:b])

    def take(self) -> tuple[int, list]:
        """The lowest rank in use and what its bucket holds; rank -1 when the queue is empty."""
        if not self.top:
            return -1, []
        t = (self.top & -self.top).bit_length() - 1
        m = t << 6 | (self.mid[t] & -self.mid[t]).bit_length() - 1
        r = m << 6 | (self.low[m] & -self.low[m]).bit_length() - 1
        self.low[m] &= self.low[m] - 1
        if not self.low[m]:
            self.mid[t] &= self.mid[t] - 1
            if not self.mid[t]:
                self.top &= self.top - 1
        held, self.buckets[r] = self.buckets[r], []
        return r, held


def merge_all(words: list[bytes], table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each has; no word is empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    sym = np.empty(n + 1, np.int32)
    sym[:n] = table.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    sym[n] = -1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    nxt = np.arange(1, n + 2, dtype=np.int32)
    nxt[starts[1:] - 1] = n
    nxt[n - 1 :] = n
    prv = np.arange(-1, n, dtype=np.int32)
    prv[starts] = n
    prv[n] = n
    live = np.ones(n + 1, bool)
    flag = np.zeros(n + 1, bool)
    queue = RankQueue(table.none)
    r0 = table.rank(sym[:n], sym[nxt[:n]])
    seen = np.flatnonzero(r0 < table.none)
    queue.put_all(r0[seen], seen.astype(np.int32))
    left, right, made, of = table.left, table.right, table.made, table.of
    while True:
        r, held = queue.take()
        if r < 0:
            break
        a, b, c = int(left[r]), int(right[r]), int(made[r])
        if len(held) <= FEW and sum(map(len, held)) <= FEW:
            for p in sorted({int(x) for part in held for x in part}):
                q = int(nxt[p])
                if sym[p] != a or sym[q] != b or not live[p]:
                    continue
                after, before = int(nxt[q]), int(prv[p])
                sym[p], live[q], nxt[p], prv[after] = c, False, after, p
                sym[q] = -2
                if after != n and (k := of.get(c << 20 | int(sym[after]))) is not None:
                    queue.put(k, (p,))
                if before != n and (k := of.get(int(sym[before]) << 20 | c)) is not None:
                    queue.put(k, (before,))
            prv[n] = n
            continue
        p = np.concatenate(held) if len(held) > 1 else np.asarray(held[0], np.int32)
        p = p[(sym[p] == a) & (sym[nxt[p]] == b) & live[p]]
        if len(held) > 1:
            p = np.unique(p)
        if a == b and len(p) > 1:  # overlapping pairs: take every second one of a run, from its left
            flag[p] = True
            heads = p[~flag[prv[p]]]
            taken = []
            while len(heads):
                taken.append(heads)
                heads = nxt[nxt[heads]]
                heads = heads[flag[heads]]
            flag[p] = False
            p = np.sort(np.concatenate(taken))
        if not len(p):
            continue
        q = nxt[p]
        after = nxt[q]
        sym[p] = c
        live[q] = False
        sym[q] = -2
        nxt[p] = after
        prv[after] = p
        prv[n] = n
        before = prv[p]
        x = np.unique(np.concatenate((p[after != n], before[before != n])))
        k = table.rank(sym[x], sym[nxt[x]])
        ok = k < table.none
        queue.put_all(k[ok], x[ok])
    live[n] = False
    return sym[:n][live[:n]], np.add.reduceat(live[:n].astype(np.int32), starts) if n else np.empty(0, np.int32)


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class _Ragged:
    """Rows of int32 values, appended to and gathered from by number."""

    def __init__(self) -> None:
        self.values, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes = np.concatenate((self.values, values)), np.concatenate((self.sizes, sizes))

    def gather(self, rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``rows`` one after another, and how many fall to each of the ``groups`` (numbers of rows)."""
        starts = np.concatenate(([0], np.cumsum(self.sizes)))
        n = self.sizes[rows]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(starts[rows] - ends[:-1], n) + np.arange(int(ends[-1]))
        return self.values[at], np.diff(ends[np.concatenate(([0], np.cumsum(groups, dtype=np.int64)))])


#: three white-space characters in a row: only there can a cut at each space change the pre-tokens
_WIDE = regex.compile(r"\s{3}")


class Encoder:
    """Encodes batches of texts by distinct pieces (a space and what follows up to the next one) of distinct pre-tokens.

    Pieces and pre-tokens of earlier batches are remembered, up to REMEMBERED of each and
    REMEMBERED_CHARS together; what is over either bound after a batch is forgotten before the next.
    """

    def __init__(self, source: bytes) -> None:
        self.table = Merges(source)
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.tokens, self.token_ids = _Numbers(), _Ragged()
        self.pieces, self.piece_ids = _Numbers(), _Ragged()
        self.chars = 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has: none for None and ""."""
        if max(len(self.tokens), len(self.pieces)) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        number, had, had_tokens = self.pieces.__getitem__, len(self.pieces), len(self.tokens)
        per_text = []
        for t in texts:
            if not t:
                per_text.append([])
            elif _WIDE.search(t):
                per_text.append([number(t)])
            else:
                first, *rest = t.split(" ")
                per_text.append([*([number(first)] if first else []), *map(number, [" " + p for p in rest])])
        if len(self.pieces) > had:
            token, split = self.tokens.__getitem__, self.split
            fresh = list(self.pieces)[had:]
            inside = [list(map(token, split(p))) for p in fresh]
            self.chars += sum(map(len, fresh)) + sum(map(len, list(self.tokens)[had_tokens:]))
            new = [w.encode("utf-8", "surrogatepass") for w in list(self.tokens)[had_tokens:]]
            if new:
                self.token_ids.append(*merge_all(new, self.table))
            self.piece_ids.append(*self.token_ids.gather(_flat(inside), _sizes(inside)))
        return self.piece_ids.gather(_flat(per_text), _sizes(per_text))


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter((x for part in lists for x in part), np.int64)


def _sizes(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


_held: dict[int, Encoder] = {}


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id_col, ids): the token ids of each row's whole text, without special tokens.

    A null or empty text gives an empty list; marker-like strings are ordinary text; a repeated
    row is encoded again; a null id stays null; other columns are not read.  The vocabulary
    file is read once by the driver and broadcast (its size does not grow with the data).
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        source = spark.sparkContext.broadcast(f.read())
    stamp = hash(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stamp not in _held:
            _held[stamp] = Encoder(source.value)
        encoder = _held[stamp]

        def emit(keys: list, texts: list) -> Iterator[pa.RecordBatch]:
            ids, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            key = pa.concat_arrays(keys)
            step = 2000
            for a in range(0, len(key), step):
                b = min(a + step, len(key))
                lo = int(ends[a - 1]) if a else 0
                offsets = np.concatenate(([lo], ends[a:b])) - lo
                yield pa.RecordBatch.from_arrays([key[a:b], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[lo : int(ends[b - 1])]))], names=[id_col, "ids"])

        keys, texts, size = [], [], 0
        for batch in batches:
            keys.append(batch.column(0))
            new = batch.column(1).to_pylist()
            texts += new
            size += sum(len(t) for t in new if t)
            if size >= RUN_CHARS:
                yield from emit(keys, texts)
                keys, texts, size = [], [], 0
        if keys:
            yield from emit(keys, texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")

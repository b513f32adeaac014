"""Groups and pairs of messages that share most of their text (problem 7).

1. Every text becomes its key form, the form's hash and a minwise blob (one Arrow pass).
2. Texts with one form are a class; its smallest id stands for it, so no group of copies is compared with itself.
3. Each class goes to the shards of its band keys, as (key, class) alone; a class that is by
   itself in a shard goes no further.  Only then are the sketches joined on.
4. Every shard, one of two members too, is a BK-tree of sketches that is searched for each of
   its members, within the scheme's radius.  A shard beyond SHARD members (a hot key) is never
   held whole: its members are numbered in chunks as they stream past, and each pair of chunks
   is searched by another task, one chunk's tree for the other's rows.
5. What the trees report is checked exactly on the key forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, spread, tasks
from . import minhash as mh
from .bktree import Forest
from .textform import key_form

#: members of a shard that one tree holds
SHARD = 4000


def fingerprints(texts: DataFrame, id_col: str = "id", text_col: str = "text", scheme: mh.Scheme = mh.USUAL) -> DataFrame:
    """(id, h, blob) of every row with an id and a key form of LEAST_LETTERS or more; others are no cases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = [key_form(t) for t in b["text"]]
            keep = [i for i, k in enumerate(forms) if len(k) >= mh.LEAST_LETTERS]
            forms = [forms[i] for i in keep]
            yield pd.DataFrame({"id": b["id"].to_numpy()[keep], "h": np.array([mh.text_hash(k) for k in forms], np.int64), "blob": mh.blobs(forms, scheme)})

    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return spread(rows).mapInPandas(run, "id long, h long, blob binary")


def classes(prints: DataFrame) -> DataFrame:
    """(rep, blob), one row for each distinct key form; rep is the smallest id that has it."""
    return prints.groupBy("h").agg(F.min(F.struct("id", "blob")).alias("m")).select(F.col("m.id").alias("rep"), F.col("m.blob").alias("blob"))


def members(prints: DataFrame) -> DataFrame:
    """(id, rep) of every row."""
    reps = prints.groupBy("h").agg(F.min("id").alias("rep"))
    return prints.select("id", "h").distinct().join(reps, "h").select("id", "rep")


def band_keys(found: DataFrame, scheme: mh.Scheme = mh.USUAL, name: str = "rep") -> DataFrame:
    """(key, name): a row for each class and band of (name, blob)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                _, keys = mh.unpack(list(b["blob"]), scheme)
                yield pd.DataFrame({"key": keys.ravel(), name: np.repeat(b[name].to_numpy(), scheme.bands)})

    return found.select(name, "blob").mapInPandas(run, f"key long, {name} long")


def sketches(found: DataFrame, scheme: mh.Scheme = mh.USUAL) -> DataFrame:
    """(rep, s0, s1) of (rep, blob)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                words, _ = mh.unpack(list(b["blob"]), scheme)
                yield pd.DataFrame({"rep": b["rep"], "s0": words[:, 0], "s1": words[:, 1]})

    return found.select("rep", "blob").mapInPandas(run, "rep long, s0 long, s1 long")


def _number(shard: int):
    """Over (key, rep) sorted by key: (key, chunk, rep) of keys with two rows or more, chunks of ``shard`` rows; one row is held back at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen, held = None, 0, None  # the key at hand, its rows before this batch, and its first row while it is the only one
        for b in batches:
            key, rep = b["key"].to_numpy(np.int64), b["rep"].to_numpy(np.int64)
            if not len(key):
                continue
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(begins, len(key)))
            going_on = last is not None and key[0] == last
            nth = np.arange(len(key)) - np.repeat(begins, size)
            if going_on:
                nth[: size[0]] += seen
            keep = np.repeat(size > 1, size)
            if going_on:
                keep[: size[0]] = True
            elif len(begins) == 1:
                keep[:] = True
            single_at_end = size[-1] == 1 and not (going_on and len(begins) == 1)
            if single_at_end:
                keep[-1] = False
            if going_on and held is not None:
                yield pd.DataFrame({"key": [last], "chunk": np.zeros(1, np.int32), "rep": [held]})
            yield pd.DataFrame({"key": key[keep], "chunk": (nth[keep] // shard).astype(np.int32), "rep": rep[keep]})
            seen = (seen if going_on and len(begins) == 1 else 0) + int(size[-1])
            last, held = key[-1], rep[-1] if single_at_end else None

    return run


def _words(b: pd.DataFrame) -> np.ndarray:
    return b[["s0", "s1"]].to_numpy(np.int64).view(np.uint64)


_FOUND = "a long, b long, visits long"


def _found(a: np.ndarray, b: np.ndarray, visits: int) -> pd.DataFrame:
    """Pairs; the visits they took stand in the first row, which has no pair of its own."""
    none = np.array([-1])
    counted = np.zeros(len(a) + 1, np.int64)
    counted[0] = visits
    return pd.DataFrame({"a": np.concatenate((none, a)), "b": np.concatenate((none, b)), "visits": counted})


def _search_shards(radius: int):
    """Over (key, rep, s0, s1) sorted by key, none hot: pairs of each shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b["key"].to_numpy()
            to = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest = b.iloc[to:]
            if to:
                yield from search(b.iloc[:to])
        if rest is not None and len(rest):
            yield from search(rest)

    def search(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rep = b["rep"].to_numpy()
        for x, y, visits in Forest(b["key"].to_numpy(), _words(b)).pairs(radius):
            yield _found(rep[x], rep[y], visits)

    return run


def _search_chunks(radius: int):
    """Over rows sorted by (key, tree, chunk descending): pairs of a hot shard's chunk ``tree`` with itself and with lower chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, forest, reps = None, [], None, None

        def grown() -> Iterator[pd.DataFrame]:
            nonlocal forest, reps
            whole = pd.concat(parts, ignore_index=True)
            reps = whole["rep"].to_numpy()
            forest = Forest(np.zeros(len(whole), np.int64), _words(whole))
            for x, y, visits in forest.pairs(radius):
                yield _found(reps[x], reps[y], visits)

        for batch in batches:
            for which, b in batch.groupby(["key", "tree"], sort=False):
                if which != at:
                    if parts and forest is None:
                        yield from grown()
                    at, parts, forest = which, [], None
                own = b["chunk"].to_numpy() == which[1]
                if own.any():
                    parts.append(b[own])
                others = b[~own]
                if len(others):
                    if forest is None:
                        yield from grown()
                    rep = others["rep"].to_numpy()
                    for x, y, visits in forest.within(_words(others), radius):
                        yield _found(reps[x], rep[y], visits)
        if parts and forest is None:
            yield from grown()

    return run


def shards(found: DataFrame, scheme: mh.Scheme = mh.USUAL, shard: int = SHARD) -> DataFrame:
    """(key, chunk, rep): the classes (rep, blob) of every band key that several have, numbered in chunks of ``shard``."""
    keys = band_keys(found, scheme).repartition(tasks(found.sparkSession), "key").sortWithinPartitions("key")
    return keys.mapInPandas(_number(shard), "key long, chunk int, rep long")


def reported(found: DataFrame, scheme: mh.Scheme = mh.USUAL, shard: int = SHARD) -> DataFrame:
    """(a, b, visits): what the trees report, a pair for each shard both are in; rows of a = -1 count the nodes that were visited."""
    spark = found.sparkSession
    held = cut(shards(found, scheme, shard), "shards")
    rows = held.join(sketches(found, scheme), "rep")
    hot = held.where("chunk > 0")
    if hot.isEmpty():
        return rows.repartition(tasks(spark), "key").sortWithinPartitions("key").select("key", "rep", "s0", "s1").mapInPandas(_search_shards(scheme.radius), _FOUND)
    last = cut(hot.groupBy("key").agg(F.max("chunk").alias("last")), "hot")
    usual = rows.join(last, "key", "left_anti").repartition(tasks(spark), "key").sortWithinPartitions("key").select("key", "rep", "s0", "s1")
    sent = rows.join(last, "key").select("key", "chunk", "rep", "s0", "s1", F.explode(F.sequence("chunk", "last")).alias("tree"))
    sent = sent.repartition(tasks(spark), "key", "tree").sortWithinPartitions("key", "tree", F.desc("chunk"))
    return usual.mapInPandas(_search_shards(scheme.radius), _FOUND).unionByName(sent.mapInPandas(_search_chunks(scheme.radius), _FOUND))


def candidate_links(found: DataFrame, scheme: mh.Scheme = mh.USUAL, shard: int = SHARD) -> DataFrame:
    """Distinct (a, b), a < b: classes that share a band key and whose sketches differ in ``radius`` bits or fewer."""
    pairs = reported(found, scheme, shard).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(links: DataFrame, texts: DataFrame, least: float = mh.SIMILAR, formed: bool = False) -> DataFrame:
    """Those (a, b) of ``links`` whose texts are alike; ``texts`` has (id, text), one text to an id, as key forms if ``formed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = {t: t if formed else key_form(t) for t in {*b["ta"], *b["tb"]}}
            yield b.loc[mh.alike_each([forms[t] for t in b["ta"]], [forms[t] for t in b["tb"]], least), ["a", "b"]]

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return links.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def alike_links(texts: DataFrame, id_col: str = "id", text_col: str = "text", least: float = mh.SIMILAR, scheme: mh.Scheme = mh.USUAL, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives (a, b), and membership (id, rep).

    Null ids, null texts and texts under LEAST_LETTERS letters and digits are no cases; a
    repeated row counts once; further columns are not read; an empty table gives empty results.
    If an id stands on rows with different texts each of its texts is a class of its own.
    ``scheme=minhash.THOROUGH`` misses a pair at the threshold once in 28,000, for about twice the work.
    """
    prints = cut(fingerprints(texts, id_col, text_col, scheme), "prints")
    held = cut(members(prints), "members")
    own = cut(classes(prints), "classes")
    discard(prints)
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return cut(verified(candidate_links(own, scheme, shard), rows, least).distinct(), "links"), held


def alike_pairs(texts: DataFrame, id_col: str = "id", text_col: str = "text", **how) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of alike messages, copies expanded."""
    links, held = alike_links(texts, id_col, text_col, **how)
    left, right = held.select(F.col("id").alias("x"), F.col("rep").alias("a")), held.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.join(left, "a").join(right, "b").select("x", "y")
    inside = left.join(right, F.col("a") == F.col("b")).select("x", "y").where("x < y")
    return across.unionByName(inside).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def alike_groups(texts: DataFrame, id_col: str = "id", text_col: str = "text", **how) -> DataFrame:
    """(id, class_id, links): one row for each case with its class and the number of other classes alike to it."""
    links, held = alike_links(texts, id_col, text_col, **how)
    both = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    n = both.groupBy("rep").agg(F.count("*").alias("links"))
    return held.join(n, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))

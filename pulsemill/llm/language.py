"""Language of every message and of each of its segments, with a confidence (problem 1).

Multinomial naive Bayes over hashed character 1- to 3-grams of words.  The model is fitted on a
bounded sample of labelled rows, each language's share picked by a hash of the id, and refitted
on the words it agrees with, since labels may be wrong and texts mixed.  Its matrix of log
probabilities (BUCKETS x languages, of fixed size) is broadcast; a batch's distinct words are
scored together in numpy; a Viterbi pass over each message's words joins them to segments.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .textform import _INVISIBLE, LOOK_ALIKE

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: labelled rows a language gives to the fit, at most about
SAMPLE = 700
SMOOTH = 0.05
#: cost of changing language between words, inside a clause and where one ends
CHANGE, CHANGE_AT_END = 14.0, 6.0
#: what a language needs to count: letters, or ideographs and kana in Chinese and Japanese
LEAST_LETTERS, LEAST_IDEOGRAPHS = 12, 6
RUNNING_TEXT = 20

# ISO 639-1 codes with their 639-2/3 codes.
CODES = (
    "ar ara, bg bul, bn ben, ca cat, cs ces cze, da dan, de deu ger, el ell gre, en eng, es spa, et est, fa fas per, fi fin, "
    "fr fra fre, he heb, hi hin, hr hrv, hu hun, id ind, it ita, ja jpn, ka kat geo, kk kaz, ko kor, lt lit, lv lav, ms msa may, "
    "nl nld dut, no nor nob, pl pol, pt por, ro ron rum, ru rus, sk slk slo, sl slv, sr srp, sv swe, sw swa, ta tam, te tel, th tha, "
    "tl tgl fil, tr tur, uk ukr, ur urd, uz uzb, vi vie, zh zho chi cmn yue"
)
CODE_OF = {x: line.split()[0] for line in CODES.split(",") for x in line.split()}

# what is looked at in one pass: links, tags, handles and references, which count for nothing, then words and the marks that end a clause
_TOKEN = regex.compile(
    r"https?://\S+|www\.\S+|[$#@]\s?[\w.\-]+|\bref-\S+"
    r"|[\p{Han}\p{Hiragana}\p{Katakana}ー々]+|[\p{Latin}\p{Cyrillic}\p{Greek}\p{Mn}\p{Nd}_]+|\p{Hangul}+|[\p{Arabic}\p{Mn}]+|[\p{Devanagari}]+|[\p{Thai}]+|\p{L}[\p{L}\p{M}]*"
    r"|[.,;:!?…。，、；：！？।؟،؛\n]"
)
_DIGIT = regex.compile(r"\p{N}")
_END = frozenset(".,;:!?…。，、；：！？।؟،؛\n")
_CYRILLIC, _LATIN, _GREEK = regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Latin}"), regex.compile(r"\p{Greek}")
_TO_LATIN = {ord(p[0]): p[1] for p in LOOK_ALIKE.split()}
_TO_CYRILLIC = {ord(p[1]): p[0] for p in LOOK_ALIKE.split() if _CYRILLIC.match(p[0])}
_OWN_CYRILLIC = regex.compile("[" + "".join(c for c in map(chr, range(0x430, 0x450)) if ord(c) not in _TO_LATIN) + "ёъыэ]")
_IDEOGRAPH = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]")
_CLUSTER = regex.compile(r"\X", regex.DOTALL)


class Names:
    """Entity names by how they are found: single words, pairs of words, and stretches of ideographs inside a run of them."""

    def __init__(self, names: list[str]) -> None:
        self.single: set[str] = set()
        self.pairs: set[tuple[str, str]] = set()
        runs: set[str] = set()
        for name in {n.strip().lower() for n in names if n and n.strip()}:
            parts = name.split()
            if len(parts) == 1:
                (runs if _IDEOGRAPH.match(name) else self.single).add(name)
            else:
                self.pairs.update(zip(parts, parts[1:]))
        self.runs = regex.compile("|".join(sorted(map(regex.escape, runs), key=lambda r: (-len(r), r)))) if runs else None


def _one_script(word: str) -> str:
    """A word of mixed alphabets in the one it is meant in."""
    cyr, lat = _CYRILLIC.search(word), _LATIN.search(word)
    if cyr and _OWN_CYRILLIC.search(word):
        return word.translate(_TO_CYRILLIC) if lat else word
    if lat and (cyr or _GREEK.search(word)):
        return word.translate(_TO_LATIN)
    return word


def _origin(text: str, s: str) -> list[tuple[int, int]]:
    """For each character of the normalized text ``s`` the stretch of ``text`` that it comes from."""
    out = []
    for m in _CLUSTER.finditer(text):
        out += [m.span()] * len(unicodedata.normalize("NFKC", _INVISIBLE.sub("", m[0])))
    out += [(len(text), len(text))] * (len(s) - len(out))
    return out


def words(text: str | None, names: Names | None = None, spans: list[tuple[int, int]] | None = None) -> tuple[list[str], list[bool]]:
    """The words of a text's running text, lower case, and whether a clause ends before each; where each stands in the text is added to ``spans`` if given."""
    if not text:
        return [], []
    s = text
    if not s.isascii():
        s = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
        if _LATIN.search(s) and (_CYRILLIC.search(s) or _GREEK.search(s)):
            s = regex.sub(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Mn}]+", lambda m: _one_script(m[0]), s)
    out, ends, end = [], [], False
    single, pairs, runs = (names.single, names.pairs, names.runs) if names is not None else ((), (), None)
    found = _TOKEN.findall(s)
    if spans is not None:
        origin = None if s is text else _origin(text, s)
        places = [m.span() if origin is None else (origin[m.start()][0], origin[m.end() - 1][1]) for m in _TOKEN.finditer(s)]
    for i, w in enumerate(found):
        if w in _END:
            end = True
            continue
        if w.isascii():
            if not w.isalpha() or len(w) > 1 and w.isupper() and (len(w) > 2 or w == "RT"):
                continue  # a number, an address or a symbol in capitals
            w = w.lower()
        else:
            if w[0] in "$#@" or w.startswith(("http", "www.", "ref-")) or _DIGIT.search(w):
                continue
            w = w.lower()
            if runs is not None and _IDEOGRAPH.match(w):
                w = runs.sub("", w)
                if not w:
                    continue
        if w in single:
            continue
        if out and not end and (out[-1], w) in pairs:
            end = ends.pop() or end
            out.pop()
            if spans is not None:
                spans.pop()
            continue
        out.append(w)
        if spans is not None:
            spans.append(places[i])
        ends.append(end)
        end = False
    return out, ends


def _buckets(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and where each word's begin."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in distinct).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2
    n, stops = len(points), np.cumsum(sizes)
    left = np.repeat(stops, sizes) - np.arange(n)  # characters up to the word's end
    h, at, bucket = points * np.uint64(0x9E3779B97F4A7C15), [], []
    for k in range(1, max(ORDERS) + 1):
        if k > 1:
            h = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[k - 1 :] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        if k in ORDERS:
            ok = np.flatnonzero(left[: len(h)] >= k)
            at.append(ok)
            bucket.append(((h[ok] * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)).astype(np.int32))
    at, bucket = np.concatenate(at), np.concatenate(bucket)
    order = np.argsort(at, kind="stable")
    return bucket[order], np.searchsorted(at[order], stops - sizes)


@dataclass
class Model:
    """Log probability of each bucket in each language."""

    langs: list[str]
    table: np.ndarray
    #: what log likelihoods are divided by for a confidence, since the n-grams of a word are not independent; see ``tempered``
    temper: float = 9.0

    def scores(self, distinct: list[str]) -> np.ndarray:
        """Log likelihood of each word, a row per word and a column per language."""
        out = np.empty((len(distinct), len(self.langs)), np.float32)
        for a in range(0, len(distinct), 4000):
            part = distinct[a : a + 4000]
            bucket, starts = _buckets(part)
            out[a : a + len(part)] = np.add.reduceat(self.table[bucket], starts, axis=0)
        return out


def fit(texts: list[tuple[list[str], list[bool]]], labels: list[str], rounds: int = 2) -> Model:
    """The model of (words, ends) with their labels; after the first round only words the model gives the label's language count."""
    langs = sorted(set(labels))
    of = {x: i for i, x in enumerate(langs)}
    number: dict[str, int] = {}
    pairs = np.array([(number.setdefault(w, len(number)), of[lang]) for (ws, _), lang in zip(texts, labels) for w in ws], np.int64).reshape(-1, 2)
    distinct = list(number)
    bucket, starts = _buckets(distinct) if distinct else (np.empty(0, np.int32), np.empty(0, np.int64))
    sizes = np.diff(np.append(starts, len(bucket)))
    model = Model(langs, np.zeros((BUCKETS, len(langs)), np.float32))
    for r in range(rounds + 1):
        if r:
            got, _, _ = segments(model, texts)
            pairs = np.array([(number[w], of[lang]) for (ws, _), lang, g in zip(texts, labels, got) for w, x in zip(ws, g) if langs[x] == lang], np.int64).reshape(-1, 2)
        times = np.zeros((len(distinct), len(langs)))
        np.add.at(times, (pairs[:, 0], pairs[:, 1]), 1)
        counts = np.empty((BUCKETS, len(langs)))
        for k in range(len(langs)):
            counts[:, k] = np.bincount(bucket, np.repeat(times[:, k], sizes), BUCKETS)
        counts += SMOOTH
        model.table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return model


def segments(model: Model, texts: list[tuple[list[str], list[bool]]]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """The language (a number) of each word of each text, by Viterbi over all texts at once; the words as rows of the table of scores, and that table."""
    number: dict[str, int] = {}
    ids = [[number.setdefault(w, len(number)) for w in ws] for ws, _ in texts]
    if not number:
        return ids, ids, np.empty((0, len(model.langs)), np.float32)
    table = model.scores(list(number))
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    order = np.argsort(-n, kind="stable")
    longest = int(n.max())
    alive = np.searchsorted(-n[order], -np.arange(longest), "left")  # texts that have a word at this place
    flat = np.fromiter((x for i in ids for x in i), np.int64)
    stops = np.fromiter((e for _, ends in texts for e in ends), bool)
    at = (np.cumsum(n) - n)[order]
    best = np.zeros((len(ids), len(model.langs)), np.float32)
    back = []
    for t in range(longest):
        m = int(alive[t])
        word = table[flat[at[:m] + t]]
        if not t:
            best[:m] = word
            continue
        cost = np.where(stops[at[:m] + t], CHANGE_AT_END, CHANGE).astype(np.float32)
        top = best[:m].argmax(axis=1)
        change = best[np.arange(m), top] - cost
        stay = best[:m] >= change[:, None]
        back.append((top.astype(np.int8), stay))
        best[:m] = np.where(stay, best[:m], change[:, None]) + word
    state = best.argmax(axis=1)
    path = np.zeros(len(flat), np.int8)
    for t in range(longest - 1, -1, -1):
        m = int(alive[t])
        path[at[:m] + t] = state[:m]
        if t:
            top, stay = back[t - 1]
            state[:m] = np.where(stay[np.arange(m), state[:m]], state[:m], top)
    cuts = np.cumsum(n)[:-1]
    return [p.tolist() for p in np.split(path, cuts)], ids, table


def _confidence(model: Model, total: np.ndarray, x: int) -> float:
    total = total / model.temper
    return float(1.0 / np.exp(np.minimum(total - total[x], 50.0)).sum())


def tempered(model: Model, texts: list[tuple[list[str], list[bool]]], labels: list[str], wrong: float = 0.05) -> float:
    """The temper under which held-out labels are least surprising, when a share ``wrong`` of them is taken to say anything at all."""
    of = {x: i for i, x in enumerate(model.langs)}
    got, rows, table = segments(model, texts)
    known = [(table[r].sum(axis=0), of[lang]) for r, p, lang in zip(rows, got, labels) if lang in of and len(set(p)) == 1]  # in one language
    if not known:
        return model.temper
    totals, true = np.array([t for t, _ in known], np.float64), np.array([x for _, x in known])

    def surprise(temper: float) -> float:
        t = totals / temper
        p = np.exp(t - t.max(axis=1, keepdims=True))
        p = p[np.arange(len(true)), true] / p.sum(axis=1)
        return float(-np.log((1 - wrong) * p + wrong / len(model.langs)).mean())

    return min((1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 9.0, 13.0, 20.0, 30.0), key=surprise)


def _parts(model: Model, ws: list[str], path: list[int], rows: list[int], table: np.ndarray) -> list[tuple[str, float, int]]:
    """(language, confidence, letters) of each segment long enough to count, neighbours of one language joined."""
    out: list[list] = []
    for x, a, b, letters, counts in _stretches(ws, path):
        if counts:
            if out and out[-1][0] == x:
                out[-1][1] += rows[a:b]
                out[-1][2] += letters
            else:
                out.append([x, rows[a:b], letters])
    return [(model.langs[x], _confidence(model, table[part].sum(axis=0), x), letters) for x, part, letters in out]


def _stretches(ws: list[str], path: list[int]) -> Iterator[tuple[int, int, int, int, bool]]:
    """(language, first word, behind the last word, letters, whether it counts) of each stretch of words in one language."""
    a = 0
    while a < len(ws):
        x, b = path[a], a + 1
        while b < len(ws) and path[b] == x:
            b += 1
        letters = sum(map(len, ws[a:b]))
        yield x, a, b, letters, bool(letters >= LEAST_LETTERS or letters >= LEAST_IDEOGRAPHS and _IDEOGRAPH.match(ws[a]))
        a = b


def label_code(label: str | Column) -> Column:
    """ISO 639-1 code of a label, whatever its case, region or length of code; null where it says no known language."""
    raw = F.regexp_extract(F.lower(F.trim(F.regexp_replace(F.col(label) if isinstance(label, str) else label, r"^\s+|\s+$", ""))), r"^([a-z]{2,3})(?:[-_][a-z0-9_-]*)?$", 1)
    known = F.create_map(*[F.lit(x) for kv in CODE_OF.items() for x in kv])
    return F.try_element_at(known, raw)


def _highest(sample: int, n: int) -> int:
    """The 64-bit hash up to which ``sample`` of ``n`` rows are to be expected: the share is exact at any size."""
    return -(2**63) + min(2**64 - 1, sample * 2**64 // n)


def fit_on(messages: DataFrame, labels: DataFrame, names: Names | None, sample: int = SAMPLE, calibrate: bool = False) -> Model:
    """The model of a sample of labelled rows: of each language about ``sample``, the ids of lowest hash, whatever the size of the table.

    To ``calibrate`` its confidences a fifth of the sample is held out of a second fit and judged by it.
    """
    coded = labels.select(F.col("msg_id").alias("id"), label_code("lang").alias("code")).where("code is not null and id is not null")
    n = {r["code"]: r["n"] for r in coded.groupBy("code").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not n:
        return Model(["und"], np.zeros((BUCKETS, 1), np.float32))
    picked = coded.where(F.xxhash64("id") <= F.element_at(F.create_map(*[F.lit(x) for code, k in n.items() for x in (code, _highest(sample, k))]), F.col("code")))
    rows = messages.select("id", "text").join(F.broadcast(picked), "id").where("text is not null").select("id", "text", "code").distinct().collect()  # about SAMPLE rows a language
    rows.sort(key=lambda r: (r["id"], r["code"], r["text"]))
    texts, codes = [words(r["text"], names) for r in rows], [r["code"] for r in rows]
    model = fit(texts, codes)
    if calibrate and len(rows) >= 50:
        part = [i for i in range(len(rows)) if i % 5]
        trial = fit([texts[i] for i in part], [codes[i] for i in part])
        model.temper = tempered(trial, texts[::5], codes[::5])
    return model


def message_languages(messages: DataFrame, model: Model, names: Names | None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(msg_id, segment, lang, confidence, letters, running): the segments of each message in order; ``running`` is its letters of running text.

    A message without a segment that counts (null, empty, short, symbols only) has one row with
    a null segment, language and confidence.  Null ids are left out; repeated rows are repeated.
    """
    spark = messages.sparkSession
    held = spark.sparkContext.broadcast((model, names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, own = held.value
        for b in batches:
            texts = [words(t, own) for t in b["text"]]
            paths, rows_of, scores = segments(m, texts)
            out = []
            for i, (ws, _), p, r in zip(b["id"].tolist(), texts, paths, rows_of):
                running = sum(map(len, ws))
                found = _parts(m, ws, p, r, scores)
                out.extend((i, k, lang, c, n, running) for k, (lang, c, n) in enumerate(found))
                if not found:
                    out.append((i, None, None, None, 0, running))
            f = pd.DataFrame(out, columns=["msg_id", "segment", "lang", "confidence", "letters", "running"])
            f["segment"] = f["segment"].astype("Int32")
            yield f

    rows = messages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return spread(rows).mapInPandas(run, "msg_id long, segment int, lang string, confidence double, letters int, running int")


def message_segments(messages: DataFrame, model: Model, names: Names | None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(msg_id, segment, lang, confidence, letters, counts, start_pos, end_pos): every stretch of a message in one language, short ones too.

    Positions count the text's code points from 0; ``counts`` says whether the stretch is as long as
    a clause.  A message without a word (null, empty, symbols only) has one row of nulls, letters 0.
    Null ids are left out; repeated rows are repeated.
    """
    held = messages.sparkSession.sparkContext.broadcast((model, names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, own = held.value
        for b in batches:
            spans = [[] for _ in b["text"]]
            texts = [words(t, own, at) for t, at in zip(b["text"], spans)]
            paths, rows_of, scores = segments(m, texts)
            out = []
            for i, (ws, _), p, r, at in zip(b["id"].tolist(), texts, paths, rows_of, spans):
                for k, (x, a, z, letters, counts) in enumerate(_stretches(ws, p)):
                    out.append((i, k, m.langs[x], _confidence(m, scores[r[a:z]].sum(axis=0), x), letters, counts, at[a][0], at[z - 1][1]))
                if not ws:
                    out.append((i, None, None, None, 0, None, None, None))
            f = pd.DataFrame(out, columns=["msg_id", "segment", "lang", "confidence", "letters", "counts", "start_pos", "end_pos"])
            yield f.astype({"segment": "Int32", "start_pos": "Int32", "end_pos": "Int32", "counts": "boolean"})

    rows = messages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return spread(rows).mapInPandas(run, "msg_id long, segment int, lang string, confidence double, letters int, counts boolean, start_pos int, end_pos int")


def vocabulary_names(vocab: DataFrame, bound: int = 100_000) -> Names:
    """The dictionary's aliases and names, which must be ``bound`` at most: it is sent to all tasks."""
    rows = vocab.select("alias", "name").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} aliases")
    return Names([x for r in rows for x in (r["alias"], r["name"])])


def wrong_or_mixed(messages: DataFrame, labels: DataFrame, vocab: DataFrame) -> DataFrame:
    """(msg_id, lang): messages of running text whose label is absent, unknown or not their first segment's language, and all in several languages.

    One row for each language of such a message.  Of several labels of a message one that is right is enough.
    """
    names = vocabulary_names(vocab)
    model = fit_on(messages, labels, names)
    found = message_languages(messages, model, names).where((F.col("running") >= RUNNING_TEXT) & F.col("lang").isNotNull())
    said = labels.select("msg_id", label_code("lang").alias("said")).where("said is not null").groupBy("msg_id").agg(F.collect_set("said").alias("said"))
    each = found.groupBy("msg_id").agg(F.collect_set("lang").alias("langs"), F.min_by("lang", "segment").alias("first"))
    joined = each.join(said, "msg_id", "left")
    bad = joined.where((F.size("langs") > 1) | ~F.coalesce(F.array_contains("said", F.col("first")), F.lit(False)))
    return bad.select("msg_id", F.explode("langs").alias("lang"))

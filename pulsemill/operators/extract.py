"""Entities of messages: by pattern and by dictionary, and the rules that keep or drop a message."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from ..session import spread
from .normalize import clean_text

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

# The patterns of symbols, addresses, figures and noise, and the lengths of the rules.
SYMBOL = r"\$([A-Za-z一-鿿][A-Za-z0-9一-鿿]*|\d[\d.]*[BMK]?)"
EVM = r"(?<![a-fA-F0-9])0x[a-fA-F0-9]{40}(?![a-fA-F0-9])"
SOLANA = r"(?<![1-9A-HJ-NP-Za-km-z])[1-9A-HJ-NP-Za-km-z]{32,44}(?![1-9A-HJ-NP-Za-km-z])"
NUMBER = r"\p{Nd}"
PERCENT = "[%％]"
NOISE = (
    "梭就", "梭哈", "亏麻", "抄在山腰", "我是狗", "求带", "跟单", "扛住", "睡不着", "兄弟们觉得", "大家都在干嘛", "行情这么淡", "今天又是.*亏", "什么时候能回本",
    "完了完了", "踏空", "WAGMI", "GM\\s*[☕️]?$", "韭菜的命运", "看来又", "刚刚梭", "这一波.*抄.*山腰",
)
HARD_DROP, SHORT_NOISE, LONG_KEEP, MEDIUM_KEEP = 20, 35, 50, 25
DICTIONARY, PATTERN = 1.0, 0.95
#: names a dictionary may have: it is a literal of every task's plan
MOST_NAMES = 20_000
ENTITIES = ArrayType(StructType().add("name", StringType()).add("entity_type", StringType()).add("confidence", DoubleType()))


@dataclass(frozen=True)
class Vocabulary:
    """The dictionary as held by the driver, in its own order: (alias, name, entity_type)."""

    rows: tuple[tuple[str, str, str], ...]

    @staticmethod
    def of(vocab: DataFrame) -> Vocabulary:
        rows = vocab.select("alias", "name", "entity_type", "ord").limit(MOST_NAMES + 1).collect()
        if len(rows) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} aliases")
        rows.sort(key=lambda r: r["ord"])
        return Vocabulary(tuple((r["alias"].lower(), r["name"], r["entity_type"]) for r in rows))

    def names(self) -> dict[str, tuple[str, list[str]]]:
        """Name to its type and aliases, in order."""
        out: dict[str, tuple[str, list[str]]] = {}
        for alias, name, kind in self.rows:
            out.setdefault(name, (kind, []))[1].append(alias)
        return out

    def latin_pattern(self) -> str | None:
        found = sorted({n for _, n, k in self.rows if k == "ticker" and n.isascii()}, key=lambda n: (-len(n), n))
        return r"(?iu)(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, found)) + r")(?![A-Za-z0-9])" if found else None

    def ideograph_pattern(self) -> str | None:
        found = sorted({a for a, _, k in self.rows if k == "ticker" and re.search("[一-鿿]", a)}, key=lambda a: (-len(a), a))
        return "|".join(map(re.escape, found)) if found else None


def conflicts(vocab: DataFrame) -> DataFrame:
    """(alias, names): aliases that stand for several names."""
    g = vocab.groupBy(F.lower("alias").alias("alias")).agg(F.sort_array(F.collect_set("name")).alias("names"))
    return g.where(F.size("names") > 1)


def name_conflicts(entries: DataFrame, name: str = "name", kind: str = "entity_type") -> DataFrame:
    """(name, kinds): names that stand in the dictionaries of several types."""
    g = entries.where(F.col(name).isNotNull() & F.col(kind).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.sort_array(F.collect_set(kind)).alias("kinds"))
    return g.where(F.size("kinds") > 1)


def symbol_hits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(1))


def reason(text: Column, vocab: Vocabulary) -> Column:
    """Why a text is kept or dropped; the first rule that holds counts. A null text is an empty one."""
    t = clean_text(F.coalesce(text, F.lit("")))
    n = F.length(t)
    latin, ideo = vocab.latin_pattern(), vocab.ideograph_pattern()
    coin = (t.rlike(latin) if latin else F.lit(False)) | (t.rlike(ideo) if ideo else F.lit(False))
    number = t.rlike(NUMBER)
    return (
        F.when(t.rlike(SYMBOL), "A:$symbol")
        .when(coin, "B:coin_dict")
        .when(n < HARD_DROP, "D:length<20")
        .when((n < SHORT_NOISE) & t.rlike("(?iud)" + "|".join(NOISE)), "E:short_noise")
        .when((n >= LONG_KEEP) & number, "C:long+num")
        .when((n >= MEDIUM_KEEP) & number & t.rlike(PERCENT), "F:mid+num+pct")
        .otherwise("default")
    )


def keeps(why: Column) -> Column:
    return F.substring(why, 1, 1).isin("A", "B", "C", "F")


def pattern_entities(text: Column) -> Column:
    """Entities by pattern, in order: symbols in capitals (figures are none), then addresses as written; repeats stay."""
    entity = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("entity_type"), F.lit(PATTERN).alias("confidence"))
    symbols = F.filter(symbol_hits(text), lambda s: ~s.rlike("^[0-9]"))
    return F.concat(
        F.transform(symbols, lambda s: entity(F.upper(s), "ticker")),
        F.transform(F.regexp_extract_all(text, F.lit(EVM), F.lit(0)), lambda s: entity(s, "project")),
        F.transform(F.filter(F.regexp_extract_all(text, F.lit(SOLANA), F.lit(0)), lambda s: ~s.startswith("0x")), lambda s: entity(s, "project")),
    )


class _Finder:
    """A text's entities. The dictionary's by one walk over it with an automaton, or a test for each alias where none is installed."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.names = [{"name": n, "entity_type": k, "confidence": DICTIONARY} for n, (k, _) in vocab.names().items()]
        of = {e["name"]: i for i, e in enumerate(self.names)}
        self.first: dict[str, set[int]] = {}
        for alias, name, _ in vocab.rows:
            if alias:
                self.first.setdefault(alias, set()).add(of[name])
        self.walk = None
        if ahocorasick is not None and self.first:
            self.walk = ahocorasick.Automaton()
            for alias, found in self.first.items():
                self.walk.add_word(alias, found)
            self.walk.make_automaton()

    def dictionary(self, text: str | None) -> list[dict]:
        if not text:
            return []
        low = text.lower()
        hits = (found for _, found in self.walk.iter(low)) if self.walk is not None else (f for a, f in self.first.items() if a in low)
        return [self.names[i] for i in sorted(set().union(*hits))]

    def both(self, text: str | None) -> list[dict]:
        out = {e["name"]: e for e in self.dictionary(text)}
        for name, kind in _by_pattern(text or ""):
            out.setdefault(name, {"name": name, "entity_type": kind, "confidence": PATTERN})
        return list(out.values())


def _by_pattern(text: str) -> list[tuple[str, str]]:
    """(name, type) of the entities by pattern, as ``pattern_entities`` has them."""
    if "$" not in text and len(text) < 32:
        return []
    found = [(s.upper(), "ticker") for s in _SYMBOL.findall(text) if not "0" <= s[0] <= "9"]
    if _LONG.search(text):
        found += [(s, "project") for s in _EVM.findall(text)]
        found += [(s, "project") for s in _SOLANA.findall(text)]
    return found


_SYMBOL, _EVM, _SOLANA, _LONG = re.compile(SYMBOL, re.ASCII), re.compile(EVM), re.compile(SOLANA), re.compile("[0-9A-Za-z]{32}")


def _udf(vocab: Vocabulary, method: str):
    held: list[_Finder] = []

    @F.pandas_udf(ENTITIES)
    def run(values: pd.Series) -> pd.Series:
        if not held:
            held.append(_Finder(vocab))
        find = getattr(held[0], method)
        known = {t: find(t) for t in values.unique()}
        return values.map(known)

    return run


def dictionary_entities(text: Column, vocab: Vocabulary) -> Column:
    """Entities one of whose aliases stands anywhere in the text, whatever the case; each name once, in the dictionary's order."""
    return _udf(vocab, "dictionary")(text)


def entities(text: Column, vocab: Vocabulary) -> Column:
    """Dictionary entities, then those by pattern whose name is not among them; each name once, the first one."""
    return _udf(vocab, "both")(text)


def mention_rows(messages: DataFrame, vocab: Vocabulary, kols: DataFrame | None = None) -> DataFrame:
    """One row for each message and entity, for messages that are no duplicates; null texts give none."""
    text = clean_text("text")
    rows = messages.where("not is_duplicate and text is not null").select("id", "raw_source", "ts", "engagement", "author_weight", F.lower(F.coalesce("author", F.lit(""))).alias("who"), text.alias("text"))
    rows = spread(rows).withColumn("entities", entities(F.col("text"), vocab)).withColumn("e", F.explode("entities"))
    if kols is not None:
        rows = rows.join(kols.select(F.lower("name").alias("who"), F.lit(True).alias("kol")).distinct(), "who", "left")
    else:
        rows = rows.withColumn("kol", F.lit(False))
    return rows.select(
        F.col("id").alias("msg_id"), F.col("e.name").alias("entity"), F.col("e.entity_type").alias("entity_type"), "raw_source", "ts", "engagement", "author_weight",
        F.col("e.confidence").alias("confidence"), F.coalesce("kol", F.lit(False)).alias("is_kol_mention"),
    )


def first_of_name(rows: DataFrame) -> DataFrame:
    """Of rows (msg_id, name, prio, ord) the first of each message and name."""
    order = Window.partitionBy("msg_id", "name").orderBy("prio", "ord")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")

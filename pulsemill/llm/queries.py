"""Queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, incremental, language, leaks, looks, neardup, sentences, together


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.alike_pairs(table(spark, sf_dir, "normalized_messages"))


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.alike_groups(table(spark, sf_dir, "normalized_messages"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.unprocessed_repeats(table(spark, sf_dir, "normalized_messages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.lifted_pairs(table(spark, sf_dir, "entity_mentions"))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = together.scored(together.pair_counts(table(spark, sf_dir, "entity_mentions")))
    return found.select(*(F.col(c) for c in ("item_a", "item_b", "c", "n_a", "n_b", "n")), *(F.round(c, 6).alias(c) for c in ("lift", "pmi", "jaccard")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.look_alike_pairs(table(spark, sf_dir, "normalized_messages"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message's consistent form, and that under full case folding."""
    return looks.with_form(looks.with_form(table(spark, sf_dir, "normalized_messages").select("id", "text")), out_col="folded", fold_case=True)


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.look_alike_classes(table(spark, sf_dir, "normalized_messages"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_or_mixed(table(spark, sf_dir, "normalized_messages"), table(spark, sf_dir, "message_labels"), table(spark, sf_dir, "vocab"))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "normalized_messages")
    names = language.vocabulary_names(table(spark, sf_dir, "vocab"))
    model = language.fit_on(messages, table(spark, sf_dir, "message_labels"), names, calibrate=True)
    return language.message_segments(messages, model, names)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p1_found": p1_found, "p1_segments": p1_segments, "p9_found": p9_found, "p3_found": p3_found, "p3_scores": p3_scores, "p5_found": p5_found, "p5_forms": p5_forms, "p5_classes": p5_classes, "p6_found": p6_found, "p8_ids": p8_ids, "p7_found": p7_found, "p7_classes": p7_classes}
_PAIRS = """
with m as (select distinct msg_id, entity from entity_mentions where msg_id is not null and entity is not null),
e as (select entity, count(*) k from m group by entity), t as (select count(distinct msg_id) n from m),
p as (select x.entity a, y.entity b, count(*) c from m x join m y on x.msg_id = y.msg_id and x.entity < y.entity group by 1, 2)
"""
SQL: dict[str, str] = {
    "p3_found": _PAIRS
    + "select p.a entity_a, p.b entity_b from p join e u on u.entity = p.a join e v on v.entity = p.b, t where p.c >= 5 and p.c::hugeint * t.n >= 8::hugeint * u.k * v.k",
    "p3_scores": _PAIRS
    + """select p.a item_a, p.b item_b, p.c, u.k n_a, v.k n_b, t.n, round(p.c * t.n / (u.k::double * v.k), 6) lift,
round(ln(p.c * t.n / (u.k::double * v.k)), 6) pmi, round(p.c / (u.k + v.k - p.c)::double, 6) jaccard
from p join e u on u.entity = p.a join e v on v.entity = p.b, t""",
}

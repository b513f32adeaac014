"""Texts that look alike but differ in their characters (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .textform import consistent, folded


def _once(values: pd.Series, form) -> pd.Series:
    """``form`` of each value, computed once for each distinct one."""
    known = {v: form(v) for v in values.unique() if v is not None}
    return values.map(known)


def with_form(texts: DataFrame, text_col: str = "text", out_col: str = "form", fold_case: bool = False) -> DataFrame:
    """``texts`` with its consistent form in ``out_col`` (case-folded on request); a null text has a null form.

    All other columns stay, whatever their names; an existing ``out_col`` is replaced.
    """
    form = folded if fold_case else consistent

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return _once(values, form)

    return texts.withColumn(out_col, run(F.col(text_col)))


def _digest(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def _marked(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, kind): hashes of each text's form and of the text as stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            form = _once(b["text"], lambda t: _digest(consistent(t)))
            yield pd.DataFrame({"id": b["id"], "form": form, "kind": b["text"].map(_digest)})

    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return cut(spread(rows).mapInPandas(run, "id long, form binary, kind binary"), "forms")  # read twice


def look_alike_classes(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, class_id, variants): each message's class of one consistent form, by its smallest id, and in how many ways the form is stored.

    Null ids and null texts are no cases; a repeated row counts once; other columns are not read.
    Groups are brought to one row before they meet their messages, and never expanded to pairs.
    """
    marked = _marked(texts, id_col, text_col)
    kinds = marked.groupBy("form", "kind").agg(F.min("id").alias("least"))
    found = kinds.groupBy("form").agg(F.min("least").alias("class_id"), F.count("*").alias("variants"))
    return marked.select("id", "form").distinct().join(found, "form").select("id", "class_id", "variants")


def look_alike_pairs(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: messages with different stored texts of one consistent form.

    Null ids and null texts are no cases; a repeated row counts once; forms that are empty
    (nothing visible) look alike too.  Forms and texts are compared by 128-bit hashes.  Only
    forms stored in two ways or more go on, and pairs are made between stored variants, so
    that a form with very many equal copies makes no pairs of equal texts on the way.
    """
    marked = _marked(texts, id_col, text_col)
    several = marked.groupBy("form").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).where("low <> high").select("form")
    cases = cut(marked.join(several, "form", "left_semi").distinct(), "cases")  # read five times
    kinds = cases.select("form", "kind").distinct()
    ways = kinds.withColumnRenamed("kind", "kind_a").join(kinds.withColumnRenamed("kind", "kind_b"), "form").where("kind_a < kind_b")
    a = cases.select("form", F.col("kind").alias("kind_a"), F.col("id").alias("x"))
    b = cases.select("form", F.col("kind").alias("kind_b"), F.col("id").alias("y"))
    pairs = ways.join(a, ["form", "kind_a"]).join(b, ["form", "kind_b"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

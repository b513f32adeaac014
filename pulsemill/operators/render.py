"""Text of lines and the reading of structured answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normalize import clean_text

# The answer's fields and the values its sentiment may have.
ANSWER = "narrative string, catalyst string, fund_logic string, sentiment string, confidence string"
SENTIMENTS = ("bullish", "bearish", "neutral")
EVIDENCE_CHARS = 300


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to one digit, '-' of nothing."""
    return F.when(whole > 0, F.format_string("%.1f", F.round(part * 100.0 / whole, 1))).otherwise("-")


def bar(part: Column, width: int = 20) -> Column:
    return F.repeat(F.lit("█"), F.round(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * width).cast("int"))


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\_*`\[])", r"\\$1")


# The words of a digest's line and of a hint.
DIGEST_LINE, NO_KIND, NEW_MARK = "%d. `%s` (%s) growth=%.1fx 提及=%d 跨源=%d", "n/a", " ★"
HINT, BETWEEN_HINTS, NO_HINT = "%s（PMI %.2f）", "、", "（暂无）"


def digest_line(rank: Column, entity: Column, kind: Column, growth: Column, n: Column, cross: Column, new: Column) -> Column:
    """One ranked line of a digest."""
    return F.concat(F.format_string(DIGEST_LINE, rank, markdown_escaped(entity), F.coalesce(kind, F.lit(NO_KIND)), growth, n, cross), F.when(new, NEW_MARK).otherwise(""))


def local_time(ts: Column, zone: str, short: bool = False) -> Column:
    """A timestamp (UTC where it names no zone) as hour and minute of a zone, with the day unless ``short``."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "HH:mm" if short else "yyyy-MM-dd HH:mm")


def evidence_line(author: Column, ts: Column, text: Column) -> Column:
    """Author, minute and the first EVIDENCE_CHARS characters of a message: the length is the line's feature."""
    return F.concat(F.lit("["), F.coalesce(author, F.lit("anon")), F.lit(" @ "), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("] "), F.substring(clean_text(text), 1, EVIDENCE_CHARS))


def evidence_block(lines: DataFrame, order: list[Column], line: str = "line") -> DataFrame:
    """One row, ``block``: the lines of a few messages, an empty line between two."""
    k = F.row_number().over(Window.orderBy(*order))  # over the few lines of a prompt
    parts = F.sort_array(F.collect_list(F.struct("k", F.col(line).alias("t"))))
    return lines.withColumn("k", k).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("block"))


def evidence(messages: DataFrame, mentions: DataFrame, entity: str, n: int) -> DataFrame:
    """The ``n`` messages of most engagement that mention the entity; ties by id."""
    hit = mentions.where(F.col("entity") == entity).select(F.col("msg_id").alias("id")).distinct()
    return messages.join(hit, "id", "left_semi").orderBy(F.desc("engagement"), "id").limit(n)


def filled(path: str, **fields: object) -> str:
    """A template file's text with its named fields filled in."""
    with open(path, encoding="utf-8") as f:
        return f.read().format(**fields)


def hint(neighbors: DataFrame, most: int = 3) -> DataFrame:
    """One row, ``hint``: the strongest partners with their scores, or a word for none."""
    order = Window.orderBy(F.desc("pmi"), "other")  # over a handful of rows
    top = neighbors.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("k", F.format_string(HINT, "other", "pmi").alias("t")))), lambda s: s["t"])
    joined = F.array_join(parts, BETWEEN_HINTS)
    return top.agg(F.when(joined == "", NO_HINT).otherwise(joined).alias("hint"))


def parsed_answer(raw: Column) -> Column:
    """A struct of the answer's five fields with ``valid``: fences and a bare sentiment mended, other values than allowed null, blank texts null."""
    t = clean_text(F.coalesce(raw, F.lit("")))
    t = F.regexp_replace(t, r"^```[A-Za-z]*\s*|\s*```$", "")
    quoted = F.regexp_replace(t, r'("sentiment"\s*:\s*)(bullish|bearish|neutral)\b', '$1"$2"')
    tried = F.coalesce(F.try_parse_json(t), F.try_parse_json(quoted))
    obj = F.from_json(F.to_json(tried), ANSWER)
    valid = tried.isNotNull() & F.to_json(tried).startswith("{")
    blank = lambda c: F.nullif(clean_text(c), F.lit(""))
    return F.struct(
        valid.alias("valid"),
        *(F.when(valid, blank(obj[c])).alias(c) for c in ("narrative", "catalyst", "fund_logic")),
        F.when(valid & obj["sentiment"].isin(*SENTIMENTS), obj["sentiment"]).alias("sentiment"),
        F.when(valid, obj["confidence"].try_cast("double")).alias("confidence"),
    )

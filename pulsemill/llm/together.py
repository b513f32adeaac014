"""Items that appear together in a basket, and how much more often than chance (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: items of one block; a basket of up to so many items is one task's work
BLOCK = 64
#: share of all rows from which on an item's rows are not brought together
HOT = 0.001


def pair_counts(rows: DataFrame, basket: str = "msg_id", item: str = "entity", least: int = 1, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, c, n_a, n_b, n): baskets with both items, with either, and baskets at all; item_a < item_b by code point.

    Rows with a null basket or item are no members, though such a basket does not count either;
    an item counts once a basket.  ``least`` leaves out pairs in fewer baskets (and, since a pair
    is in no more baskets than either item, those items before any pair is made).

    Each basket's items are packed into blocks of ``block`` by a hash of the item, so no basket is
    ever one row.  A basket of one block gives its pairs at once.  A larger one gives a row for
    each two of its blocks, and those block products are spread over the tasks.  Each block is
    sent as one array; pairs are counted where they are made before they are shuffled.
    """
    held = rows.select(F.col(basket).alias("b"), F.col(item).alias("i")).where("b is not null and i is not null").distinct()
    n_of = held.groupBy("i").agg(F.count("*").alias("n"))
    total = held.agg(F.count_distinct("b").alias("n"))
    kept = _frequent(held, n_of, least) if least > 1 else held
    # blocks by a hash into as many as the basket's size asks for
    sizes = kept.groupBy("b").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    placed = kept.join(sizes, "b").withColumn("k", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    blocks = placed.groupBy("b", "k").agg(F.sort_array(F.collect_list("i")).alias("items"), F.first("blocks").alias("blocks"))
    inside = blocks.where(F.size("items") > 1).select(
        F.explode(F.expr("flatten(transform(items, (x, p) -> transform(slice(items, p + 2, size(items)), y -> struct(x as a, y as b))))")).alias("p")
    )
    large = blocks.where("blocks > 1")
    sent = large.select("b", "items", F.col("k").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = sent.select("b", "items", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).where("lo < hi")
    one, two = met.where("own = lo").select("b", "lo", "hi", F.col("items").alias("xs")), met.where("own = hi").select("b", "lo", "hi", F.col("items").alias("ys"))
    across = one.join(two, ["b", "lo", "hi"]).select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    across = across.select(F.struct(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).alias("p"))
    counted = inside.unionByName(across).groupBy(F.col("p.a").alias("item_a"), F.col("p.b").alias("item_b")).agg(F.count("*").alias("c")).where(F.col("c") >= least)
    na, nb = n_of.select(F.col("i").alias("item_a"), F.col("n").alias("n_a")), n_of.select(F.col("i").alias("item_b"), F.col("n").alias("n_b"))
    return counted.join(na, "item_a").join(nb, "item_b").withColumn("n", total.scalar()).select("item_a", "item_b", "c", "n_a", "n_b", "n")


def _frequent(held: DataFrame, n_of: DataFrame, least: int) -> DataFrame:
    """Rows of items in ``least`` baskets or more.  Items with a HOT share of all rows or more, of which there can be no more than 1 / HOT, are broadcast, so that none of them is one task's rows; the others meet by item."""
    share = n_of.agg((F.sum("n") * HOT).alias("s"))
    hot = n_of.where((F.col("n") >= least) & (F.col("n") >= share.scalar())).select("i")
    rest = n_of.where((F.col("n") >= least) & (F.col("n") < share.scalar())).select("i")
    return held.join(F.broadcast(hot), "i", "left_semi").unionByName(held.join(F.broadcast(n_of.where(F.col("n") >= share.scalar()).select("i")), "i", "left_anti").join(rest, "i", "left_semi"))


def scored(counts: DataFrame) -> DataFrame:
    """``pair_counts`` with lift (c * n / (n_a * n_b)), pmi (its natural log), npmi and Jaccard."""
    lift = F.col("c") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    p = F.col("c") / F.col("n")
    return counts.withColumns({"lift": lift, "pmi": F.log(lift), "npmi": F.when(p < 1, F.log(lift) / -F.log(p)).otherwise(F.lit(1.0)), "jaccard": F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c"))})


def lifted_pairs(rows: DataFrame, least: int = 5, factor: int = 8, basket: str = "msg_id", item: str = "entity") -> DataFrame:
    """(entity_a, entity_b): pairs in ``least`` baskets or more that come ``factor`` times as often as chance, in whole numbers."""
    found = pair_counts(rows, basket, item, least)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return found.where(wide("c") * wide("n") >= wide("n_a") * wide("n_b") * factor).select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))

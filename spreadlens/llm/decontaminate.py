"""Benchmark decontamination: size-partitioned MinHash containment search, verified on full sets; native functions only.

Short items are sought inside long documents. Items are partitioned by size (powers of two of their shingle counts);
each partition has its own number of hash minima and its own least number that must agree. An item's signature holds, for
each of its partition's hash functions, the shingle with the smallest hash. The share of them that stands in a document
estimates the containment of the item (the minima of the small set against the full large set: minima of a long
document would hardly ever be those of a short item). Pairs with enough agreeing minima are candidates; a pair is a
link if the document has ``percent`` of the item's distinct shingles. An item contained at the threshold fails to
become a candidate with a chance of ``MISS``.

Words are split at white space ``[\\x20\\x09-\\x0D]`` and put in lower case. Items of fewer words than a shingle are not
sought. Null texts have no shingles. Rows that share an id, null ids included, count as one document or item. Empty
tables give an empty result; further columns are left alone.
"""
from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, fresh

MISS = 1e-9
#: Hash functions of a partition: so many at least, and so many more for each doubling of the size.
FUNCTIONS, FUNCTIONS_A_CLASS = 16, 4
CLASSES = 40


def functions_of(size_class: int) -> int:
    return FUNCTIONS + FUNCTIONS_A_CLASS * size_class


def least_agreeing(functions: int, percent: int) -> int:
    """The largest m that a binomial count of agreeing minima falls short of with a chance of at most MISS."""
    p, m, below = percent / 100, 0, 0.0
    while below <= MISS and m < functions:
        below += comb(functions, m) * p**m * (1 - p)**(functions - m)
        m += 1
    return max(1, m - 1)


def _exploded(table: DataFrame, id_col: str, text_col: str, name: str, size: int) -> DataFrame:
    own = table.select(F.col(id_col).alias(name), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashed = F.transform(F.filter(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    own = own.select(name, hashed.alias("h"))
    places = F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size)).otherwise(F.array().cast("array<int>"))
    return own.select(name, F.explode(F.transform(places, lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(size)]))).alias("g"))


def signatures(items: DataFrame, percent: int) -> DataFrame:
    """(g, item, weight, need): the shingles of every item's signature, how many minima each is, how many must agree."""
    sizes = items.groupBy("item").agg(F.count("*").alias("n"))
    need = F.array(*[F.lit(least_agreeing(functions_of(c), percent)) for c in range(CLASSES)])
    sizes = sizes.withColumn("class", F.floor(F.log2("n")).cast("int")).select(
        F.col("item").alias("own"), (F.lit(FUNCTIONS) + FUNCTIONS_A_CLASS * F.col("class")).alias("functions"), F.get(need, F.col("class")).alias("need"))
    drawn = items.join(sizes, F.col("item").eqNullSafe(F.col("own"))).select(
        "item", "g", "need", F.explode(F.sequence(F.lit(1), F.col("functions"))).alias("j"))
    least = drawn.groupBy("item", "need", "j").agg(F.min_by("g", F.xxhash64("g", "j")).alias("g"))
    return least.groupBy("g", "item", "need").agg(F.count("*").alias("weight"))


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, n_item, n_found): every document that has ``percent`` of an item's shingles."""
    short = checkpointed(_exploded(items, item_col, item_text, "item", size).distinct())
    signature = checkpointed(signatures(short, percent))
    long = _exploded(docs, id_col, text_col, "doc", size)
    agreed = long.join(signature, "g").groupBy("doc", "item", "need", "g").agg(F.max("weight").alias("weight"))
    agreed = agreed.groupBy("doc", "item", "need").agg(F.sum("weight").alias("agreeing")).filter("agreeing >= need")
    pairs = checkpointed(agreed.select("doc", "item"))

    suspects = pairs.select(F.col("doc").alias("of")).distinct()
    whole = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    texts = whole.join(suspects.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("of")), "left_semi")
    sought = pairs.join(short.withColumnRenamed("item", "own"), F.col("item").eqNullSafe(F.col("own"))).select(F.col("doc").alias("of"), "item", F.col("g").alias("want"))
    there = _exploded(texts, "doc", "text", "doc", size)
    found = there.join(sought, F.col("of").eqNullSafe(F.col("doc")) & (F.col("want") == F.col("g"))).select("doc", "item", "g").distinct()
    found = found.groupBy("doc", "item").agg(F.count("*").alias("n_found"))
    sizes = short.groupBy(F.col("item").alias("own")).agg(F.count("*").alias("n_item"))
    return found.join(sizes, F.col("item").eqNullSafe(F.col("own"))).filter(F.col("n_found") * 100 >= F.col("n_item") * percent).select("doc", "item", "n_item", "n_found")


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    name = fresh(docs.columns, "_gone")
    gone = contained_items(docs, items, size, percent, id_col, text_col).select(F.col("doc").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")

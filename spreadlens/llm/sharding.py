"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows belong to parts by a hash. The sizes of the parts, one number each, come to the driver, and a matrix (part,
   shard) -> rows is drawn from the multivariate hypergeometric distribution: exactly what a uniform permutation of all
   rows would send from each part to each shard. Shard sizes differ by one at most.
2. Permute locally: the rows of a part are put in random order, and the matrix row cuts that order into shards.
3. Exchange and permute again: inside a shard rows are ordered by a second random key; the shard is dealt into ranges
   of that key whose sizes are added up first, so no task holds a whole shard.

Random keys are hashes of the row's own columns and a seed: a task that runs again gives the same result. Rows with
equal columns are interchangeable. Everything is native DataFrame work; only part sizes reach the driver.

Null texts count as empty, null ids as any other id. An empty table gives an empty result; further columns are carried
along, whatever their names; an input column called ``shard`` or ``slot`` gives way to the result's.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from .common import fresh, shares

ROWS_A_PART = 500_000
LEAST_PARTS = 64


def communication_matrix(sizes: list[int], shards: int, seed: int) -> tuple[list[int], np.ndarray]:
    """Shard sizes, at most one apart, and the rows that each part sends to each shard."""
    total = sum(sizes)
    rng = np.random.Generator(np.random.PCG64(seed))
    targets = np.full(shards, total // shards, dtype=np.int64)
    targets[rng.permutation(shards)[:total % shards]] += 1
    left, rows = targets.copy(), np.zeros((len(sizes), shards), dtype=np.int64)
    for i, n in enumerate(sizes):
        rows[i] = _draw(rng, left, n)
        left -= rows[i]
    return targets.tolist(), rows


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric draw of n from the colours ``left``, one colour after another."""
    out, rest = np.zeros(len(left), dtype=np.int64), int(left.sum())
    for s, k in enumerate(left):
        k = int(k)
        if n and k:
            out[s] = n if rest == k else _hypergeometric(rng, k, rest - k, n)
            n -= int(out[s])
        rest -= k
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn are good: numpy's draw, beyond the populations of 10^9 that it takes the one below."""
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    return _inverted(rng.random(), good, bad, n)


def _inverted(u: float, good: int, bad: int, n: int) -> int:
    """The hypergeometric distribution function inverted at u, for populations of any size.

    Probabilities follow from the mode by the ratios of neighbours, p(k + 1) / p(k) = (good - k)(n - k) / ((k + 1)(bad - n + k + 1)).
    They are added up over twelve standard deviations and 60 to each side, beyond which less than 1e-27 is left: below what
    a random double can tell. That are about 6 sqrt(n) values each way, a few thousand for a part of 500,000 rows.
    """
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 60 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    low, high = max(0, n - bad, mode - reach), min(good, n, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, u * sums[-1], side="right").clip(0, high - low))


def _random(seed: int, columns: list[str]):
    """A random key by row: a hash of its columns and the seed."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], F.lit(seed ^ 0x5DEECE66))


def shard_rows(rows: DataFrame, shards: int, seed: int = 11, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``keys``: the columns that random keys are hashed from, all by default; rows that agree in them are interchangeable.
    """
    spark, keys = rows.sparkSession, keys or rows.columns
    prefix = fresh(rows.columns, "_sh_")
    name = lambda c: f"{prefix}{c}"
    parts = max(LEAST_PARTS, -(-rows.count() // ROWS_A_PART))
    own = rows.withColumns({name("part"): F.pmod(_random(seed, keys), F.lit(parts)).cast("int"), name("one"): _random(seed + 1, keys), name("two"): _random(seed + 2, keys)})
    found = {r[name("part")]: r["n"] for r in own.groupBy(name("part")).agg(F.count("*").alias("n")).collect()}
    sizes = [found.get(i, 0) for i in range(parts)]
    targets, matrix = communication_matrix(sizes, shards, seed)
    schema = T.StructType([T.StructField(name("part"), T.IntegerType(), False), T.StructField(name("ends"), T.ArrayType(T.LongType(), False), False)])
    ends = spark.createDataFrame([(i, np.cumsum(m).tolist()) for i, m in enumerate(matrix)], schema)

    local = W.partitionBy(name("part")).orderBy(name("one"), *keys)
    dealt = own.withColumn(name("rank"), F.row_number().over(local) - 1).join(ends, name("part"))
    dealt = dealt.withColumn(name("shard"), F.size(F.filter(name("ends"), lambda e: e <= F.col(name("rank")))).cast("int"))

    ranges = shares(spark, max(targets, default=0), ROWS_A_PART)
    dealt = dealt.withColumn(name("range"), F.floor((F.shiftrightunsigned(name("two"), 32) * ranges) / F.lit(2.0**32)).cast("int"))
    counts = dealt.groupBy(name("shard"), name("range")).agg(F.count("*").alias("n"))
    before = counts.withColumn(name("before"), F.sum("n").over(W.partitionBy(name("shard")).orderBy(name("range")).rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(name("shard"), name("range"), F.coalesce(name("before"), F.lit(0)).alias(name("before")))
    again = W.partitionBy(name("shard"), name("range")).orderBy(name("two"), *keys)
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    out = dealt.withColumn(name("at"), F.row_number().over(again) - 1).join(before, [name("shard"), name("range")])
    return out.withColumn(name("slot"), (F.col(name("before")) + F.col(name("at"))).cast("bigint")).select(*kept, F.col(name("shard")).alias("shard"), F.col(name("slot")).alias("slot"))

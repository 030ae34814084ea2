"""Near-duplicate documents by MinHash.

1. Per text: distinct word shingles, ``BANDS * ROWS`` universal hash minima, one key per band.
2. Texts of equal words are one class; only its smallest id goes on.
3. A bucket is a band key shared by two classes or more. It is compared with its smallest member first, never all
   against all. Members that end in one component need no more comparing. While a bucket holds several components, those
   outside its largest are compared with all others; where that is too much work for the round, some members of the largest
   component first. Either is done in tiles, a block of members against another, so no task gets a bucket whole; no
   bucket is capped and no pair that shares a bucket is lost.
4. A pair goes on if its sizes and its signatures allow the similarity, and is a link if its full shingle sets do.
5. Components by alternating large-star and small-star.

A pair at a Jaccard of 0.8 shares no band with a chance of (1 - 0.8^5)^40 = 1e-7. Null and empty texts and texts without
words have no shingles and are linked with nothing. Rows that share an id count as one document. Rows with a null id
take part in no link: their component is null and they are kept. Texts are never cut: all their shingles count. Equal
texts are linked with the smallest of their ids. An empty table gives an empty result; further columns are left alone.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, fresh
from .components import connected_components
from .text_arrays import U, each_text, mix, shingles_of

BANDS, ROWS = 40, 5
_rng = np.random.Generator(np.random.PCG64(77))
MUL = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
#: A pair is dropped unverified if fewer minima agree than at this many standard deviations below the threshold.
SIGMAS = 5
#: Rows of a side of a tile. Sets of more shingles than LONG are not sent to tiles: their pairs go by signature to the exact comparison.
TILE, LONG = 1024, 4096
#: Comparisons that a bucket may take in the first round of tiles; each round takes 64 times as many.
WORK = 2**26


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(MUL), 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        h = np.multiply.outer(MUL, shingles[i:i + 2048])
        h += ADD[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    parts = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = key * U(0x9E3779B97F4A7C15) + parts[:, j]
    return mix(key).view(np.int64)


def signature(low: np.ndarray) -> np.ndarray:
    """A byte of each minimum; mixed, as the smallest of many crowd at zero."""
    return (mix(low) >> U(56)).astype(np.uint8).view(np.int8)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, bands, sig = [], [], [], []
            for _, words in each_text(b):
                s = shingles_of(words, size)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(words.tobytes()) if len(s) else None)
                low = minima(s) if len(s) else None
                bands.append(band_keys(low) if len(s) else None)
                sig.append(signature(low) if len(s) else None)
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "n": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64())), "sig": pa.array(sig, pa.list_(pa.int8()))})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles_of(words, size).view(np.int64) for _, words in each_text(b)]
            yield pa.RecordBatch.from_pydict({"node": b.column("id"), "items": pa.array(sets, pa.list_(pa.int64()))})

    return run


def _first_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of each bucket's smallest member with the others, if their sizes allow the similarity."""
    both = live.filter("node <> first.node").filter(F.least("n", "first.n") * 100 >= F.greatest("n", "first.n") * percent)
    return both.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()


def _least_agreeing(percent: int) -> int:
    k, s = BANDS * ROWS, percent / 100
    return int(k * s - SIGMAS * (k * s * (1 - s)) ** 0.5)


def _agree(x: str, y: str, percent: int) -> Column:
    """Whether enough minima of two signatures agree."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same)) >= _least_agreeing(percent)


def _short(key: Column) -> Column:
    """31 bits of a band key, enough to tell whether two texts share a band."""
    return key.bitwiseAND(2**31 - 1).cast("int")


def _merged(n: Column) -> Column:
    """How many values of a set of n the cut to 31 bits may merge, but for a chance of about 1e-9. Poisson, of mean n^2 / 2^32:
    up to 2,000 values three merges are rarer than that, beyond it the bound is the mean, seven deviations and twelve."""
    mean = n.cast("double") * n / 2.0**32
    return F.when(n <= 2000, 2.0).otherwise(F.ceil(mean + 7 * F.sqrt(mean) + 12))


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile, from batches that are sorted by tile."""
    held, at = [], None
    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in ("bucket", "p", "x")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and tuple(keys[i]) != at:
                yield pa.Table.from_batches(held)
                held = []
            at = tuple(keys[i])
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and where each row's begin (n + 1 numbers); nulls are empty."""
    column = table.column(name).combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _tile(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile's pivots with its members of other components."""
    get = lambda c: table.column(c).to_numpy()
    node, n, component, chosen, slack = (get(c) for c in ("node", "n", "component", "chosen", "slack"))
    pivots, others = np.flatnonzero(get("pivot")), np.flatnonzero(~get("pivot"))
    bands, sig = (_lists(table, c)[0].reshape(len(node), -1) for c in ("bands", "sig"))
    items, at = _lists(table, "items")
    kinds, items = np.unique(items, return_inverse=True)
    length, in_pivot = np.diff(at), np.zeros(len(kinds), dtype=bool)
    bucket, enough, a, b = int(table.column("bucket")[0].as_py()) & (2**31 - 1), _least_agreeing(percent), [], []
    by_place = np.ascontiguousarray(sig[others].T)
    for i in pivots:
        like = (by_place == sig[i][:, None]).sum(axis=0, dtype=np.uint16) >= enough
        like &= (component[others] != component[i]) & (~chosen[others] | (node[others] > node[i]))
        like &= np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * percent
        x = others[like]
        same = bands[x] == bands[i]
        x = x[same.any(axis=1) & (bands[i][same.argmax(axis=1)] == bucket)]
        if len(x) and length[i]:
            own = items[at[i]:at[i + 1]]
            in_pivot[own] = True
            row = np.repeat(np.arange(len(x)), length[x])
            place = np.arange(len(row)) + np.repeat(at[x] - np.cumsum(length[x]) + length[x], length[x])
            shared = np.bincount(row[in_pivot[items[place]]], minlength=len(x))
            in_pivot[own] = False
            x = x[(length[x] == 0) | ((shared + np.minimum(slack[x], slack[i])) * (100 + percent) >= (n[x] + n[i]) * percent)]
        a.append(np.minimum(node[x], node[i]))
        b.append(np.maximum(node[x], node[i]))
    return np.concatenate([node[:0], *a]), np.concatenate([node[:0], *b])


def _tiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tiles(batches):
            a, b = _tile(table, percent)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return run


def _later_pairs(live: DataFrame, pivots: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Pairs of pivots with members of other components, two pivots once. A pair is made in one of the buckets that it shares,
    that of the first band, and only if its signatures allow the similarity and its shingles, cut to 31 bits, agree but for those that the cut may have merged.

    Pivots and members of a bucket are dealt into blocks by hash; each block of pivots meets each block of members in a tile."""
    blocks = lambda count: F.ceil(count / TILE).cast("int")
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    rows = live.select("bucket", "node", "n", "component").join(pivots.select("bucket", "node", F.lit(True).alias("chosen")), ["bucket", "node"], "left")
    rows = rows.withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    counts = rows.groupBy("bucket").agg(blocks(F.count_if("chosen")).alias("ps"), blocks(F.count("*")).alias("xs")).filter("ps > 0")
    rows = rows.join(counts, "bucket")
    members = rows.withColumns({"pivot": F.lit(False), "x": own("xs")}).withColumn("p", each("ps"))
    chosen = rows.filter("chosen").withColumns({"pivot": F.lit(True), "p": own("ps")}).withColumn("x", each("xs"))
    dealt = members.unionByName(chosen).drop("ps", "xs").join(traits.withColumn("items", F.when(F.size("items") <= LONG, F.col("items"))), "node")
    dealt = dealt.withColumn("slack", _merged(F.col("n")).cast("double")).repartition("bucket", "p", "x").sortWithinPartitions("bucket", "p", "x")
    return dealt.mapInArrow(_tiles(percent), "a bigint, b bigint")


def _side(table: DataFrame, column: str, key: str) -> DataFrame:
    return table.select(F.col("node").alias(key), F.col(column).alias(f"{column}_{key}"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    full = pairs.join(_side(sets, "items", "a"), "a").join(_side(sets, "items", "b"), "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return full.filter(shared * 100 >= (F.size("items_a") + F.size("items_b") - shared) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest linked id, itself included), kept."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(own.mapInArrow(_signatures(size), "id bigint, n bigint, cls binary, bands array<bigint>, sig array<tinyint>"))
    known = rows.filter("cls is not null and id is not null")
    classes = checkpointed(known.groupBy("cls").agg(F.min("id").alias("node")))
    heads = known.join(classes, "cls").filter("id = node").dropDuplicates(["cls"])
    banded = heads.select("node", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct("node", "n")).alias("first")).filter("m > 1")
    live = checkpointed(banded.join(shared, "bucket").select("bucket", "node", "n", "first"))
    members = checkpointed(live.select("node").distinct())
    traits = checkpointed(heads.join(members, "node", "left_semi").select(
        "node", F.transform("bands", _short).alias("bands"), "sig"))
    sets = checkpointed(own.join(members.hint("shuffle_hash"), F.col("id") == F.col("node"), "left_semi").mapInArrow(
        _sets(size), "node bigint, items array<bigint>").dropDuplicates(["node", "items"]))

    first = _first_pairs(live, percent).join(_side(traits, "sig", "a"), "a").join(_side(traits, "sig", "b"), "b").filter(_agree("sig_a", "sig_b", percent))
    links = checkpointed(_verified(first.select("a", "b"), sets, percent))
    labels = connected_components(links)
    live, work, short = live.filter("node <> first.node").select("bucket", "node", "n"), WORK, None
    while True:
        rest = live.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = rest.groupBy("bucket", "component").agg(F.count("*").alias("m")).groupBy("bucket").agg(
            F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
        rest = checkpointed(rest.join(sizes, "bucket").select("bucket", "node", "n", "component", "m", "main"))
        if rest.isEmpty():
            break
        if short is None:
            short = checkpointed(traits.join(sets, "node").join(rest.select("node").distinct(), "node", "left_semi").select(
                "node", "bands", "sig", F.transform("items", _short).alias("items")))
        # a bucket ends once what is outside its largest component has met all; where that is too much, members of the largest are
        # taken first, as those that they link need no more comparing
        ends = F.col("m") * (F.col("m") - F.col("main.m")) <= work
        some = (F.col("component") == F.col("main.component")) & (F.pmod(F.xxhash64("node"), F.col("main.m")) < TILE)
        pivot = F.when(ends, F.col("component") != F.col("main.component")).otherwise(some)
        found = checkpointed(_verified(_later_pairs(rest, rest.filter(pivot), short, percent), sets, percent).union(labels.select("node", "component")))
        labels = connected_components(found)
        live, work = rest.filter(~ends & ~some).select("bucket", "node", "n"), work * 64

    named = rows.select("id", "n", "cls").join(classes, "cls", "left").join(labels, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return named.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns."""
    name = fresh(docs.columns, "_gone")
    gone = near_duplicates(docs, size, percent, id_col, text_col).filter("not kept").select(F.col("id").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col(id_col) == F.col(name), "left_anti")

"""Phrase collocations by counting quotient filters.

1. Blocks. A task gathers the words of its texts, by language, into blocks of about ``BLOCK_TOKENS`` words: the block's
   distinct words with their counts, and the text as numbers into that list (0 where a piece ends). Blocks are stored once.
2. Dictionary. The counts of all blocks add up by (language, word). Only words that are frequent enough can be part of a
   candidate; they get dense numbers, and each block learns the numbers of its own words by a join, never the dictionary.
3. Filters. A block's n-grams of numbered words are packed, permuted and counted in quotient filters, one for each range
   of the permuted keys. The owner of a range merges the sorted filters of all blocks as they stream in and keeps the
   keys that are frequent enough: the candidates with their exact counts. A phrase that stands everywhere has one entry a
   block, wherever it stands.
4. Scores are joins among candidates and words, exact in decimals of 38 digits; phrases inside longer ones are dropped,
   and the first ``top`` of each language are ranked.

Null texts count as empty, a null language as ``und``; repeated rows count as often as they stand there. Ties of score and
count are ranked by the phrase's bytes. Texts are never cut; a piece longer than a block makes a longer block. An empty
table gives an empty result, and columns with clashing names are left alone.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import quotient_filter as qf
from .common import checkpointed, shares

BLOCK_TOKENS = 1_000_000
#: N-grams an owner counts, at most about; filters it holds before it merges them.
OWNER_GRAMS, HELD_KEYS = 4_000_000, 1_000_000
#: Words of a dictionary part that is numbered by one task.
PART_WORDS = 500_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
c = F.col

BLOCK = "block string, lang string, tokens bigint, words array<string>, counts array<bigint>, sequence binary"


class Words(dict):
    """word -> its number in the block, from 1."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class BlockBuilder:
    def __init__(self):
        self.words, self.parts, self.size = Words(), [], 0

    def add(self, text: str) -> None:
        out: list[int] = []
        number = self.words.__getitem__
        for piece in text.encode().translate(_LOWER).split(b"\n"):
            words = piece.split(b" ")
            if len(words) > 1 or words[0]:
                out.extend([number(w) for w in words if w])
                out.append(0)
        self.parts.append(np.array(out, dtype=np.uint32))
        self.size += len(out)

    def row(self, name: str, lang: str) -> pa.RecordBatch:
        sequence = np.concatenate(self.parts) if self.parts else np.zeros(0, dtype=np.uint32)
        counts = np.bincount(sequence, minlength=len(self.words) + 1)[1:]
        kinds = {"block": pa.string(), "lang": pa.string(), "tokens": pa.int64(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "sequence": pa.binary()}
        row = {"block": name, "lang": lang, "tokens": int(counts.sum()), "words": [w.decode() for w in self.words], "counts": counts, "sequence": _stored(sequence)}
        return pa.RecordBatch.from_pydict({n: pa.array([row[n]], k) for n, k in kinds.items()})


def _stored(sequence: np.ndarray) -> bytes:
    """Low and high bytes apart, then compressed."""
    planes = np.ascontiguousarray(sequence.view(np.uint8).reshape(-1, 4).T)
    return len(sequence).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(planes.tobytes(), asbytes=True)


def _loaded(code: bytes) -> np.ndarray:
    n = int.from_bytes(code[:8], "little")
    planes = pa.Codec("zstd").decompress(code[8:], decompressed_size=4 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, n).T).view(np.uint32)[:, 0] if n else np.zeros(0, dtype=np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, k = TaskContext.get().partitionId(), 0
    open_: dict[str, BlockBuilder] = {}
    held = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            block = open_.setdefault(lang, BlockBuilder())
            held -= block.size
            block.add(text.as_py() or "")
            held += block.size
            if held >= BLOCK_TOKENS:  # the largest goes, whichever language is added to
                lang = max(open_, key=lambda n: open_[n].size)
                block = open_.pop(lang)
                held -= block.size
                yield block.row(f"{task}-{k}", lang)
                k += 1
    for lang, block in open_.items():
        if block.size:
            yield block.row(f"{task}-{k}", lang)
            k += 1


def grams(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of 2 to ``longest`` (3 at most) neighbouring numbered words."""
    x, y = ids[:-1], ids[1:]
    two = (x > 0) & (y > 0)
    three = two[:-1] & (ids[2:] > 0) if longest > 2 else np.zeros(max(0, len(ids) - 2), dtype=bool)
    i, j = np.flatnonzero(two), np.flatnonzero(three)
    return np.concatenate([ids[i], ids[j]]), np.concatenate([ids[i + 1], ids[j + 1]]), np.concatenate([np.zeros(len(i), dtype=ids.dtype), ids[j + 2]])


FILTER = "owner int, filter binary"


def _filters(bits: int, owners: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = qf.Permutation(bits)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                sequence = _loaded(row.column("sequence")[0].as_py())
                known = row.column("known")[0].values
                numbers = np.zeros(int(sequence.max(initial=0)) + 1, dtype=np.uint64)
                numbers[known.field("local").to_numpy(zero_copy_only=False)] = known.field("number").to_numpy(zero_copy_only=False).astype(np.uint64)
                ids = numbers[sequence]
                top, rest = key.forward(*grams(ids, longest))
                top, rest, count = qf.in_order(top, rest, None, key.rest_bits)
                cut = np.searchsorted(qf.owners_of(top, key.top_bits, owners), np.arange(owners + 1, dtype=np.uint64))
                has = np.flatnonzero(np.diff(cut))
                codes = [qf.encode(top[cut[o]:cut[o + 1]], rest[cut[o]:cut[o + 1]], count[cut[o]:cut[o + 1]], key.rest_bits) for o in has]
                yield pa.RecordBatch.from_pydict({"owner": pa.array(has, pa.int32()), "filter": pa.array(codes, pa.binary())})

    return run


class Merge:
    """One owner's filter, grown by the filters that stream in."""

    def __init__(self, rest_bits: int):
        self.rest_bits, self.held, self.size = rest_bits, [], 0
        self.now = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def add(self, code: bytes) -> None:
        self.held.append(qf.decode(code, self.rest_bits))
        self.size += len(self.held[-1][0])
        if self.size >= max(HELD_KEYS, len(self.now[0])):
            self.merge()

    def merge(self):
        if self.held:
            self.now = qf.in_order(*(np.concatenate(x) for x in zip(self.now, *self.held)), self.rest_bits)
            self.held, self.size = [], 0
        return self.now


def _owned(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = qf.Permutation(bits)
        owner, merge = None, None

        def frequent() -> pa.RecordBatch:
            top, rest, count = merge.merge()
            keep = count >= least
            x, y, z = key.backward(top[keep], rest[keep])
            return pa.RecordBatch.from_pydict({n: pa.array(v.astype(np.int64)) for n, v in (("x", x), ("y", y), ("z", z), ("a", count[keep]))})

        for b in batches:
            for o, code in zip(b.column("owner").to_pylist(), b.column("filter")):
                if o != owner:
                    if merge is not None:
                        yield frequent()
                    owner, merge = o, Merge(key.rest_bits)
                merge.add(code.as_py())
        if merge is not None:
            yield frequent()

    return run


def dictionary(entries: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, number from 1, f) of all frequent words, and (lang, n) with the number of all words."""
    spark = entries.sparkSession
    total = checkpointed(entries.groupBy("lang", "word").agg(F.sum("count").alias("f")))
    all_words = total.groupBy("lang").agg(F.sum("f").alias("n"))
    kept = total.where(c("f") >= least)
    parts = shares(spark, kept.count(), PART_WORDS)
    kept = kept.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)))
    # one row a part, so the sizes of the parts before are a small window
    before = kept.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = before.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    numbered = kept.withColumn("inside", inside).join(before, "part").select("lang", "word", (c("inside") + c("before")).alias("number"), "f")
    return checkpointed(numbered), all_words


def candidates(docs: DataFrame, least: int = 10, longest: int = 3, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """((x, y, z, a) of every phrase of 2 to ``longest`` words, as numbers, that stands ``least`` times or more; dictionary; (lang, n))."""
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words at most")
    spark = docs.sparkSession
    own = docs.select(F.coalesce(c(lang_col).cast("string"), F.lit("und")).alias("lang"), c(text_col).cast("string").alias("text"))
    blocks = checkpointed(own.mapInArrow(_blocks, BLOCK))
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    entries = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "e")).select(
        "block", "lang", (c("local") + 1).alias("local"), c("e.words").alias("word"), c("e.counts").alias("count"))
    words, all_words = dictionary(entries.select("lang", "word", "count"), least)
    largest = words.agg(F.max("number")).first()[0] or 1
    bits, owners = int(largest).bit_length(), min(1 << 24, shares(spark, 2 * tokens, OWNER_GRAMS))
    known = entries.join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct(c("local").cast("bigint").alias("local"), c("number").cast("bigint").alias("number"))).alias("known"))
    filters = blocks.select("block", "sequence").join(known, "block").mapInArrow(_filters(bits, owners, longest), FILTER)
    merged = filters.repartition(owners, "owner").sortWithinPartitions("owner")
    return checkpointed(merged.mapInArrow(_owned(bits, least), "x bigint, y bigint, z bigint, a bigint")), words, all_words


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact up to products of 38 digits."""
    big = lambda x: x.cast("decimal(19,0)")
    wide = lambda x: x.cast("decimal(38,0)")
    over, under = wide(F.lit(1_000_000).cast("decimal(7,0)") * wide(big(a) * big(a))), wide(big(left) * big(right))
    # the quotient of decimals is rounded to their scale; the remainder is exact
    return ((over - over % under) / under).cast("bigint")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, inside_percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    grams_, words, all_words = candidates(docs, least, longest, text_col, lang_col)
    two, three = grams_.where("z = 0").drop("z"), grams_.where("z > 0")
    f = words.select("number", "f")
    of = lambda name, out: f.select(c("number").alias(name), c("f").alias(out))
    cuts2 = two.join(of("x", "l"), "x").join(of("y", "r"), "y").withColumn("z", F.lit(0).cast("bigint")).withColumn("score", cut_score(c("a"), c("l"), c("r")))
    head, tail = two.select("x", "y", c("a").alias("f_xy")), two.select(c("x").alias("y"), c("y").alias("z"), c("a").alias("f_yz"))
    cuts3 = three.join(head, ["x", "y"]).join(tail, ["y", "z"]).join(of("x", "f_x"), "x").join(of("z", "f_z"), "z")
    cut = lambda k, l, r: F.struct(cut_score(c("a"), c(l), c(r)).alias("score"), F.lit(k).alias("k"), c(l).alias("l"), c(r).alias("r"))
    cuts3 = cuts3.withColumn("cut", F.least(cut(1, "f_x", "f_yz"), cut(2, "f_xy", "f_z"))).select("x", "y", "z", "a", "cut.l", "cut.r", "cut.score")
    inner = three.select(F.explode(F.array(F.struct("x", "y"), F.struct(c("y").alias("x"), c("z").alias("y")))).alias("g"), "a").groupBy("g.x", "g.y").agg(F.max("a").alias("longer"))
    cuts2 = cuts2.join(inner, ["x", "y"], "left").where(~F.coalesce(100 * c("longer") >= inside_percent * c("a"), F.lit(False)))
    every = cuts2.select("x", "y", "z", "a", "l", "r", "score").unionByName(cuts3)
    word = lambda name: words.select(c("number").alias(name), c("word").alias(f"w_{name}"), *([c("lang")] if name == "x" else []))
    named = every.join(word("x"), "x").join(word("y"), "y").join(word("z"), "z", "left")
    named = named.withColumn("phrase", F.concat_ws(" ", "w_x", "w_y", "w_z"))
    order = Window.partitionBy("lang").orderBy(c("score").desc(), c("a").desc(), c("phrase").asc())
    ranked = named.withColumn("rank", F.row_number().over(order).cast("bigint")).where(c("rank") <= top)
    return ranked.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

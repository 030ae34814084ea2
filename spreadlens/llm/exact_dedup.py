"""Exact dedup by a Golomb-coded fingerprint exchange.

Texts are equal when they are identical after white space ``[\\x20\\x09-\\x0D]`` is deleted. Each Arrow batch is a block:
it sends the sorted 64-bit fingerprints of its texts, Golomb-Rice coded, to the owners of their ranges; an owner
answers with one bit a fingerprint, set where another text has the same; only the texts of such suspects are shuffled
and grouped byte by byte. The kept row of a group has the most code points, then the smallest id.

Null texts count as empty, and all empty texts are equal. Rows with a null id come after all others. Of rows that
repeat an id and a text exactly one is kept. An empty table gives an empty result; further columns are left alone.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window as W

from . import golomb
from .common import checkpointed, fresh, shares, whole_text

WHITE = " \t\n\x0b\x0c\r"
BLOCK = "block string, ids array<bigint>, chars array<bigint>, sha array<binary>, codes array<binary>"


def owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    return ((prints >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _blocks(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            text = b.column("text").fill_null("")
            sha = [hashlib.sha256(t.as_py().encode().translate(None, WHITE.encode())).digest() for t in text]
            prints = np.sort(np.array([int.from_bytes(s[:8], "big") for s in sha], dtype=np.uint64))
            cut = np.searchsorted(owner_of(prints, owners), np.arange(owners + 1, dtype=np.uint64))
            codes = [golomb.encode(prints[cut[o]:cut[o + 1]]) if cut[o] < cut[o + 1] else None for o in range(owners)]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([f"{task}-{k}"]), "ids": pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())),
                "chars": pa.array([pc.utf8_length(text).to_pylist()], pa.list_(pa.int64())),
                "sha": pa.array([sha], pa.list_(pa.binary())), "codes": pa.array([codes], pa.list_(pa.binary()))})

    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """An owner: which of the fingerprints that it has received came more than once."""
    lists = [golomb.decode(c) for c in group["code"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    bits = []
    for x in lists:
        at = np.searchsorted(twice, x)
        at[at == len(twice)] = 0
        bits.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), dtype=bool)).tobytes())
    return pd.DataFrame({"block": group["block"], "owner": group["owner"], "bits": bits})


def _suspects(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                prints = np.array([int.from_bytes(s[:8], "big") for s in r["sha"]], dtype=np.uint64)
                order = np.argsort(prints, kind="stable")
                sizes = np.bincount(owner_of(prints, owners).astype(np.int64), minlength=owners)
                bits = np.concatenate([np.unpackbits(np.frombuffer(x["bits"], np.uint8))[:sizes[x["owner"]]]
                                       for x in sorted(r["answers"], key=lambda x: x["owner"])])
                flags = np.zeros(len(prints), dtype=bool)
                flags[order] = bits.astype(bool)
                n = len(prints)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(r["ids"], pa.int64()), "chars": pa.array(r["chars"], pa.int64()), "sha": pa.array(r["sha"], pa.binary()),
                    "place": pa.array([f"{r['block']}-{i}" for i in range(n)]), "suspect": pa.array(flags)})

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    owners = shares(spark, own.count(), 1_000_000)
    blocks = checkpointed(own.mapInArrow(_blocks(owners), BLOCK))
    sent = blocks.select("block", F.posexplode("codes").alias("owner", "code")).filter(F.col("code").isNotNull())
    answers = sent.groupBy("owner").applyInPandas(_answer, "block string, owner int, bits binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("answers"))
    rows = checkpointed(blocks.select("block", "ids", "chars", "sha").join(answers, "block").mapInArrow(
        _suspects(owners), "id bigint, chars bigint, sha binary, place string, suspect boolean"))

    suspects = rows.filter("suspect")
    ids = suspects.select(F.col("id").alias("sid")).distinct()
    same = (own.join(ids.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("sid")), "left_semi")
            .groupBy(F.translate(whole_text(), WHITE, "").alias("bytes")).agg(F.count("*").alias("group_size"))
            .select(F.unhex(F.sha2("bytes", 256)).alias("sha"), "group_size").filter("group_size > 1"))
    keepers = suspects.groupBy("sha").agg(F.min(F.struct(-F.col("chars"), F.col("id").isNull().alias("no_id"), "id", "place")).alias("k"))
    groups = same.join(keepers, "sha").select("sha", "group_size", F.col("k.id").alias("keep_id"), F.col("k.place").alias("keep_place"))
    return rows.join(groups, "sha", "left").select(
        "id", F.when(F.col("keep_place").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("keep_place").isNull() | (F.col("place") == F.col("keep_place"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Of rows that repeat an id and a text one stays."""
    prefix = fresh(docs.columns, "_copy_")
    gone_id, gone_sha, nth = (f"{prefix}{c}" for c in ("id", "sha", "nth"))
    gone = checkpointed(exact_groups(docs, id_col, text_col).filter("not kept").select(
        F.col("id").alias(gone_id), F.unhex("text_sha256").alias(gone_sha), F.col("id").eqNullSafe(F.col("keep_id")).alias("again")))
    sha = F.unhex(F.sha2(F.translate(whole_text(text_col), WHITE, ""), 256))
    is_row = F.col(id_col).eqNullSafe(F.col(gone_id)) & (sha == F.col(gone_sha))
    moved = gone.filter("not again").distinct().hint("shuffle_hash")
    left = docs.join(moved, is_row, "left_anti")
    again = gone.filter("again").select(gone_id, gone_sha).distinct()
    if again.isEmpty():
        return left
    # identical rows apart: an id whose own text differs in white space alone keeps its longest text
    twice = left.join(again.hint("shuffle_hash"), is_row, "left_semi")
    longest = W.partitionBy(id_col, sha).orderBy(F.length(text_col).desc_nulls_last(), text_col)
    once = twice.withColumn(nth, F.row_number().over(longest)).filter(F.col(nth) == 1).drop(nth)
    return left.join(again.hint("shuffle_hash"), is_row, "left_anti").unionByName(once)

"""Language model, WARC, sharding, quality and the pipeline."""
import io
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.llm import language_model as lm, quality, sharding, warc

ROOT = "/root/testdata/sf0.001"


def test_language_model(make_docs, odd_rows, spark):
    words = "The the cat sat on a mat and dog ran far away".split()
    rng = np.random.default_rng(5)
    rows = odd_rows + [(100 + i, " ".join(rng.choice(words, int(rng.integers(1, 30)))) + (f" rare{i}" if i % 3 else "")) for i in range(60)]
    tokens = {k: [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] + [None] for k, (_, t) in enumerate(rows)}
    held = {k: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    counts = {}
    for k, own in tokens.items():
        for w in own if not held[k] else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted([(str(i), held[k], len(tokens[k]), sum(w in counts for w in tokens[k]), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens[k]), 6))
                   for k, (i, _) in enumerate(rows)])
    got = lm.score_documents(make_docs(rows)).collect()
    assert sorted([(str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score_documents(make_docs([])).count() == 0


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(6)
    classes = rng.integers(2, 12, 20_000)
    classes[1::2] = (classes[::2] * 3) % 10 + 2  # every second token follows from the one before
    at = np.array([0, len(classes)])
    context = lm.contexts(classes, at)
    frequencies = np.bincount(classes, minlength=lm.CLASSES) + 0.5
    frequencies = frequencies / frequencies.sum()
    codes, counts = np.unique(context * lm.CLASSES + classes, return_counts=True)
    model = lm.LogBilinear.fresh(frequencies)
    model.train(codes, counts, frequencies, 0)
    every = model.log10(np.full(lm.CLASSES, context[5]), np.arange(lm.CLASSES))
    assert abs((10**every).sum() - 1) < 1e-9
    assert model.log10(context, classes).mean() > np.log10(frequencies[classes]).mean() + 0.1


def test_model_beats_counts_on_held_out_documents(spark):
    got = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id bigint, url string, html string, record_type string").repartition(3)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ü x", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u\r\nX: y", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "n", "lone"), (None, "n", "<p>é</p>"),
            (6, "http://b", "long " * 100_000), (5, "http://c", "long " * 100_000), (7, "d", "\r\n\r\nWARC/1.1\r\n")]
    got = warc.round_trip(pages(spark, rows), payload=True).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        h, low = h or "", first.get(h or "")
        again = low is not None and i != low
        want.append((i, len(h.encode()), warc.digest(h.encode()), "revisit" if again else "response", low if again else None, None if again else h.encode()))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got], key=str) == sorted(want, key=str)
    assert warc.round_trip(pages(spark, [])).count() == 0
    short = warc.round_trip(pages(spark, [(1, "a", "xy"), (2, "b", "xy")]), min_bytes=3).collect()
    assert {r["record_type"] for r in short} == {"response"}


def test_warc_reader_finds_faults():
    good = warc.record_bytes(1, "u", b"payload", None, False)
    assert [r["payload"] for r in warc.read_records(io.BytesIO(warc.gzip_member(good) * 2))] == [b"payload"] * 2
    for bad in (warc.gzip_member(good)[:-9], warc.gzip_member(good.replace(b"payload", b"Payload")), warc.gzip_member(good[:-1]), warc.gzip_member(good + b"x"), warc.gzip_member(b"nothing\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_sharding(spark, make_docs, odd_rows):
    for rows, shards in ((odd_rows, 5), ([(i, str(i)) for i in range(1003)], 24), ([], 3)):
        docs = make_docs(rows)
        got = sharding.shard_rows(docs, shards).collect()
        assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(i), t or "") for i, t in rows)
        sizes = [sum(r["shard"] == s for r in got) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        for s in range(shards):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(make_docs([(i, str(i)) for i in range(1003)]).repartition(7), 24).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(make_docs([(i, str(i)) for i in range(1003)]), 24).collect()}


def test_communication_matrix_is_hypergeometric():
    draws = np.array([sharding.communication_matrix([30, 70, 0, 100], 4, seed)[1] for seed in range(400)])
    assert (draws.sum(axis=2) == [30, 70, 0, 100]).all() and (draws.sum(axis=1) == 50).all()
    assert abs(draws[:, 0, 0].mean() - 7.5) < 0.5
    variance = 30 * 0.25 * 0.75 * (200 - 30) / 199
    assert abs(draws[:, 0, 0].var() / variance - 1) < 0.25


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs).withColumnRenamed("id", "doc_id").join(labels, "doc_id").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in got]
    assert sum(right) >= 0.97 * len(right)
    clean = [r["kept"] for r in got if r["quality"] == 1]
    assert sum(clean) >= 0.99 * len(clean)


def test_quality_of_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = quality.score_quality(docs).collect()
    assert len(got) == len(odd_rows)
    assert all(r["score"] == 0 and not r["kept"] for r in got if r["id"] in (1, 2, 3))
    left = quality.keep_good(docs)
    assert left.columns == docs.columns and left.count() == sum(r["kept"] for r in got)
    assert quality.score_quality(make_docs([])).count() == 0 and quality.keep_good(make_docs([])).count() == 0


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from test_dedup import brute_components
    from test_text import codec, tokenizer_file

    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    terms = quality.learn_terms(docs, spark.read.parquet(f"{ROOT}/labels.parquet"))
    good = {r["id"] for r in quality.score_quality(docs, toxic=terms).filter("kept").collect()}
    best = {}
    for i in sorted(good):
        s = re.sub("[\x20\x09-\x0D]", "", rows[i])
        if s not in best or len(rows[i]) > len(rows[best[s]]):
            best[s] = i
    left = sorted(best.values())
    component = brute_components([(i, rows[i]) for i in left], 5)
    left = [i for i in left if component[i] == i]
    sets = lambda t: {tuple(w[i:i + 5]) for w in [[x for x in re.split("[\x20\x09-\x0D]+", t.lower()) if x]] for i in range(len(w) - 4)}
    items = [sets(r["text"]) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    left = [i for i in left if not any(x and len(x & sets(rows[i])) * 100 >= 80 * len(x) for x in items)]
    library = codec.load(tokenizer_file("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, ROOT).collect()}
    assert got == {i: library.encode(rows[i]) for i in left}

"""Extra columns with the operators' own names, results that do not follow the layout, and draws from large populations."""
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spreadlens.llm import decontaminate, exact_dedup, language_model as lm, near_dedup, quality, sharding, warc
from spreadlens.llm.queries import QUERIES

NAMES = ("of", "doc", "item", "g", "_gone", "__gone", "_id", "_sha", "_nth", "_copy_id", "_COPY_SHA", "again", "component", "node", "kept", "text_sha256", "n_found")


@pytest.fixture
def crowded(make_docs, odd_rows):
    docs = make_docs(odd_rows + [(30, "one  "), (31, " ".join(f"q{i}" for i in range(40))), (32, " ".join(f"q{i}" for i in range(40)) + " more")])
    return docs, docs.withColumns({n: F.lit(7) for n in NAMES})


def rows_of(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.select("doc_id", "text").collect())


def test_dropping_ignores_other_columns(crowded, spark):
    plain, wide = crowded
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(5, 20)))], "item_id bigint, text string")
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_copies, lambda d: decontaminate.drop_contaminated(d, items)):
        got = drop(wide)
        assert got.columns == wide.columns and rows_of(got) == rows_of(drop(plain))
        assert got.filter(" and ".join(f"`{n}` = 7" for n in NAMES)).count() == got.count() < plain.count()
    found = decontaminate.contained_items(wide, items).select("doc", "item").collect()
    assert sorted(map(tuple, found)) == [(31, 1), (32, 1)]


def test_shards_replace_columns_of_their_names(make_docs, odd_rows):
    docs = make_docs(odd_rows).withColumns({"shard": F.lit("mine"), "SLOT": F.lit(None).cast("string"), "_sh_part": F.lit(1), "_SH__": F.lit(2)})
    got = sharding.shard_rows(docs, 3)
    assert got.columns == [c for c in docs.columns if c.lower() not in ("shard", "slot")] + ["shard", "slot"]
    rows = got.collect()
    assert len(rows) == len(odd_rows) and all(r["_sh_part"] == 1 and r["_SH__"] == 2 for r in rows)
    for s in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_draws_beyond_a_billion_are_hypergeometric():
    good, bad, n = 9, 3 * 10**9, 10**9
    exact = [math.comb(n, k) * math.comb(good + bad - n, good - k) / math.comb(good + bad, good) for k in range(good + 1)]
    m = 20_000
    drawn = np.bincount([sharding._inverted((i + 0.5) / m, good, bad, n) for i in range(m)], minlength=good + 1) / m
    assert np.abs(np.cumsum(drawn) - np.cumsum(exact)).max() <= 1 / m
    rng = np.random.Generator(np.random.PCG64(4))
    good, bad, n = 2 * 10**9, 6 * 10**9, 500_000
    got = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(2000)])
    sd = (n * 0.25 * 0.75) ** 0.5
    assert abs(got.mean() - n / 4) < 4 * sd / 2000**0.5 and abs(got.std() / sd - 1) < 0.08
    assert sharding._inverted(0.999, 5, 2 * 10**9, 0) == 0 and sharding._inverted(0.5, 5, 2 * 10**9, 2 * 10**9 + 5) == 5
    targets, matrix = sharding.communication_matrix([4 * 10**9, 10, 3 * 10**9], 5, 1)
    assert matrix.sum(axis=1).tolist() == [4 * 10**9, 10, 3 * 10**9] and matrix.sum(axis=0).tolist() == targets


def test_small_draws_by_inversion_agree_with_counting():
    for good, bad, n in ((3, 4, 5), (6, 2, 4), (1, 1, 1), (8, 8, 3)):
        exact = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if n - k <= bad else 0 for k in range(min(good, n) + 1)]
        drawn = np.bincount([sharding._inverted((i + 0.5) / 5000, good, bad, n) for i in range(5000)], minlength=len(exact)) / 5000
        assert np.abs(np.cumsum(drawn) - np.cumsum(exact)).max() <= 1 / 5000


def test_the_end_keeps_its_count_beside_frequent_words(make_docs, monkeypatch):
    seen = []

    class Watched(lm.Vocabulary):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append(self)

    monkeypatch.setattr(lm, "Vocabulary", Watched)
    words = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(words + words)) for i in range(12)] + [(100 + i, "") for i in range(3)]
    got = lm.score_documents(make_docs(rows)).collect()
    assert seen[0].end == sum(not lm.held_out(i) for i, _ in rows) and len(seen[0].words) == lm.CLASSES - 2
    assert seen[0].other == got[0]["train_tokens"] - seen[0].end - int(seen[0].counts.sum())
    assert all(r["score"] < 0 for r in got)


def test_scores_do_not_follow_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, other = ({r["id"]: r["score"] for r in lm.score_documents(docs.repartition(n)).collect()} for n in (2, 7))
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) < 1e-6 for i in one)


def test_what_owners_exchange_does_not_grow_with_their_number(make_docs, monkeypatch):
    """Sums for every document of a block from every owner of a word made it grow with documents times owners."""
    tables, cut = [], lm.checkpointed
    monkeypatch.setattr(lm, "checkpointed", lambda df: tables.append(cut(df)) or tables[-1])
    rng = np.random.default_rng(9)
    docs = make_docs([(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 20))) for i in range(600)])
    sizes, scores = [], []
    for part in (1 << 30, 150):  # bytes of text for each owner: 4 owners, more than 500
        monkeypatch.setattr(lm, "OWNER_BYTES", part)
        del tables[:]
        scores.append({r["id"]: (r["n_known"], round(r["base_score"], 9)) for r in lm.score_documents(docs).collect()})
        exchanged = [t for t in tables if "block" in t.columns]
        sizes.append([t.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c, kind in t.dtypes if kind == "binary"), F.lit(0)))).first()[0] for t in exchanged])
    assert scores[0] == scores[1] and len(scores[0]) == 600
    assert sum(sizes[1]) < 1.2 * sum(sizes[0])


def test_a_word_of_every_document_costs_its_owner_one_entry_a_block(spark):
    sent = lm._send(64)(iter([pa.RecordBatch.from_pydict({"id": pa.array(range(3000)), "text": pa.array(["the"] * 3000)})]))
    received = [r for b in sent for r in b.to_pylist() if r["owner"] >= 0]
    assert sum(len(v) for r in received for v in r.values() if isinstance(v, bytes)) < 100


def test_blocks_end_by_rows_and_by_bytes():
    for texts in (["a b"] * 9001, ["word " * 200_000] * 20, ["word " * 3_000_000, None, "", "x"]):
        batch = pa.RecordBatch.from_pydict({"id": pa.array([2**62 + 1 + i for i in range(len(texts))]), "text": pa.array(texts)}).slice(1)
        got = list(lm.blocks(iter([batch])))
        assert [i for b in got for i in b[1]] == batch.column("id").to_pylist()
        assert [n for b in got for n in np.diff(b[4])] == [len((t or "").split()) + 1 for t in texts[1:]]
        assert all(len(b[1]) == 1 or len(b[1]) <= lm.BLOCK_ROWS and 5 * len(b[3]) <= lm.BLOCK_BYTES + 5 * len(b[1]) for b in got)
        assert len({b[0] for b in got}) == len(got)


def test_ids_of_a_block_with_a_null_id_stay_exact(make_docs):
    rows = [(2**62 + 1 + i, "same words here") for i in range(6)] + [(None, "same words here")]
    got = lm.score_documents(make_docs(rows).coalesce(1)).collect()
    assert sorted((r["id"] or 0 for r in got)) == sorted(i or 0 for i, _ in rows)


def test_triples_sent_in_pieces_are_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 400)) for _ in range(200)]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array(range(i, i + 20)), "text": pa.array(texts[i:i + 20])}) for i in range(0, 200, 20)]
    words = np.array([int(w) for w in np.unique(np.concatenate([b[3] for b in lm.blocks(iter(batches))])) if w != lm.END_WORD], dtype=np.uint64)
    vocabulary = lm.Vocabulary(words, np.arange(len(words))[::-1] + 1, 10**6, len(words))

    def counted():
        rows, total = [r for b in lm._triples(vocabulary, 5)(iter(batches)) for r in b.to_pylist()], {}
        for r in rows:
            for x, n in zip(np.frombuffer(r["codes"], np.int64).tolist(), np.frombuffer(r["counts"], np.int64).tolist()):
                total[r["part"], x] = total.get((r["part"], x), 0) + n
        return len(rows), total

    whole, small = counted(), (monkeypatch.setattr(lm, "TRIPLES", 9000), counted())[1]
    assert whole[1] == small[1] and whole[0] == 5 < small[0]


def test_folders_take_the_scheme_of_the_file_system(spark):
    assert {warc.located(spark, f"{p}/tmp/a b") for p in ("", "file:", "file://")} == {"file:///tmp/a b"}


def test_the_pipeline_rejects_toxic_documents(spark):
    import corpus_pipeline

    root = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.keep_good(spark, docs, root)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in QUERIES["op10_quality_classifier"](spark, root).filter("kept").select("doc_id").collect()}
    left = kept.join(labels.filter("quality = 1"), "doc_id")
    clean, toxic = (labels.filter(f"quality = 1 and toxic = {t}").count() for t in (0, 1))
    assert left.filter("toxic = 0").count() >= 0.98 * clean and left.filter("toxic = 1").count() <= 0.3 * toxic

"""Toxic documents are rejected however well formed they are."""
import zlib

from pyspark.sql import functions as F

from spreadlens.llm import quality
from spreadlens.llm.queries import QUERIES


def shares(got):
    good = [r for r in got if r["quality"] == 1]
    of = lambda toxic: sum(not r["kept"] for r in good if r["toxic"] == toxic) / sum(r["toxic"] == toxic for r in good)
    return of(1), of(0)


def test_query_rejects_toxic_documents(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet")
    recall, false = shares(QUERIES["op10_quality_classifier"](spark, root).join(labels, "doc_id").collect())
    assert recall >= 0.85 and false <= 0.02


def test_terms_hold_on_labels_not_learned_from(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    terms = quality.learn_terms(docs, labels.filter(even))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", "toxic").collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 2]
    toxicity = terms.toxicity([r["text"] for r in rows])
    recall, false = shares([r.asDict() | {"kept": x < quality.TOXIC} for r, x in zip(rows, toxicity)])
    print(recall, false)
    assert recall >= 0.75 and false <= 0.02


def test_toxicity_of_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows + [(20, "You IDIOT."), (21, "idiotic"), (22, "zorgon alpha"), (23, None)] + [(100 + i, f"word{i} Zorgonen here") for i in range(12)] + [(200 + i, f"word{i} clean here") for i in range(12)])
    labels = spark.createDataFrame([(100 + i, 1) for i in range(12)] + [(200 + i, 0) for i in range(12)] + [(23, 0), (1, None), (None, 1), (999, 1)], "doc_id bigint, toxic int")
    terms = quality.learn_terms(docs, labels)
    assert "zorgon" in terms.shares and "here$" not in terms.shares
    got = quality.score_quality(docs, toxic=terms).collect()
    bad = {r["id"] for r in got if r["toxicity"] >= quality.TOXIC}
    assert len(got) == docs.count() and bad == {20, 22} | {100 + i for i in range(12)}
    assert not any(r["kept"] for r in got if r["id"] in bad)
    assert quality.keep_good(docs, toxic=terms).count() == sum(r["kept"] for r in got)
    empty = quality.learn_terms(make_docs([]), labels.limit(0))
    assert empty.shares == {f"{w}$": 1.0 for w in quality.TERMS}
    assert quality.score_quality(make_docs([]), toxic=empty).count() == 0

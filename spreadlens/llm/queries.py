"""Registered queries of the operators, with SQL where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, collocations, decontaminate, exact_dedup, fill_middle, language_model, near_dedup, quality, repeats, secrets, sentencepiece_codec, sharding, warc
from .common import documents, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are, on the driver and on every executor alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


SQL_WORDS = """d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents)"""


def sql_shingles(size: int) -> str:
    return SQL_WORDS + f""", s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
       ELSE list_transform(generate_series(1, len(w) - {size - 1}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END)) AS g FROM d),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""


@query("op3_minhash_near_dedup", f"""WITH RECURSIVE {sql_shingles(4)},
 hits AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM hits JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = r.doc_id AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""")
def op3(spark: SparkSession, root: str) -> DataFrame:
    """Near-duplicate documents: 4-word shingles, a Jaccard of 0.8 or more."""
    return near_dedup.near_duplicates(documents(spark, root), size=4, percent=80).withColumnRenamed("id", "doc_id")


@query("op9_exact_dedup", """WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(s) AS text_sha256 FROM t WINDOW w AS (PARTITION BY s ORDER BY chars DESC, doc_id)""")
def op9(spark: SparkSession, root: str) -> DataFrame:
    """Exact copies: identical texts but for white space."""
    return exact_dedup.exact_groups(documents(spark, root)).withColumnRenamed("id", "doc_id")


def _sql_matches(kind: int, pattern: str, group: int, least: int) -> str:
    """Matches of one pattern with their places: lengths between and of them, added up."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, pos AS start, pos + len(m) AS end_, m FROM (
  SELECT doc_id, unnest(m) AS m, unnest(v) AS v, unnest(list_transform(generate_series(1, len(m)), lambda i:
    coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, regexp_split_to_array(t, '{p}') AS g FROM d))
  WHERE len(v) >= {least}"""


def _sql_secrets() -> str:
    names = [k[0] for k in secrets.BASE_KINDS] + [c.kind for c in secrets.CLASSES]
    base = " UNION ALL ".join(f"({_sql_matches(k, *rest)})" for k, (_, *rest) in enumerate(secrets.BASE_KINDS))
    allow = "|".join(f"(?:{p})" for p in secrets.ALLOW)
    added = " UNION ALL ".join(f"""(SELECT doc_id, kind, start + min(i) AS start, start + max(i) + {c.width} AS end_ FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, start ORDER BY i) AS k FROM (
   SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, start ORDER BY i) + {c.width} THEN 0 ELSE 1 END AS fresh FROM (
    SELECT doc_id, kind, start, m, unnest(generate_series(0, len(m) - {c.width})) AS i FROM ({_sql_matches(len(secrets.BASE_KINDS) + n, f"{c.pattern}{{{c.least},}}", 0, c.least)})
    WHERE NOT regexp_matches(m, '{allow}'))
   WHERE list_aggregate(string_split(substr(m, i::BIGINT + 1, {c.width}), ''), 'entropy') >= {c.bits} - 1e-9))
  GROUP BY doc_id, kind, start, k)""" for n, c in enumerate(secrets.CLASSES))
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), base AS (SELECT doc_id, kind, start, end_ FROM ({base})),
 every AS (SELECT * FROM base UNION ALL SELECT * FROM ({added}) a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b.end_ >= a.end_)),
 named AS (SELECT *, {name} || ':' || start::BIGINT || ':' || end_::BIGINT AS s FROM every)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_entropy,
 sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind <= 2), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN named n USING (doc_id) GROUP BY d.doc_id"""


@query("op1_secret_scan", _sql_secrets())
def op1(spark: SparkSession, root: str) -> DataFrame:
    """Secrets in every document: the fixed kinds, and spans of high entropy."""
    found = secrets.find_secrets(documents(spark, root))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(F.col("id").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.size("added").cast("bigint").alias("n_entropy"),
                        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.array_sort(F.concat("base", "added"))).alias("spans"))


@query("op2_sentencepiece_codec")
def op2(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the 32k piece model for every document, and the text that they decode to."""
    return sentencepiece_codec.encode_and_decode(documents(spark, root), tokenizer_file("piece_bpe_32k.model"), keep=False).withColumnRenamed("id", "doc_id")


@query("op4_suffix_repeats", """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT doc_id, unnest(generate_series(0, len(h) // 2 - 50)) AS i, h FROM t WHERE len(h) >= 100),
 w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS g FROM p),
 f AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
 r AS (SELECT w.doc_id, w.i FROM w JOIN f USING (g) WHERE f.low < w.doc_id),
 s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM r),
 q AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
 u AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM q GROUP BY doc_id, k),
 v AS (SELECT u.doc_id, u.k, u.a, u.b, coalesce(lag(u.b) OVER o, 0) AS since, lead(u.a) OVER o IS NULL AS final FROM u WINDOW o AS (PARTITION BY u.doc_id ORDER BY u.k)),
 x AS (SELECT v.doc_id, count(*) AS n_spans, sum(v.b - v.a) AS n_removed,
   string_agg(substr(t.h, (2 * v.since + 1)::BIGINT, (2 * (v.a - v.since))::BIGINT) || CASE WHEN v.final THEN substr(t.h, (2 * v.b + 1)::BIGINT) ELSE '' END, '' ORDER BY v.k) AS kept
   FROM v JOIN t USING (doc_id) GROUP BY v.doc_id)
SELECT t.doc_id, len(t.h) // 2 AS n_bytes, coalesce(x.n_removed, 0)::BIGINT AS n_removed, coalesce(x.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(x.kept, t.h))) AS kept_sha256 FROM t LEFT JOIN x USING (doc_id)""")
def op4(spark: SparkSession, root: str) -> DataFrame:
    """Documents without the 50-byte strings that stand in a document of a smaller id."""
    return repeats.remove_repeats(documents(spark, root), keep_text=False).withColumnRenamed("id", "doc_id")


@query("op7_warc")
def op7(spark: SparkSession, root: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(documents(spark, root, "pages"))


@query("op8_sharding")
def op8(spark: SparkSession, root: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most."""
    docs = documents(spark, root).select("doc_id", (F.octet_length(whole_text()) + 8).cast("bigint").alias("size"), F.crc32(whole_text()).alias("text_crc32"))
    return sharding.shard_rows(docs, 24).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query("op6_decontamination", """WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
 d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
 x AS (SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM i),
 y AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM d),
 n AS (SELECT item_id, count(*) AS n_item FROM x GROUP BY item_id),
 f AS (SELECT doc_id, item_id, count(*) AS n_found FROM x JOIN y USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_found FROM f JOIN n USING (item_id) WHERE n_found * 100 >= n_item * 80""")
def op6(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a benchmark item: 80 % of its 5-word shingles or more."""
    found = decontaminate.contained_items(documents(spark, root), documents(spark, root, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


@query("op5_language_model")
def op5(spark: SparkSession, root: str) -> DataFrame:
    """Log10 probabilities of every document by counts and by the log-bilinear model."""
    return language_model.score_documents(documents(spark, root)).withColumnRenamed("id", "doc_id")


@query("op10_quality_classifier")
def op10(spark: SparkSession, root: str) -> DataFrame:
    """Quality and toxicity of every document: weak labels, their posterior, the scorer's score, toxic terms and the decision."""
    docs = documents(spark, root)
    return quality.score_quality(docs, toxic=quality.learn_terms(docs, documents(spark, root, "labels"))).withColumnRenamed("id", "doc_id")

@query("op11_fill_in_middle", """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
  sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 k AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS k1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS k2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
 p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(k1, k2)], '') AS a, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m, array_to_string(u[greatest(k1, k2) + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM p""")
def op11(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its middle at the end, and restored from that."""
    return fill_middle.fill_in_middle(documents(spark, root), keep=False).withColumnRenamed("id", "doc_id")


@query("op12_byte_bpe_codec")
def op12(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the 50k byte-level vocabulary for every document, and the bytes that they decode to."""
    return byte_bpe.encode_and_decode(documents(spark, root), tokenizer_file("byte_bpe_50k.tiktoken"), keep=False).withColumnRenamed("id", "doc_id")


@query("op13_collocations", """WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
 g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k),
 f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
 total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
 cand AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
 cut AS (SELECT c.*, j, array_to_string(s[1:j], ' ') AS h, array_to_string(s[j + 1:], ' ') AS t FROM (SELECT *, string_split(phrase, ' ') AS s FROM cand) c, (VALUES (1), (2)) AS v(j) WHERE j < k),
 scored AS (SELECT cut.lang, cut.k, cut.phrase, cut.a, x.a AS l, y.a AS r, j, ((1000000::HUGEINT * cut.a * cut.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.h AND x.k = j JOIN f y ON y.lang = cut.lang AND y.phrase = cut.t AND y.k = cut.k - j),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 inner_ AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS s FROM cand WHERE k = 3)) GROUP BY lang, phrase),
 kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase AND b.k = 2 WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang)) WHERE rank <= 2000""")
def op13(spark: SparkSession, root: str) -> DataFrame:
    """Collocations of two and three words, by language."""
    return collocations.collocations(documents(spark, root))

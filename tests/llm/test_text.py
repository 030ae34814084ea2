"""Secrets, pieces, repeated strings, contained items against brute force."""
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spreadlens.llm import decontaminate, repeats, secrets, sentencepiece_codec as codec
from spreadlens.llm.queries import tokenizer_file


def brute_base(text):
    out = []
    for k, (_, pattern, group, least) in enumerate(secrets.BASE_KINDS):
        pattern = "[0-9a-f]+" if k == 2 else pattern
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return sorted(out)


def brute_entropy(text, c):
    spans = []
    for m in re.finditer(f"{c.pattern}{{{c.least},}}", text):
        if any(re.search(p, m[0]) for p in secrets.ALLOW):
            continue
        for i in range(len(m[0]) - c.width + 1):
            w = m[0][i:i + c.width]
            h = -sum(w.count(x) / c.width * math.log2(w.count(x) / c.width) for x in set(w))
            if h >= c.bits - 1e-9:
                a, b = m.start() + i, m.start() + i + c.width
                if spans and spans[-1][0] >= m.start() and a <= spans[-1][2]:
                    spans[-1] = (spans[-1][0], spans[-1][1], b)
                else:
                    spans.append((a, len(secrets.BASE_KINDS) + secrets.CLASSES.index(c), b))
    return spans


def test_secrets(make_docs, odd_rows):
    rng = np.random.default_rng(0)
    alphabet = np.array(list(secrets.CLASSES[0].alphabet))
    key = lambda n: "".join(rng.choice(alphabet, n))
    texts = [f"é😀 {key(50)} x {key(23)} {'a' * 40}{key(40)}", f"secret:token: abcdefgh Password = \"{key(30)}\" api_key:{key(7)}", "AKIA" + "A" * 15 + " AKIA" + "Q7" * 9,
             "password == abcdefgh token=='abcdef", "0123456789abcdef" * 3 + "g " + "deadbeef" * 4, "f81d4fae-7dec-11d0-a765-00a0c91e6bf6 " + key(24) + "example", key(3000),
             " ".join(f"token={key(9)}" for _ in range(700)), "A" * 30 + "0" * 30 + key(40) + "=" * 40 + key(40)]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts)]
    got = secrets.find_secrets(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for i, t in rows:
        base = brute_base(t or "")
        added = [s for c in secrets.CLASSES for s in brute_entropy(t or "", c) if not any(b[0] <= s[0] and b[2] >= s[2] for b in base)]
        by_text[i] = (base, added)
    for r in got:
        assert ([tuple(x) for x in r["base"]], [tuple(x) for x in r["added"]]) == by_text[r["id"]], r["id"]
    assert any(by_text[i][1] for i in by_text)
    assert secrets.find_secrets(make_docs([])).count() == 0
    written = secrets.find_secrets(make_docs(rows[-1:])).select(secrets.written(F.col("added"))).first()[0]
    assert written.split(",")[0].startswith("entropy_base64:")


def test_pieces(make_docs, odd_rows):
    model = tokenizer_file("piece_bpe_32k.model")
    library = codec.load(model)
    texts = ["", " ", "  ", "a ", " a", "a  b", "▁a ▁", "a\nb \n c", "<s> </s> <unk>", "　x", "é́ ñ 😀😀", "   lead and   runs   ", "x" * 500, "日本語 テキスト", "\x00\x01 \x7f", "a▁▁b"]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts)]
    got = codec.encode_and_decode(make_docs(rows), model).collect()
    want = {}
    for i, t in rows:
        ids = library.encode(t or "")
        want[i] = (ids, library.decode(ids))
    assert len(got) == len(rows)
    for r in got:
        ids, text = want[r["id"]]
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids, text, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert codec.encode_and_decode(make_docs([]), model).count() == 0


def test_ids_leave_the_task_in_small_batches():
    model, texts = tokenizer_file("piece_bpe_32k.model"), ["a word or two " * 9, "", None] * 400
    library, whole = codec.load(model), pa.RecordBatch.from_pydict({"id": list(range(1200)), "_text": texts})
    out = list(codec._codec(model, True)(iter([whole])))
    assert len(out) > 4 and max(map(len, out)) <= 300
    got = pa.Table.from_batches(out).to_pylist()
    assert [r["id"] for r in got] == list(range(1200))
    assert [r["ids"] for r in got[:3]] == [library.encode(texts[0]), [], []]


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(codec, "TABLE", 3)
    library = codec.load(tokenizer_file("piece_bpe_32k.model"))
    table = codec.ChunkTable(library)
    text = "one two three four five one two  six"
    assert codec.encode_with(table, text)[0] == ",".join(map(str, library.encode(text)))
    assert len(table) <= 3


def brute_repeats(rows, width=repeats.WIDTH):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - width + 1):
                first[b[p:p + width]] = min(first.get(b[p:p + width], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        if i is not None:
            for p in range(len(b) - width + 1):
                if first[b[p:p + width]] < i:
                    gone[p:p + width] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("stretch", [64, 1 << 19])
def test_repeats(make_docs, odd_rows, monkeypatch, stretch):
    rng = np.random.default_rng(2)
    part = lambda n: "".join(rng.choice(list("abé d"), n))
    passage, other = part(90), part(51)
    rows = [(i, (t or "")[:3000] if t else t) for i, t in odd_rows]
    rows += [(20 + i, part(int(rng.integers(0, 60))) + passage[int(rng.integers(0, 20)):70 + int(rng.integers(0, 20))] + part(40) + other * (i % 3)) for i in range(12)]
    rows += [(50, "ab" * 100), (51, "ab" * 60), (52, "ba" * 25), (40, "x" * 49), (41, "x" * 49)]
    if stretch == 64:
        monkeypatch.setattr(repeats, "STRETCH", stretch)
        data = np.frombuffer((passage + other).encode(), np.uint8)
        trigger, mark, first, count = repeats.phrases(data)
        assert (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(data) - repeats.WIDTH + 1
        return
    got = repeats.remove_repeats(make_docs(rows)).collect()
    assert sorted([(r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got], key=str) == brute_repeats(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["starts"]) == r["n_spans"] for r in got)
    assert repeats.remove_repeats(make_docs([])).count() == 0


def test_contained_items(spark, make_docs, odd_rows):
    rng = np.random.default_rng(3)
    item = lambda n: " ".join(f"q{x}" for x in rng.integers(0, 300, n))
    items = {0: item(15), 1: item(60), 2: item(5), 3: "too short", 4: None, 5: item(200)}
    rows = list(odd_rows)
    for k, t in items.items():
        w = (t or "").split()
        for cut in (1.0, 0.9, 0.82, 0.6):
            noise = " ".join(f"n{x}" for x in rng.integers(0, 5000, 3000))
            rows.append((len(rows) + 100, noise + " " + " ".join(w[:int(len(w) * cut)]).upper() + "\n" + noise))
    table = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    sets = lambda t: {tuple(w[i:i + 5]) for w in [[x for x in re.split("[\x20\x09-\x0D]+", (t or "").lower()) if x]] for i in range(len(w) - 4)}
    want = set()
    for i, t in rows:
        for k, x in items.items():
            s = sets(x)
            if s and len(s & sets(t)) * 100 >= 80 * len(s):
                want.add((i, k, len(s), len(s & sets(t))))
    docs = make_docs(rows)
    assert {tuple(r) for r in decontaminate.contained_items(docs, table).collect()} == want
    left = decontaminate.drop_contaminated(docs, table)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == sorted(i or -1 for i, _ in rows if i not in {w[0] for w in want})
    assert decontaminate.contained_items(make_docs([]), table).count() == 0
    assert decontaminate.contained_items(docs, table.filter("item_id > 99")).count() == 0


def test_agreement_thresholds():
    assert all(1 <= decontaminate.least_agreeing(n, 80) <= n for n in range(1, 80))
    assert decontaminate.least_agreeing(1, 80) == 1

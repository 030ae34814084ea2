"""Fill-in-the-middle, byte-level pieces and collocations against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from spreadlens.llm import byte_bpe, collocations, fill_middle, quotient_filter as qf
from spreadlens.llm.queries import tokenizer_file
from spreadlens.llm.text_arrays import text_bytes

sha = lambda b: hashlib.sha256(b).hexdigest()


def brute_middle(i, text, rule):
    text = text or ""
    d = hashlib.sha256(f"{rule.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k:k + 8], 16) for k in (0, 8, 16, 24)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rule.percent:
        return (i, n, "plain", None, None, sha(text.encode()), sha(text.encode()))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < rule.spm_percent else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (i, n, form, len(p), len(m), sha(out.encode()), sha(text.encode()))


@pytest.mark.parametrize("piece, rule", [(8, fill_middle.Rule()), (1 << 18, fill_middle.Rule(60, 30, "x"))])
def test_middle(make_docs, odd_rows, monkeypatch, piece, rule):
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", piece)
    rng = random.Random(5)
    alphabet = ["\n", "a", "é😀", "<", "P>", "<S", " word", "\r\n"]
    rows = [(i, t[:2000] if t else t) for i, t in odd_rows] + [(100 + i, "".join(rng.choice(alphabet) for _ in range(i))) for i in range(60)]
    rows += [(200, "x<M>y"), (201, "\n\n\n"), (202, "no end"), (200, "x<M>y"), (203, "<" * 9 + "\n<S\n<P"), (None, None), (None, None)]
    got = fill_middle.fill_in_middle(make_docs(rows), rule)
    assert got.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output", "restored"]
    got = [tuple(r) for r in got.collect()]
    assert sorted((r[:7] for r in got), key=str) == sorted((brute_middle(i, t, rule) for i, t in rows), key=str)
    assert all(sha(bytes(r[7])) == r[5] and sha(bytes(r[8])) == r[6] for r in got)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(make_docs([])).count() == 0


def test_pieces_lie_within_units(monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", 10)
    data = b"ab\ncd\nefghijklmnopqrstuv\nw"
    parts = list(fill_middle.pieces_of(data))
    assert b"".join(parts) == data and parts[0] == b"ab\ncd\n" and max(map(len, parts)) <= 10


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


@pytest.mark.parametrize("stretch", [5, 1 << 20])
def test_boundaries(library, monkeypatch, stretch):
    monkeypatch.setattr(byte_bpe, "STRETCH", stretch)
    table, decoder = byte_bpe.codec_of(library[0])
    rng = random.Random(stretch)
    texts = ["".join(rng.choice("''''  \n\tstmdrvelleaxX1٣é!. 　😀\x1c\x85") for _ in range(rng.randrange(30))) for _ in range(4000)]
    data, offsets = text_bytes(pa.array(texts))
    for text, ids in zip(texts, byte_bpe.encode_texts(data, offsets, table)):
        assert ids.tolist() == library[1].encode_ordinary(text), text
        assert decoder.decode(ids, decoder.offsets(ids)).decode() == text


def test_every_code_point(library):
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    texts = [f"a{every[i:i + 500]}1" for i in range(0, len(every), 500)]
    data, offsets = text_bytes(pa.array(texts))
    table = byte_bpe.codec_of(library[0])[0]
    assert all(ids.tolist() == library[1].encode_ordinary(t) for t, ids in zip(texts, byte_bpe.encode_texts(data, offsets, table)))


def test_scan_composes_like_single_steps():
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, byte_bpe.NONE + 1, 5000).astype(np.uint8)
    state, want = 3, []
    for k in kinds:
        state = byte_bpe.step(state, k)
        want.append(state)
    assert byte_bpe.states_of(kinds, 3).tolist() == want


def test_long_slices_and_full_tables(library, monkeypatch):
    ranks = byte_bpe.load_ranks(library[0])
    monkeypatch.setattr(byte_bpe, "TABLE", 3)
    monkeypatch.setattr(byte_bpe, "PAIRS", 5)
    table = byte_bpe.SliceTable(ranks)
    texts = ["a" * 30_000, "abc" * 999, "é" * 700, " " * 900 + "x", "".join(map(str, range(3000))), "one two three four five six one two"]
    data, offsets = text_bytes(pa.array(texts))
    assert all(ids.tolist() == library[1].encode_ordinary(t) for t, ids in zip(texts, byte_bpe.encode_texts(data, offsets, table)))
    assert len(table) <= 3 and len(table.pairs) <= 5


def test_byte_codec(make_docs, odd_rows, library):
    rows = odd_rows + [(50, "<|endoftext|> it's  we'll\n\n x")]
    got = byte_bpe.encode_and_decode(make_docs(rows), library[0]).collect()
    want = {i: library[1].encode_ordinary(t or "") for i, t in rows}
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        ids = want[r["id"]]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == (text[r["id"]] or "").encode()
        assert r["ids_sha256"] == sha(np.array(ids, dtype="<u4").tobytes()) and r["decoded_sha256"] == sha(r["decoded"])
        sizes = [len(library[1].decode_single_token_bytes(k)) for k in ids]
        assert r["offsets"] == (np.cumsum(sizes) - sizes).tolist()
    assert byte_bpe.encode_and_decode(make_docs([]), library[0]).count() == 0


def brute_phrases(rows, least, longest, inside_percent, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= inside_percent * a for q, b in cand.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), a, l, r, totals[lang], score))
        out += [(lang, n + 1, r[2].decode(), *r[3:]) for n, r in enumerate(sorted(rows_)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block, least, longest, top", [(40, 3, 3, 2000), (1_000_000, 10, 2, 7)])
def test_collocations(spark, odd_rows, monkeypatch, block, least, longest, top):
    monkeypatch.setattr(collocations, "BLOCK_TOKENS", block)
    monkeypatch.setattr(collocations, "HELD_KEYS", 16)
    monkeypatch.setattr(collocations, "PART_WORDS", 3)
    rng = random.Random(least)
    words = ["a", "B", "b", "É", "é", "of", "the", "x\x00", "😀", "new", "york", "New"]
    rows = [(rng.choice([None, "und", "en", "de"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "; "]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [("en", "of the new york " * 30), ("en", "of the new york " * 30)] + [("xx", t[:3000] if t else t) for _, t in odd_rows]
    docs = spark.createDataFrame([(l, t, 1, "b", 2) for l, t in rows], "lang string, text string, n long, block string, x int").repartition(3)
    got = collocations.collocations(docs, least, longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, longest, 50, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_past_64_bits(spark):
    a, l, r = 10**12 + 7, 3 * 10**12 + 1, 7 * 10**12 + 11
    row = spark.createDataFrame([(a, l, r), (10, 10, 10), (10, 3_000_000, 7)], "a bigint, l bigint, r bigint").select(collocations.cut_score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [x[0] for x in row] == [1_000_000 * a * a // (l * r), 1_000_000, 1_000_000 * 100 // 21_000_000]


@pytest.mark.parametrize("bits", [1, 5, 13, 14, 21, 22, 31])
def test_filters(bits):
    rng = np.random.default_rng(bits)
    key = qf.Permutation(bits)
    draw = lambda n: tuple(rng.integers(0, 1 << bits, n, dtype=np.uint64) for _ in range(3))
    x, y, z = draw(3000)
    top, rest = key.forward(x, y, z)
    assert int(top.max()) < 1 << key.top_bits and int(rest.max()) < 1 << max(key.rest_bits, 1)
    assert all((u == v).all() for u, v in zip((x, y, z), key.backward(top, rest)))
    want = Counter()
    runs = []
    for _ in range(3):
        i = rng.integers(0, 300, 2000)
        own = qf.in_order(top[i], rest[i], None, key.rest_bits)
        own[2][::7] += rng.integers(0, 1 << 40, len(own[2][::7]))
        code = qf.encode(*own, key.rest_bits)
        back = qf.decode(code, key.rest_bits)
        assert all((u == v).all() for u, v in zip(own, back))
        for t, r, n in zip(*own):
            want[int(t), int(r)] += int(n)
        runs.append(back)
    merged = qf.in_order(*(np.concatenate(v) for v in zip(*runs)), key.rest_bits)
    assert {(int(t), int(r)): int(n) for t, r, n in zip(*merged)} == want
    none = tuple(v[:0] for v in merged)
    assert len(qf.decode(qf.encode(*none, key.rest_bits), key.rest_bits)[0]) == 0


def test_a_filter_is_smaller_than_its_keys():
    key = qf.Permutation(17)
    rng = np.random.default_rng(0)
    own = qf.in_order(*key.forward(*(rng.integers(1, 1 << 17, 100_000, dtype=np.uint64) for _ in range(3))), None, key.rest_bits)
    assert len(qf.encode(*own, key.rest_bits)) < 5.0 * len(own[0])  # 51 bits of key, less about 16 of quotient
    with pytest.raises(ValueError):
        qf.Permutation(32)

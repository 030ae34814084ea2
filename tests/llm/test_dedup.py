"""Exact and near copies, components and the Golomb code against brute force."""
import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from spreadlens.llm import components, exact_dedup, golomb, near_dedup


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, dtype=np.uint64))
    assert (golomb.decode(golomb.encode(v)) == v).all()


def brute_exact(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for s, g in groups.items():
        first = min(g)
        keep = None if first[1] else first[2]
        out += [(None if x[1] else x[2], keep, len(g), hashlib.sha256(s.encode()).hexdigest()) for x in g]
    return sorted(out, key=str), len(groups)


def test_exact_groups(make_docs, odd_rows):
    got = exact_dedup.exact_groups(make_docs(odd_rows)).collect()
    want, groups = brute_exact(odd_rows)
    assert sorted([(r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == want
    assert sum(r["kept"] for r in got) == groups
    assert exact_dedup.exact_groups(make_docs([])).count() == 0


def test_drop_copies_keeps_one_row_of_each_text(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == brute_exact(odd_rows)[1]
    assert exact_dedup.drop_copies(make_docs([(5, "a b"), (5, "ab"), (5, "a b")])).collect()[0]["text"] == "a b"


def shingles(text, size):
    w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size, percent=80):
    sets, root = {i: shingles(t, size) for i, t in rows if i is not None}, {i: i for i, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def near_rows():
    """Chains of edits, groups around the threshold and a group with many members."""
    rng, rows = np.random.default_rng(1), []
    for g in range(6):
        base = [f"v{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(25 if g == 0 else 8):
            edit = list(base)
            for k in rng.integers(0, 60, rng.integers(0, 5)):
                edit[k] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows) + 100, " ".join(edit)))
            if g > 2:
                base = edit
    return rows


def test_near_duplicates(make_docs, odd_rows):
    rows = near_rows() + odd_rows
    for size in (4, 5):
        got = near_dedup.near_duplicates(make_docs(rows), size=size).collect()
        want = brute_components(rows, size)
        assert len(got) == len(rows)
        for r in got:
            if r["id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["component_id"], r["kept"]) == (want[r["id"]], want[r["id"]] == r["id"])
        assert {r["id"]: r["n_shingles"] for r in got if r["id"] == 6} == {6: len(shingles(dict(rows)[6], size))}


def test_pivots_reach_every_pair_of_a_bucket(make_docs):
    """All texts share most bands with the smallest, but are linked with each other in twos only."""
    rng, rows = np.random.default_rng(4), []
    base = [f"b{i}" for i in range(80)]
    for pair in range(8):
        own = list(base)
        for k in range(0, 80, 16):
            own[(k + 2 * pair) % 80] = f"p{pair}x{k}"
        for half in range(2):
            text = list(own)
            text[int(rng.integers(0, 80))] = f"h{half}"
            rows.append((2 * pair + half, " ".join(text)))
    got = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(make_docs(rows), size=5).collect()}
    assert got == brute_components(rows, 5)


def test_near_duplicates_of_nothing(make_docs):
    assert near_dedup.near_duplicates(make_docs([])).count() == 0
    docs = make_docs([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None)])
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


def threshold_group():
    """Eighty copies of one text whose similarities spread around the threshold, and one that is like few of them as the smallest."""
    rng, base, rows = np.random.default_rng(11), [f"t{i}" for i in range(70)], []
    for i in range(80):
        text = list(base)
        for k in rng.integers(0, 70, 3 if i == 0 else rng.integers(0, 4)):
            text[k] = f"x{i}y{k}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_large_bucket_takes_one_round_of_tiles(make_docs, monkeypatch):
    calls, components_of = [], near_dedup.connected_components
    monkeypatch.setattr(near_dedup, "connected_components", lambda links: calls.append(1) or components_of(links))
    rows = threshold_group()
    got = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(make_docs(rows), size=5).collect()}
    assert got == brute_components(rows, 5)
    assert len(set(got.values())) > 5 and len(calls) == 2


def test_tiles_and_rounds_reach_every_pair(make_docs, monkeypatch):
    """Blocks of nine members, and so little work a round that members of the largest component go first."""
    monkeypatch.setattr(near_dedup, "TILE", 9)
    monkeypatch.setattr(near_dedup, "WORK", 20)
    rows = threshold_group()
    got = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(make_docs(rows), size=5).collect()}
    assert got == brute_components(rows, 5)

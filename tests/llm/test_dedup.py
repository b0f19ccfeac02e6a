import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orbweave.llm import embedding_dedup, graph, near_dedup, substring_dedup, wordblocks


def words(text):
    return (text or "").encode().split()


def shingles(text, width=5):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return set(zip(*[w[k:] for k in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())


def linked(ids, near):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def expected_groups(rows, percent):
    sets = {r[0]: shingles(r[1]) for r in rows}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in linked(sets, near).items()}


@pytest.mark.parametrize("limits", [{}, {"node_limit": 2, "chunk_shingles": 300}])
def test_near_duplicates_match_brute_force(docs, corpus, limits):
    found = near_dedup.near_duplicates(docs, 80, **limits).collect()
    assert len(found) == len(corpus)
    want = expected_groups(corpus, 80)
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in found} == want
    assert all(r["kept"] == (r["id"] == r["component"]) for r in found)


def test_near_duplicates_of_nothing(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_keep_one_keeps_columns_and_one_row_of_a_group(docs, corpus):
    rows = near_dedup.keep_one(docs, 80).collect()
    want = sorted(i for i, (_, c) in expected_groups(corpus, 80).items() if c == i)
    assert sorted(r["doc_id"] for r in rows) == want
    assert rows[0].__fields__ == docs.columns


def test_null_ids_link_with_nothing(spark):
    t = "a b c d e f g h"
    frame = spark.createDataFrame([(None, t), (1, t), (2, t)], "doc_id long, text string")
    found = {r["id"]: r["component"] for r in near_dedup.near_duplicates(frame).collect()}
    assert found[2] == 1 and found[1] == 1


def test_keep_one_judges_texts_not_ids(spark):
    base = [f"w{i}" for i in range(120)]
    near, clean, other = " ".join([*base[:50], "x", *base[51:]]), " ".join(f"c{i}" for i in range(90)), " ".join(f"d{i}" for i in range(90))
    rows = [(1, " ".join(base)), (5, near), (5, clean), (7, other), (7, other), (9, ""), (9, ""), (None, clean), (None, "one two"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in near_dedup.keep_one(frame, 80).collect()]
    assert sorted(found, key=repr) == sorted([r for i, r in enumerate(rows) if i not in (1, 4)], key=repr)


def test_keep_one_keeps_the_smallest_id_under_any_key(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(12, 2, -1)]
    found = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert [r["doc_id"] for r in found] == [3]


def test_large_near_copy_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(np.random.default_rng(1).integers(0, 120, 60).tolist())]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, node_limit=8, chunk_shingles=2000).collect()
    assert {r["id"]: r["component"] for r in found} == {i: c for i, (_, c) in expected_groups(rows, 85).items()}


def expected_cut(rows, window):
    first: dict = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = {}
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_substring_dedup_matches_brute_force(docs, corpus, window):
    found = substring_dedup.remove_repeats(docs, window).collect()
    assert len(found) == len(corpus)
    want = expected_cut([r[:2] for r in corpus], window)
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == want
    assert any(n for _, n, _ in want.values())


def test_substring_dedup_of_nothing_and_whole_rows(docs, nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    assert all(len(r["text"]) == r["n_chars"] for r in kept.where("text is not null").collect())


def test_rows_of_one_id_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(70))
    frame = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b + " tail")], "doc_id long, text string")
    found = sorted((r["id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(frame).collect())
    assert found == [(1, 60, 0), (2, 70, 0), (5, 60, 60), (5, 71, 70)]


@pytest.mark.parametrize("period", [2, 3, 7, 13, 31, 40])
def test_difference_covers(period):
    cover = substring_dedup.difference_cover(period).tolist()
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0bé z", max_size=40), max_size=6))
def test_blocks_split_like_bytes(texts):
    raw = [t.encode() for t in texts]
    block = wordblocks.Block(raw)
    assert block.n_words.tolist() == [len(t.split()) for t in raw]
    flat = [w for t in raw for w in t.split()]
    assert len(set(flat)) == len(set(block.hashes.tolist()))


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (22, 21), (7, 7), (9, 5)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {4: 3, 5: 3, 9: 3, 21: 20, 22: 20}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [10_000, 7])
def test_vectors_match_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((70, 16)).astype(np.float32)
    x[10:25] = x[3] + 0.08 * rng.standard_normal((15, 16)).astype(np.float32)
    x[30], x[31] = x[29], x[29] * 2
    rows = [(i, [float(v) for v in row], i % 3, 0.1) for i, row in enumerate(x)]
    odd = [(100, None, 0, 0.1), (101, [0.0] * 16, 0, 0.1), (102, [float("nan")] * 16, 0, 0.1), (103, [None] + [1.0] * 15, 0, 0.1), (104, [1.0], 0, 0.1), (105, [], 0, 0.1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n double")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = [(a, b) for a in range(70) for b in range(70) if a < b and u[a] @ u[b] >= 0.95]
    label = linked(list(range(70)), near)
    found = {r["id"]: (r["n_links"], r["component"], r["kept"]) for r in embedding_dedup.near_vectors(frame, 0.95, tile=tile).collect()}
    for i in range(70):
        assert found[i] == (sum(i in p for p in near), label[i], label[i] == i)
    for i in range(100, 106):
        assert found[i] == (0, i, True)
    assert near
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_repeated_and_nameless_vectors(spark):
    """Rows of one id are one vector; without an id nothing is linked."""
    e = [1.0, 0.0, 0.2]
    rows = [(5, e), (5, e), (7, e), (9, [0.99, 0.01, 0.2]), (None, e), (None, None), (11, None), (11, None), (12, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((repr(r["id"]), r["n_links"], r["component"], r["kept"]) for r in embedding_dedup.near_vectors(frame, 0.95).collect())
    want = [(5, 2, 5, True)] * 2 + [(7, 2, 5, False), (9, 2, 5, False), (11, 0, 11, True), (11, 0, 11, True), (12, 0, 12, True)]
    assert found == sorted([(repr(a), b, c, d) for a, b, c, d in want] + [("None", 0, None, True)] * 2)

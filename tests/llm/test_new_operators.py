"""Merkle manifest, whitening and multi-index against plain Python, numpy and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reefline.llm import merkle, multi_index, queries, whitening

NAN, INF = float("nan"), float("inf")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest
def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 16])) for i in range(0, len(below), 16)])
    return levels


def climb(levels, at, value):
    """(value at the top, siblings) of a node that is `value` now."""
    beside = []
    for level in levels[:-1]:
        run = level[at // 16 * 16:at // 16 * 16 + 16]
        slot = at % 16
        beside += run[:slot] + run[slot + 1:]
        value = sha("".join(run[:slot] + [value] + run[slot + 1:]))
        at //= 16
    return value, beside


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = sha("".join(part(v) for v in (doc_id, source, lang, n_chars, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        lower = None if text is None else "".join(c.lower() if c.isascii() else c for c in text)
        changed = sha("".join(part(v) for v in (doc_id, source, lang, n_chars, lower))) if hit else leaf
        trees[source].append((doc_id is not None, doc_id or 0, leaf, doc_id, changed))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: tree_levels([r[2] for r in sorted(trees[s])]) for s in names}
    outer = tree_levels([inner[s][-1][0] for s in names])
    root, out = outer[-1][0] if names else None, []
    for n, s in enumerate(names):
        for at, (_, _, leaf, doc_id, changed) in enumerate(sorted(trees[s])):
            up, beside = climb(inner[s], at, changed)
            folded, more = climb(outer, n, up)
            out.append((doc_id, leaf, inner[s][-1][0], root, "".join(beside + more), folded, folded == root))
    return Counter(out)


def check_manifest(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree int, position int, digest string, n int, changed int"
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], schema).repartition(4)
    got = merkle.manifest(merkle.tampered(docs), proofs=True).collect()
    assert all(r.proof_sha256 == sha(r.proof) for r in got)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in got) == brute_manifest(rows)


def test_manifest_of_edge_rows(spark, edge_rows, nothing):
    check_manifest(spark, [(r[0], r[3], r[2], r[4], r[1]) for r in edge_rows])
    check_manifest(spark, [(1, None, None, None, None)])
    check_manifest(spark, [(i, s, "en", i, f"Text {i}") for i, s in enumerate(["", None, "é", "z", "\U0001F600", "a"])])
    assert merkle.manifest(merkle.tampered(nothing)).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_over_several_tiers(spark, monkeypatch, levels):
    # the size of a chunk must not matter
    monkeypatch.setattr(merkle, "CHUNK_LEVELS", levels)
    monkeypatch.setattr(merkle, "CHUNK", 16 ** levels)
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, f"Some Text {i}") for i in range(900)]
    check_manifest(spark, rows + rows[:3])


def test_a_parent_resumes_its_states():
    children = [sha(str(i)).encode() for i in range(11)]
    parent = merkle.Parent(b"".join(children))
    assert parent.digest.decode() == sha(b"".join(children).decode())
    for slot in range(11):
        other = sha("other").encode()
        assert parent.fold(slot, other).decode() == sha(b"".join(children[:slot] + [other] + children[slot + 1:]).decode())
        assert parent.fold(slot, children[slot]) == parent.digest
        assert parent.siblings(slot) == b"".join(children[:slot] + children[slot + 1:])


# whitening
@pytest.mark.parametrize("low, high, rows", [(-200, 200, 130), (0, 1, 64), (-(1 << 40), 1 << 40, 70), (5, 5, 3), (-(1 << 62), 1 << 62, 9)])
def test_bit_sliced_products_are_exact(low, high, rows):
    rnd = random.Random(rows)
    x = np.array([[rnd.randint(low, high) for _ in range(5)] for _ in range(rows)], np.int64)
    sums, cross = whitening.block_moments(x)
    exact = [[int(v) for v in r] for r in x]
    assert [int(s) for s in sums] == [sum(r[j] for r in exact) for j in range(5)]
    for i in range(5):
        for j in range(i, 5):
            assert int(cross[i, j]) == sum(r[i] * r[j] for r in exact)


def check_whitening(spark, rows, schema="vec_id long, vec array<double>, n int, dim int, whitened int, x int"):
    got = whitening.whiten(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema).repartition(3)).collect()
    usable = [(i, v) for i, v in rows if v and all(c is not None and abs(c) < INF for c in v)]
    lengths = {len(v) for _, v in usable}
    assert len(got) == sum(min(8, len(v)) for _, v in usable)
    for d in lengths:
        mine = [(i, v) for i, v in usable if len(v) == d]
        x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in mine], object)
        n, sums = len(mine), x.sum(0)
        cov = np.array([[int(a) for a in r] for r in n * x.T.dot(x) - np.outer(sums, sums)], float) / n / n
        e = np.linalg.eigvalsh(cov)[::-1]
        want = Counter((i, int(((n * r - sums) ** 2).sum())) for (i, _), r in zip(mine, x))
        part_of = [r for r in got if r.n == n and r.component <= min(8, d)] if len(lengths) == 1 else [r for r in got if r.n == n]
        assert Counter((r.vec_id, int(r.deviation)) for r in part_of if r.component == 1) == want
        for r in part_of:
            if e.sum() > 0:
                assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9
            assert r.identity_error is None or r.identity_error < 1e-6
    return got


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 12)) * np.linspace(0.1, 2, 12))]
    rows += [rows[0], rows[0], (None, rows[1][1])]  # repeats and null ids count each for itself
    got = check_whitening(spark, rows + [(900, None), (901, [1.0, None] * 6), (902, [NAN] * 12), (903, [INF] * 12), (904, [])])
    x = np.array([[np.floor(1024 * c) + 100000 for c in v] for _, v in rows])
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    white = (x - x.mean(0)) @ v[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    mine = defaultdict(dict)
    for r in got:
        mine[r.vec_id][r.component - 1] = r.whitened
    for i in (5, 77, 300):
        for c in range(8):
            assert abs(abs(mine[i][c]) - abs(white[i, c])) < 1e-9
    # one sign for all rows
    signs = {c: {np.sign(mine[i][c] * white[i, c]) for i in range(2, 400)} for c in range(8)}
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_variance_and_with_lengths_of_their_own(spark):
    flat = check_whitening(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])
    assert all(r.whitened is None and r.identity_error is None and r.deviation == 0 for r in flat)
    line = check_whitening(spark, [(i, [float(i), 1.0, float(-i)]) for i in range(6)])
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    check_whitening(spark, [(i, [float(i % 7), float(i * i % 5)]) for i in range(20)] + [(50 + i, [float(i)]) for i in range(9)])
    check_whitening(spark, [(1, [1.0]), (2, [1e12])])
    none = spark.createDataFrame([], "vec_id long, vec array<float>")
    assert whitening.whiten(none).count() == 0


# multi-index
def brute_nearest(rows, ask, k):
    found = {}
    for q, v in ask.items():
        scores = [(-float(np.dot(v, c)), i) for i, c in set((i, tuple(c)) for i, c in rows) if i != q and len(c) == len(v)]
        found[q] = sorted(scores)[:k]
    return found


def usable_rows(rows):
    return [(i, v) for i, v in rows if i is not None and v and any(c for c in v) and all(c is not None and abs(c) < INF for c in v)]


def frame(spark, rows, name):
    return spark.createDataFrame([(i, v, 7, 8, 9) for i, v in rows], f"{name} long, vec array<double>, first int, copy int, dim int").repartition(3)


def vectors(count, dim, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in v]) for i, v in enumerate(rng.integers(-8, 9, size=(count, dim)))]


def test_search_of_all_cells_is_exact(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SLICE_ROWS", 64)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 8)
    rows = vectors(500, 6) + [(1000 + i, [3.0] * 6) for i in range(60)] + [(5, [3.0] * 6)]
    rows += [rows[0], (None, [1.0] * 6), (2000, None), (2001, []), (2002, [0.0] * 6), (2003, [NAN] * 6), (2004, [None] * 6), (2005, [INF] * 6), (2006, [1.0, 2.0]), (2007, [5.0])]
    good = usable_rows(rows)
    ask = [(i, v) for i, v in rows if i is None or i % 9 == 0 or i in (5, 1030, 2006, 2007) or i > 2001]
    least = {}
    for i, v in usable_rows(ask):
        least[i] = min(least.get(i, (len(v), v)), (len(v), v))
    want = brute_nearest(good, {i: v for i, (_, v) in least.items()}, 10)
    got = defaultdict(list)
    for r in multi_index.search(frame(spark, rows, "vec_id"), frame(spark, ask, "query_id"), 10, share=1.0).collect():
        got[r.query_id].append((r["rank"], -r.score, r.vec_id))
    assert {q: [x[1:] for x in sorted(g)] for q, g in got.items()} == {q: g for q, g in want.items() if g}
    assert all([x[0] for x in sorted(g)] == list(range(1, len(g) + 1)) for g in got.values())


def test_search_of_few_or_no_vectors(spark):
    none = frame(spark, [], "vec_id")
    assert multi_index.search(none, none.withColumnRenamed("vec_id", "query_id"), 5).count() == 0
    two = [(1, [1.0, 0.0]), (2, [2.0, 1.0])]
    got = multi_index.search(frame(spark, two, "vec_id"), frame(spark, two, "query_id"), 5).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(1, 1, 2, 2.0), (2, 1, 1, 2.0)}


def test_cells_come_by_falling_sum():
    rng = np.random.default_rng(2)
    index = multi_index.MultiIndex(rng.normal(size=(900, 10)), 10)
    for query in rng.normal(size=(5, 10)):
        cells = list(index.cells(query, 1.0))
        sums = [(index.left @ query[:5])[c // len(index.right)] + (index.right @ query[5:])[c % len(index.right)] for c in cells]
        assert sorted(cells) == sorted(np.flatnonzero(index.sizes)) and all(a >= b - 1e-12 for a, b in zip(sums, sums[1:]))


def test_recall_on_the_given_vectors(spark, sample_dir):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sample_dir}/embeddings.parquet").collect()]
    want = brute_nearest(rows, {i: v for i, v in rows if i % 20 == 0}, 20)
    got = queries.op13_multi_index(spark, sample_dir).collect()
    by_query = defaultdict(set)
    for r in got:
        by_query[r.query_id].add(r.vec_id)
    assert set(by_query) == set(want) and len(got) == 20 * len(want)
    assert sum(len(by_query[q] & {i for _, i in w}) for q, w in want.items()) / (20 * len(want)) >= 0.9
    exact = dict(rows)
    assert all(abs(r.score - np.dot(exact[r.query_id], exact[r.vec_id])) < 1e-12 for r in got)


def test_whitening_query(spark, sample_dir):
    got = queries.op12_embedding_whitening(spark, sample_dir)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9 and got.count() == 4000

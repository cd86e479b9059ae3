"""Exact dedup, MinHash near-dedup, suffix sort and recompression against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reefline.llm import exact_dedup, fuse_filter, minhash, recompression, repeats, suffix_sort, union_find
from reefline.llm.superminhash import signatures


def test_fuse_filter_holds_its_keys_and_few_others():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 100, 20_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        made = fuse_filter.build(np.concatenate([keys, keys]))
        assert fuse_filter.contains(keys, *made).all()
        others = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
        assert fuse_filter.contains(others, *made).mean() < 0.03


def check_exact(rows, groups):
    members = defaultdict(list)
    for doc_id, text in rows:
        members[text or ""].append(doc_id)
    want = Counter()
    for text, ids in members.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            want[i, hashlib.sha256(text.encode()).digest(), keep, len(ids), i == keep] += 1
    got = Counter((r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in groups.collect())
    if isinstance(next(iter(got), (0, b""))[1], bytes) and all(len(k[1]) == 32 for k in got):
        assert got == want
    else:
        assert Counter(k[:1] + k[2:] for k in got.elements()) == Counter(k[:1] + k[2:] for k in want.elements())


def test_exact_groups(edge, edge_rows):
    check_exact([r[:2] for r in edge_rows], exact_dedup.group_documents(edge))


def test_exact_groups_when_digests_collide(edge, edge_rows):
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    check_exact([r[:2] for r in edge_rows], exact_dedup.group_documents(edge, weak))


def test_exact_screen_uses_every_shard(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 16)
    rows = [(i, f"text {i % 150}") for i in range(400)]
    check_exact(rows, exact_dedup.group_documents(spark.createDataFrame(rows, "doc_id long, text string")))


def test_exact_deduplicate(edge, edge_rows, nothing):
    kept = exact_dedup.deduplicate(edge)
    assert kept.columns == edge.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in edge_rows})
    assert exact_dedup.deduplicate(nothing).count() == 0
    assert exact_dedup.group_documents(nothing).count() == 0


def shingle_set(text, width):
    found = (text or "").encode().lower().split()
    return {tuple(found)} if 0 < len(found) < width else {tuple(found[i:i + width]) for i in range(len(found) - width + 1)}


def near_components(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return Counter((doc_id, len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def check_near(df, rows, rule):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, rule).collect())
    assert got == near_components(rows, rule.width, rule.percent)


@pytest.mark.parametrize("rule", [minhash.Rule(), minhash.Rule(width=3, percent=85)])
def test_near_duplicates(edge, edge_rows, rule):
    check_near(edge, [r[:2] for r in edge_rows], rule)


def test_near_duplicates_in_a_large_group(spark):
    """One base text with random edits: more copies than a plain bucket, many of them not linked."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(140):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            copy[at] = f"e{rng.randrange(10 ** 6)}"
        rows.append((1000 - i, " ".join(copy)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, minhash.Rule(width=3, percent=85))


def pairs_looked_at(monkeypatch):
    """Counts of the pair tables that the grouping writes."""
    counts, write = Counter(), minhash.stored

    def count(df, name):
        out = write(df, name)
        if name in ("likely", "near", "last"):
            counts[name] += out.count()
        return out
    monkeypatch.setattr(minhash, "stored", count)
    return counts


def test_near_duplicates_compare_few_pairs_of_a_crowd(spark, monkeypatch):
    """Unlinked documents with common boilerplate, and edited copies: pairs grow with documents, not their square."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(2000):
        own = [f"u{rng.randrange(10 ** 7)}" for _ in range(rng.randrange(12, 60))]
        rows.append((i, " ".join(base + own)))
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 7)):
            copy[at] = f"e{rng.randrange(10 ** 7)}"
        rows.append((5000 - i, " ".join(copy)))
    counts = pairs_looked_at(monkeypatch)
    rule = minhash.Rule(width=3, percent=85)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = minhash.near_duplicates(df, rule).collect()
    # the brute force of check_near is too slow here: numbers for shingles, then one product
    names, sets = {}, [shingle_set(t, 3) for _, t in rows]
    held = np.zeros((len(rows), len({s for x in sets for s in x})), np.float32)
    for i, x in enumerate(sets):
        held[i, [names.setdefault(s, len(names)) for s in x]] = 1
    common, sizes = held @ held.T, held.sum(1)
    label = np.array([r[0] for r in rows])
    linked = 100 * common >= 85 * (sizes[:, None] + sizes[None, :] - common)
    while True:
        lower = np.array([label[x].min() for x in linked])
        if (lower == label).all():
            break
        label = lower
    assert {r.doc_id: r.component_id for r in got} == {i: c for (i, _), c in zip(rows, label.tolist())}
    assert len(set(label.tolist())) > 100 and counts["near"] > 0
    assert sum(counts.values()) < 8 * len(rows)


def test_near_duplicates_that_a_pivot_leaves_apart(spark):
    """Copies that share their edits link with each other, not with the pivot."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows, at = [], 0
    for family in range(12):
        changed = list(base)
        for place in rng.sample(range(150), 6):
            changed[place] = f"f{family}-{place}"
        for _ in range(12):
            copy = list(changed)
            for place in rng.sample(range(150), rng.randrange(0, 3)):
                copy[place] = f"e{rng.randrange(10 ** 6)}"
            rows.append((at, " ".join(copy)))
            at += 1
    rule = minhash.Rule(width=3, percent=85)
    check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, rule)
    monkey = pytest.MonkeyPatch()
    with monkey.context() as m:
        m.setattr(minhash, "PLAIN_BUCKET", 2)
        check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, rule)


def test_near_deduplicate(edge, nothing):
    kept = minhash.deduplicate(edge)
    assert kept.columns == edge.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and 2 not in ids and 3 not in ids and ids[8] == 1 and ids[5] == 1 and ids[4] == 1
    assert minhash.deduplicate(nothing).count() == 0
    assert minhash.near_duplicates(nothing).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, one, two = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 60, 60))
    a, b = signatures(np.concatenate([common, one, common, two]), np.array([360, 360]), 512)
    assert abs((a == b).mean() - 300 / 420) < 0.07
    tiny = signatures(np.array([7, 7, 9], np.uint64), np.array([1, 2]), 64)
    assert (tiny < np.iinfo(np.uint64).max).all() and (tiny[1] <= tiny[0]).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)]
    parent = {n: n for pair in links for n in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    rng.shuffle(links)
    got = {r.node: r.label for r in union_find.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {n: find(n) for n in parent if n != 5000 and any(n in p and p[0] != p[1] for p in links)}
    assert union_find.components(spark.createDataFrame([], "a long, b long")).count() == 0


def bytes_removed(rows, width):
    starts = Counter()
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    for _, d in data:
        starts.update(d[i:i + width] for i in range(len(d) - width + 1))
    out = []
    for doc_id, d in data:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if starts[d[i:i + width]] > 1:
                gone[i:i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return Counter(out)


def words_removed(rows, width):
    data = [(doc_id, (text or "").encode().split()) for doc_id, text in rows]
    first = {}
    order = lambda doc_id: repeats.NO_ID if doc_id is None else doc_id
    for doc_id, found in data:
        for i in range(len(found) - width + 1):
            w = tuple(found[i:i + width])
            first[w] = min(first.get(w, repeats.NO_ID), order(doc_id))
    out = []
    for doc_id, found in data:
        gone = [False] * len(found)
        for i in range(len(found) - width + 1):
            if first[tuple(found[i:i + width])] < order(doc_id):
                gone[i:i + width] = [True] * width
        out.append((doc_id, len(found), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(found, gone) if not g)).hexdigest()))
    return Counter(out)


def check_bytes(df, rows, width=200):
    got = suffix_sort.remove_repeated_bytes(df, width).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == bytes_removed(rows, width)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def check_words(df, rows, width=13):
    got = recompression.remove_repeated_words(df, width).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == words_removed(rows, width)


def test_repeats_in_edge_cases(edge, edge_rows, nothing):
    rows = [r[:2] for r in edge_rows]
    check_bytes(edge, rows)
    check_words(edge, rows)
    assert suffix_sort.remove_repeated_bytes(nothing).count() == 0
    assert recompression.remove_repeated_words(nothing).count() == 0


def shared_passages(seed, docs=40):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(400)}" for _ in range(rng.randrange(12, 60))] for _ in range(6)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randrange(1, 6)):
            text += [f"u{rng.randrange(3000)}" for _ in range(rng.randrange(0, 30))]
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2)
            text += p[cut:] if rng.random() < 0.5 else p[:len(p) - cut]
            text += [rng.choice("ab")] * rng.randrange(0, 20)
        rows.append((rng.randrange(10 ** 6), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_shared_passages(spark, seed):
    rows = shared_passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_bytes(df, rows, 64)
    check_bytes(df, rows, 90)
    check_words(df, rows)


@pytest.mark.parametrize("rule", [suffix_sort.rule(80), recompression.rule(13)])
def test_crowded_keys_give_the_same(spark, rule):
    df = spark.createDataFrame(shared_passages(4), "doc_id long, text string").repartition(3)

    def covered(found):
        return {(r.ord, r.thash): [i for i, c in enumerate(repeats.mask(20_000, r.starts, r.ends)) if c] for r in found.collect()}
    assert covered(repeats.covers(df, rule, crowded=3)) == covered(repeats.covers(df, rule))


def test_long_texts_are_cut_into_overlapping_pieces():
    pieces = repeats._segments(np.array([5, 100]), 4, limit=30)
    starts = [set(range(a, b - 3)) for i, a, b in pieces if i == 1]
    assert sorted(x for s in starts for x in s) == list(range(97)) and pieces[0] == (0, 0, 5)

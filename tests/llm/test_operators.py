"""Top-k, packing, sharding, chat, mixing and quality against plain Python and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reefline.llm import chat, mixing, packing, quality, sharding, topk
from reefline.llm.common import running_totals
from reefline.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


# top-k
def brute_top(vectors, queries, k):
    out = []
    for q, v in {(q, tuple(v)) for q, v in queries if q is not None and v}:
        scores = [(-sum(a * b for a, b in zip(v, c)), i) for i, c in vectors
                  if i is not None and c and len(c) == len(v) and i != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def check_top(spark, vectors, queries, k=5):
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, vec array<long>, extra int" if len(rows[0]) > 2
                                                  else f"{name} long, vec array<long>")
    got = topk.top_k(df(vectors, "vec_id"), df(queries, "query_id"), k).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(vectors, queries, k)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = random.Random(1)
    vectors = [(i, [rng.randrange(-40, 40) for _ in range(6)]) for i in range(200)]
    vectors += [(1000 + i, [3, 3, 3, 3, 3, 3]) for i in range(40)] + [(7, None), (8, []), (None, [1] * 6), (300, [1, 2])]
    vectors += [vectors[0], (400, [10 ** 7] * 6)]
    queries = [v for v in vectors if v[0] is None or v[0] % 5 == 0]
    check_top(spark, vectors, queries)


def test_top_k_of_few_vectors_and_wide_values(spark):
    check_top(spark, [(1, [1 << 30, 1]), (2, [-(1 << 30), 5])], [(1, [1 << 30, 1]), (9, [1, 0])])
    none = spark.createDataFrame([], "vec_id long, vec array<long>")
    assert topk.top_k(none, none.withColumnRenamed("vec_id", "query_id"), 5).count() == 0


def test_quantised(spark):
    rows = [([0.5, -0.001, 1.0],), (None,), ([1.0, None],), ([float("nan")],), ([float("inf")],), ([],)]
    df = spark.createDataFrame(rows, "v array<float>").select(topk.quantised(F.col("v")).alias("q"))
    assert [r.q for r in df.collect()] == [[128, -1, 256], None, None, None, None, []]


# packing
def check_pack(df, rows, window):
    coder = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = Counter((doc_id, tuple(coder.encode(text or "", add_special_tokens=False).ids + [2])) for doc_id, text in rows)
    pieces = packing.pack(df, tokenizer_path(), window).collect()
    places = defaultdict(list)
    by_doc = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) > 0
        places[p.sequence_id].append((p.offset, p.length))
        # copies of one id are told apart by where they start in the whole
        by_doc[p.doc_id, p.sequence_id * window + p.offset - p.start].append(p)
    got = Counter()
    for (doc_id, _), parts in by_doc.items():
        ids = []
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == len(ids)
            ids += p.ids
        assert all(p.doc_tokens == len(ids) for p in parts)
        got[doc_id, tuple(ids)] += 1
    assert got == want
    last = max(places, default=0)
    assert sorted(places) == list(range(last + 1 if places else 0))
    for sequence, parts in places.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or sequence == last and at <= window


def test_pack(edge, edge_rows, nothing):
    rows = [r[:2] for r in edge_rows]
    check_pack(edge, rows, packing.WINDOW)
    check_pack(edge, rows, 64)
    assert packing.pack(nothing, tokenizer_path(), digests=True).count() == 0


def test_sequences_and_digests(edge):
    pieces = packing.pack(edge, tokenizer_path(), 64)
    whole = {r.sequence_id: r for r in packing.sequences(pieces, 64).collect()}
    last = max(whole)
    assert all(len(r.ids) == 64 for s, r in whole.items() if s != last or r.tokens & (r.tokens - 1))
    sums = {(r.sequence_id, r.offset): r for r in packing.pack(edge, tokenizer_path(), 64, digests=True).collect()}
    for (sequence, offset), r in sums.items():
        ids = np.array(whole[sequence].ids[offset:offset + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_chunk_tokens_equal_the_tokenizer():
    coder = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = ["", " ", "a  b\n\tc", "Don't WE'LL o'clock's 12a3 '", "<|endoftext|> a<|endoftext|>b", "É é x y\x1cz İSTANBUL ΣΑΣ's",
             "ß É¿ÿ×÷ÀÇé cafés é 1é2 Ÿ 　 漢字", "z" * 3000, "--!!..a-b"] * 2
    ids, counts = packing.ChunkTokens(tokenizer_path(), 2).encode(texts)
    want = [coder.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_each_distinct_chunk_is_looked_up_once_a_batch(monkeypatch):
    coder, asked = packing.ChunkTokens(tokenizer_path(), 2), []
    find = coder.chunks.find
    monkeypatch.setattr(coder.chunks, "find", lambda keys: asked.extend(keys) or find(keys))
    texts = ["surf  shark\x0breef\x0c" * 500, "", "reef surf"]
    ids, counts = coder.encode(texts)
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    # twice when new: to see that it is, and for its row
    assert set(asked) <= {"surf", "shark", "reefsurf", "reef", ""} and len(asked) <= 10


def test_running_totals(spark):
    rows = [(i * 7, i % 5 + 1) for i in range(3000)]
    got = running_totals(spark.createDataFrame(rows, "k long, v long"), "k", "v", "before", block=16).collect()
    total = np.cumsum([v for _, v in rows])
    assert {r.k: r.before for r in got} == {k: int(t) - v for (k, v), t in zip(rows, total)}


# sharding
def test_hypergeometric_law():
    rng, n = random.Random(4), 4000
    drawn = [sharding.hypergeometric(rng, 30, 50, 20) for _ in range(n)]
    assert abs(np.mean(drawn) - 20 * 30 / 80) < 0.15 and abs(np.var(drawn) - 20 * .375 * .625 * 60 / 79) < 0.3
    assert all(0 <= d <= 20 for d in drawn) and sharding.hypergeometric(rng, 0, 5, 3) == 0
    assert sharding.hypergeometric(rng, 5 * 10 ** 10, 5 * 10 ** 10, 10 ** 6) == pytest.approx(5 * 10 ** 5, rel=0.02)


def test_communication_matrix():
    rows = [5, 0, 17, 40, 3]
    matrix = sharding.communication_matrix(rows, 8, 1)
    assert [sum(line) for line in matrix] == rows
    assert sorted(map(sum, zip(*matrix))) == [8] * 7 + [9]


def test_shuffle_into_shards(edge, edge_rows, nothing, spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 3)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    for df in (edge, spark.range(1000).repartition(7)):
        rows = sharding.shuffle_into_shards(df).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        n = df.count()
        assert {len(s) for s in slots.values()} <= {n // 8, n // 8 + 1} and set(slots) <= set(range(8))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r.id for r in rows) == Counter(range(1000))
    out = sharding.shuffle_into_shards(edge)
    assert {"input_shard", "input_slot"} < set(out.columns) and out.filter("text is null").count() == 2
    assert sharding.shuffle_into_shards(nothing).count() == 0


def test_shuffle_is_uniform(spark):
    """Each row is about as likely in each shard, and neighbours part."""
    together = 0
    hits = Counter()
    for seed in range(12):
        rows = sharding.shuffle_into_shards(spark.range(0, 240, 1, 3), 4, seed).collect()
        at = {r.id: r.shard for r in rows}
        together += sum(at[i] == at[i + 1] for i in range(239))
        hits.update((i < 80, s) for i, s in at.items())
    assert abs(together / (12 * 239) - 59 / 239) < 0.04
    assert all(abs(hits[True, s] - 240) < 60 for s in range(4))


# chat
def test_layouts_give_the_same_turns(spark):
    want = [("system", "s"), ("user", "q"), ("assistant", "a")]
    records = [
        '{"prompt": "q", "response": "a", "system": "s", "extra": {"x": 1}}', '{"instruction": "q", "output": "a", "system": "s"}',
        '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        '{"conversations": [{"from": "system", "value": "s"}, {"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"instruction": "q", "input": "more", "output": "a"}', '{"prompt": "q"}', '{"unknown": 3}', '{"messages": []}']
    df = spark.read.json(spark.sparkContext.parallelize(records, 1))
    got = [(r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).collect()]
    assert got[:4] == [("prompt_response", want), ("instruction", want), ("messages", want), ("from_value", want)]
    assert got[4] == ("instruction", [("user", "q\nmore"), ("assistant", "a")])
    assert got[5:] == [(None, None)] * 3


def test_format_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\", "<\\", "[\\[<", "", None, "x[:]y\n</s>", "é\U0001F600" * 3, "long " * 20_000, "<s>" * 4]
    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "odd[:]\nrole</s>"]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None]), rng.choice(roles), rng.choice(texts), 1, "z") for _ in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int, layout string").repartition(3)
    out = chat.read_back(chat.format_turns(chat.canonical_turns(chat.records(df)))).collect()
    talks = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert len(out) == len(talks)
    for r in out:
        want = [(role, text) for _, _, role, text in sorted(talks[r.conv_id])]
        assert [tuple(t) for t in r.read_turns] == want
        assert r.loss_text == "".join(text for role, text in want if role == "assistant")
    empty = df.filter("false")
    assert chat.read_back(chat.format_turns(chat.canonical_turns(chat.records(empty)))).count() == 0


# mixing
def test_level():
    assert mixing.level(150, [50, 50], [1, 1]) == [75, 75]
    assert mixing.level(150, [10, 90], [3, 1]) == [20, 130]
    assert mixing.level(0, [0, 0], [3, 1]) == [0, 0]
    assert mixing.level(0, [], []) == []


def test_route_repeats_only_when_nothing_fresh_is_left():
    p = [mixing.Pattern("a", ("a",), 10, {}), mixing.Pattern("ab", ("a", "b"), 10, {}), mixing.Pattern("b", ("b",), 5, {})]
    mixing.route(p, {"a": 12, "b": 13})
    assert [sum(x.flow.values()) for x in p] == [10, 10, 5] and p[1].flow == {"a": 2, "b": 8}
    mixing.route(p, {"a": 40, "b": 0})
    assert p[0].flow["a"] + p[1].flow["a"] == 40 and p[2].flow["b"] == 0
    mixing.route(p, {"a": 100, "b": 100})
    assert sum(sum(x.flow.values()) for x in p) == 50


def test_mix(edge, edge_rows, nothing):
    rows = mixing.mix(edge, F.array("source")).collect()
    sizes = defaultdict(int)
    for r in edge_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    taken, targets = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        source = None if r.pattern == "n" else r.pattern[1:]
        assert r.source_size == sizes[source]
        targets[source] = r.target
        taken[source] += r.taken
        assert [a.words for a in r.allocated] == [r.taken]
    assert all(abs(taken[s] - t) < 1 for s, t in targets.items()) and len(rows) == len(edge_rows)
    again = mixing.mix(edge.repartition(5), F.array("source")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_hash, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(nothing, F.array("source")).count() == 0


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice([["a"], ["a", "b"], ["b", "a"], ["c"], []])) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, s array<string>"), F.col("s")).collect()
    assert {r.pattern for r in got} == {"sa", "sa\0sb", "sc", ""}
    for r in got:
        assert sum(a.words for a in r.allocated) == r.taken <= 2 * r.size
        assert r.pattern or r.taken == 0


def test_materialise(edge):
    whole = mixing.materialise(edge, mixing.mix(edge, F.array("source")))
    assert whole.columns == edge.columns
    times = Counter((r.doc_id, r.text) for r in whole.collect())
    assert max(times.values()) <= 4 and not any(not (t or "").split() for _, t in times)


# quality
def test_quality_on_held_out_documents(spark, sample_dir):
    sample = sample_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    labels = spark.read.parquet(f"{sample}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    weights = quality.fit(docs, labels.filter(~held))
    rows = quality.score(docs.select("doc_id", "text"), weights).join(labels.filter(held), "doc_id").collect()
    good = [r.score >= quality.THRESHOLD for r in rows if r.label == 1]
    bad = [r.score < quality.THRESHOLD for r in rows if r.label == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.6


def test_quality_edge_cases(edge, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (13, 0), (14, 0), (None, 1), (2, None), (99, 1)], "doc_id long, label int")
    weights = quality.fit(edge, labels)
    scores = quality.score(edge.select("doc_id", "text"), weights)
    assert scores.count() == edge.count() and scores.filter("score is null or score < 0 or score > 1").count() == 0
    kept = quality.accept(edge, weights, 0.5)
    assert kept.columns == edge.columns and 0 < kept.count() < edge.count()
    assert (quality.fit(nothing, labels) == 0).all()
    assert quality.score(nothing.select("doc_id", "text"), weights).count() == 0


def test_training_does_not_depend_on_row_order(edge, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 16)], "doc_id long, label int")
    assert (quality.fit(edge, labels) == quality.fit(edge.repartition(7), labels)).all()

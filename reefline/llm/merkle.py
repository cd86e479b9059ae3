"""A Merkle manifest of a table whose parents keep a copied hash state before each child.

The rows of a tree (here: of a source) are its leaves, in the order of their key.  Every 16
consecutive nodes become their hash, until one is left; the roots of all trees are the leaves of
one more tree.  A parent hashes its children one after the other and keeps a copy of the state
before each of them, so a changed child costs the hash of itself and of what stands right of it.

Three levels at a time are built in one task (up to 4,096 nodes, whatever the tree's size); the
tops of those chunks are the nodes of the next three levels, and so on.  A chunk gets its way to
the root as one small row, so no task ever holds a tree.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reefline.functions.frames import rank_within
from reefline.llm.common import stored

ARITY = 16
CHUNK_LEVELS = 3
CHUNK = ARITY ** CHUNK_LEVELS
DIGEST = 64
STEP = "struct<slot:int,children:string>"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_hash(values: list[Column]) -> Column:
    """Hash of the values, each `-` if null, else its length in bytes, a colon and itself."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def levels_over(nodes: int) -> int:
    """How often `nodes` are hashed in runs until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


class Parent:
    """A run of children with the hash state before each of them."""

    def __init__(self, children: bytes):
        self.children = children
        self.states, state = [], hashlib.sha256()
        for at in range(0, len(children), DIGEST):
            self.states.append(state.copy())
            state.update(children[at:at + DIGEST])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in one slot: resume before it, go on to its right."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(self.children[(slot + 1) * DIGEST:])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return self.children[:slot * DIGEST] + self.children[(slot + 1) * DIGEST:]


def build(digests: list[bytes], levels: int) -> list[list[Parent]]:
    """The parents over some nodes, level by level."""
    out = []
    for _ in range(levels):
        out.append([Parent(b"".join(digests[i:i + ARITY])) for i in range(0, len(digests), ARITY)])
        digests = [p.digest for p in out[-1]]
    return out


def _grown(rows: pa.Table) -> tuple[list[bytes], list[list[Parent]]]:
    """Digests of a chunk in order, and its parents; `rows` are sorted by position."""
    digests = [d.encode() for d in rows.column("digest").to_pylist()]
    whole = rows.column("n")[0].as_py()
    return digests, build(digests, levels_over(whole) if whole <= CHUNK else CHUNK_LEVELS)


def _top(key: tuple, rows: pa.Table) -> pa.Table:
    digests, levels = _grown(rows.sort_by("position"))
    whole = -(-rows.column("n")[0].as_py() // CHUNK)
    top = levels[-1][0].digest if levels else digests[0]
    return pa.table({"tree": [key[0].as_py()], "position": [key[1].as_py()], "n": [whole], "digest": [top.decode()]})


def _ways(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
    """Each node's steps to the root of its tree: its slot in every parent, and that parent's children."""
    if not rows.num_rows:
        return rows.schema.empty_table()
    rows = rows.sort_by("position")
    _, levels = _grown(rows)
    onward, root = above.column("way")[0].as_py(), above.column("root")[0].as_py()
    positions, ways = rows.column("position").to_pylist(), []
    for place in range(len(positions)):
        way = []
        for level in levels:
            parent, slot = divmod(place, ARITY)
            way.append({"slot": slot, "children": level[parent].children.decode()})
            place = parent
        ways.append(way + onward)
    step = pa.struct([("slot", pa.int32()), ("children", pa.string())])
    return pa.table({"tree": rows.column("tree"), "position": rows.column("position"),
                     "root": pa.array([root] * len(ways), pa.string()), "way": pa.array(ways, pa.list_(step))})


WAY = f"tree long, position long, root string, way array<{STEP}>"


def _chunks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("position") / CHUNK))


def ways_up(nodes: DataFrame) -> DataFrame:
    """tree, position (of the chunk), root, way: from the top of each chunk of nodes to its tree's root.

    `nodes` has tree, position (gapless from 0), n (nodes of the tree) and digest.  Each round
    leaves one node of 4,096; only the largest tree's size comes to the driver.
    """
    tops = stored(_chunks(nodes).groupBy("tree", "chunk").applyInArrow(
        _top, "tree long, position long, n long, digest string"), "tops")
    if (tops.agg(F.max("n")).first()[0] or 0) <= 1:
        return tops.select("tree", "position", F.col("digest").alias("root"),
                           F.array().cast(f"array<{STEP}>").alias("way"))
    return _chunks(tops).groupBy("tree", "chunk").cogroup(
        ways_up(tops).withColumnRenamed("position", "chunk").groupBy("tree", "chunk")).applyInArrow(_ways, WAY)


PROVED = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean, proof string")


def _prove(key: tuple, rows: pa.Table, above: pa.Table, proofs: bool) -> pa.Table:
    """Every leaf of a chunk followed to the root, as it is now (`changed`) among its old siblings."""
    rows = rows.sort_by("position")
    _, levels = _grown(rows)
    count = rows.num_rows
    values = [(c or d).encode() for c, d in zip(rows.column("changed").to_pylist(), rows.column("digest").to_pylist())]
    kept = [hashlib.sha256() for _ in range(count)]
    texts: list[list[bytes]] = [[] for _ in range(count)] if proofs else []
    subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
    upper = [([Parent(s["children"].encode())], s["slot"]) for s in above.column("way")[0].as_py()]
    places = list(range(count))
    for parents, only_slot in [*((level, None) for level in levels), *upper]:
        # untouched leaves meet in the same value, which is folded once a slot
        folded: dict[tuple[int, bytes], bytes] = {}
        beside: dict[int, bytes] = {}
        for row, place in enumerate(places):
            at, slot = divmod(place, ARITY) if only_slot is None else (0, only_slot)
            parent = parents[at]
            if place not in beside:
                beside[place] = parent.siblings(slot)
            kept[row].update(beside[place])
            if proofs:
                texts[row].append(beside[place])
            known = (place, values[row])
            if known not in folded:
                folded[known] = parent.fold(slot, values[row])
            values[row], places[row] = folded[known], at
    ends = [v.decode() for v in values]
    return pa.table({
        "doc_id": rows.column("doc_id"), "leaf": rows.column("digest"),
        "subroot": pa.array([subroot] * count, pa.string()), "root": pa.array([root] * count, pa.string()),
        "proof_sha256": pa.array([k.hexdigest() for k in kept], pa.string()),
        "folded_root": pa.array(ends, pa.string()), "verified": pa.array([e == root for e in ends], pa.bool_()),
        "proof": pa.array([b"".join(t).decode() for t in texts] if proofs else [None] * count, pa.string())})


def leaves(docs: DataFrame, fields: list[str] = FIELDS, tree: str = "source", key: str = "doc_id",
           changes: dict[str, Column] | None = None, changed_where: Column | None = None) -> DataFrame:
    """tree, key, leaf and, where `changed_where` holds, the leaf with the `changes` made to its fields.

    Other columns play no part, whatever their names.
    """
    made = changes or {}
    touched = leaf_hash([made.get(f, F.col(f)) for f in fields]) if made else F.lit(None).cast("string")
    where = changed_where if changed_where is not None else F.lit(bool(made))
    return docs.select(F.col(tree).alias("tree_name"), F.col(key).cast("long").alias("doc_id"),
                       leaf_hash([F.col(f) for f in fields]).alias("digest"), F.when(where, touched).alias("changed"))


def manifest(leaf_rows: DataFrame, proofs: bool = False) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and proof).

    Leaves of a tree ascend by doc_id, nulls first, equal ids by leaf.  Trees ascend by name, null
    first, bytewise; a null and an empty name are two trees.  Rows that repeat are leaves of their
    own.  `folded_root` is recomputed from the changed leaf, or the leaf itself, and the siblings as
    they were; `proof` (the siblings one after the other) is only filled if asked for.  An empty
    table has no root and gives no rows.
    """
    counted = leaf_rows.groupBy("tree_name").agg(F.count(F.lit(1)).alias("n"))
    trees = stored(rank_within(counted.withColumn("_all", F.lit(0)), "_all", ["tree_name"], "_rank").select(
        "tree_name", (F.col("_rank") - 1).cast("long").alias("tree"), "n"), "trees")
    names = trees.withColumnRenamed("tree_name", "_name")
    placed = leaf_rows.join(names, F.col("tree_name").eqNullSafe(F.col("_name"))).drop("_name", "tree_name")
    nodes = stored(rank_within(placed, "tree", ["doc_id", "digest"], "_rank").withColumn(
        "position", (F.col("_rank") - 1).cast("long")).drop("_rank"), "leaves")
    inner = stored(ways_up(nodes), "ways").withColumnRenamed("root", "subroot")
    many = trees.count()
    subroots = inner.filter("position = 0").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), F.lit(many).cast("long").alias("n"),
        F.col("subroot").alias("digest"))
    over = _chunks(subroots).groupBy("tree", "chunk").cogroup(ways_up(subroots).withColumnRenamed(
        "position", "chunk").groupBy("tree", "chunk")).applyInArrow(_ways, WAY).select(
        F.col("position").alias("tree"), "root", F.col("way").alias("_onward"))
    above = inner.join(over, "tree").select(
        "tree", F.col("position").alias("chunk"), "subroot", "root", F.concat("way", "_onward").alias("way"))
    by = ["tree", "chunk"]
    proved = _chunks(nodes).groupBy(*by).cogroup(above.groupBy(*by)).applyInArrow(
        lambda key, rows, way: _prove(key, rows, way, proofs), PROVED)
    return proved if proofs else proved.drop("proof")


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPER_EVERY = 5


def tampered(docs: DataFrame) -> DataFrame:
    """Leaves of documents, with the text in lower case where 5 divides the id's checksum."""
    checksum = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    return leaves(docs, changes={"text": F.translate("text", ASCII_UPPER, ASCII_LOWER)},
                  changed_where=F.coalesce(checksum % TAMPER_EVERY == 0, F.lit(False)))


def _oracle(leaf_levels: int = 6, tree_levels: int = 3) -> str:
    """The manifest as SQL for up to 16^6 documents a source and 16^3 sources."""
    size = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    plain = " || ".join(size(f) for f in FIELDS)
    low = plain.replace(size("text"), size(f"translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}')"))
    code = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)"
    steps, n = [], 0

    def climb(group: str, kept: str, levels: int) -> None:
        """`t{n}` (group, p, c, d) are nodes, `f{n}` documents on their way (v the folded value, proof)."""
        nonlocal n
        same = " AND ".join(f"f.{g} IS NOT DISTINCT FROM t.{g}" for g in group.split(", "))
        for _ in range(levels):
            steps.append(f"""
t{n + 1} AS (SELECT {group}, p // 16 AS p, (max(c) + 15) // 16 AS c, max(c) AS below, list(d ORDER BY p) AS kids,
  CASE WHEN max(c) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d FROM t{n} GROUP BY {group}, p // 16)""")
            steps.append(f"""
f{n + 1} AS (SELECT {kept}, f.p // 16 AS p, t.d AS up,
  CASE WHEN below = 1 THEN v ELSE sha256(array_to_string(kids[:f.p % 16] || [v] || kids[f.p % 16 + 2:], '')) END AS v,
  CASE WHEN below = 1 THEN proof ELSE proof || array_to_string(kids[:f.p % 16] || kids[f.p % 16 + 2:], '') END AS proof
  FROM f{n} f JOIN t{n + 1} t ON {same} AND t.p = f.p // 16)""")
            n += 1
    climb("source", "f.source, f.doc_id, f.leaf", leaf_levels)
    steps.append(f"\nt{n + 1} AS (SELECT 0 AS g, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS c, d FROM t{n})")
    steps.append(f"""
f{n + 1} AS (SELECT 0 AS g, f.doc_id, f.leaf, f.up AS subroot, t.p, f.v, f.proof FROM f{n} f JOIN t{n + 1} t ON t.source IS NOT DISTINCT FROM f.source)""")
    n += 1
    climb("g", "f.g, f.doc_id, f.leaf, f.subroot", tree_levels)
    return f"""
WITH bits AS (SELECT list(list_reduce([i] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS crc FROM range(256) AS r(i)),
rows AS (SELECT doc_id, source, sha256({plain}) AS leaf, CASE WHEN xor(4294967295, list_reduce([4294967295] || {code},
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % {TAMPER_EVERY} = 0 THEN sha256({low}) ELSE sha256({plain}) END AS v FROM documents, bits),
f0 AS (SELECT source, doc_id, leaf, v, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS p FROM rows),
t0 AS (SELECT source, p, leaf AS d, count(*) OVER (PARTITION BY source) AS c FROM f0),{",".join(steps)}
SELECT doc_id, leaf, subroot, up AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = up AS verified FROM f{n}
"""


ORACLE = _oracle()

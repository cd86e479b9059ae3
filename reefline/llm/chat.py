"""Chat formatting by schema fingerprints.

Records come in many layouts (prompt and response, instruction, message lists).  The fingerprint of
a record is a hash of the nested field paths that it fills; it selects one declarative mapping,
which turns the record into canonical turns.  The turns are then set into one template in which
control strings inside texts are broken up reversibly.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reefline.functions.frames import once

# The template.  Every control string begins with one of the three escaped characters.
TURN_OPEN, TURN_CLOSE = "[INST]", "[/INST]"
ANSWER_OPEN, ANSWER_CLOSE = "<s>", "</s>"
ROLE_END = "[:]"
ESCAPED = r"([<\[\\])"
ANSWER_ROLE = "assistant"

TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths a record of this layout fills, those it may fill, and its mapping to turns."""

    name: str
    needs: frozenset
    may: frozenset
    turns: Callable[[Callable[[str], Column]], Column]


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _in_order(*turns: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[_turn(role, text) for role, text in turns]), lambda t: t["text"].isNotNull())


def _list(items: Column, role: str, text: str, roles: dict[str, str] | None = None) -> Column:
    def named(value: Column) -> Column:
        value = F.coalesce(value, F.lit(""))
        for given, canonical in (roles or {}).items():
            value = F.when(value == given, canonical).otherwise(value)
        return value
    return F.transform(items, lambda m: F.struct(
        named(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


LAYOUTS = (
    Layout("messages", frozenset({"messages[].role"}), frozenset({"messages[].content"}),
           lambda f: _list(f("messages"), "role", "content")),
    Layout("from_value", frozenset({"conversations[].from"}), frozenset({"conversations[].value"}),
           lambda f: _list(f("conversations"), "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("prompt_response", frozenset({"prompt", "response"}), frozenset({"system"}),
           lambda f: _in_order(("system", f("system")), ("user", f("prompt")), ("assistant", f("response")))),
    Layout("instruction", frozenset({"instruction", "output"}), frozenset({"input", "system"}),
           lambda f: _in_order(("system", f("system")), ("user", _joined(f("instruction"), f("input"))),
                               ("assistant", f("output")))),
)


def _paths(schema: T.StructType, known: set[str]) -> Iterator[tuple[str, Column]]:
    """Known field paths of a schema, each with whether a record fills it."""
    def walk(path: str, kind: T.DataType, present: Callable[[Callable[[Column], Column]], Column]):
        if path in known:
            yield path, present(lambda value: value.isNotNull())
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f"{path}.{f.name}", f.dataType, lambda test, n=f.name: present(lambda v: test(v[n])))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                yield from walk(f"{path}[].{f.name}", f.dataType, lambda test, n=f.name: present(
                    lambda v: F.coalesce(F.exists(v, lambda x: test(x[n])), F.lit(False))))
    for f in schema.fields:
        yield from walk(f.name, f.dataType, lambda test, n=f.name: test(F.col(f"`{n}`")))


def _print(paths) -> str:
    return "\n".join(sorted(paths))


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """64-bit hash of the field paths, of those some layout names, that a record fills."""
    known = set().union(*[layout.needs | layout.may for layout in layouts])
    present = sorted(_paths(df.schema, known))
    filled = [F.when(test, F.lit(path)) for path, test in present]
    return F.xxhash64(F.array_join(F.array_compact(F.array(*filled)), "\n") if filled else F.lit(""))


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`df` with `layout` (name) and `turns` (role, text); null where no layout has the fingerprint.

    A null field counts as not filled.  Other columns, whatever their names, are ignored.
    """
    there = dict(_paths(df.schema, set().union(*[x.needs | x.may for x in layouts])))
    marked = once(df, "_fingerprint", fingerprint(df, layouts))
    names, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    field = lambda n: F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string")
    for layout in reversed([x for x in layouts if x.needs <= there.keys()]):
        may = sorted(layout.may & there.keys())
        prints = [_print(layout.needs | set(some)) for k in range(len(may) + 1) for some in combinations(may, k)]
        chosen = reduce(lambda a, b: a | b, [F.col("_fingerprint") == F.xxhash64(F.lit(p)) for p in prints])
        names = F.when(chosen, F.lit(layout.name)).otherwise(names)
        turns = F.when(chosen, layout.turns(field).cast(TURNS)).otherwise(turns)
    return marked.withColumns({"layout": names, "turns": turns}).drop("_fingerprint")


def escape(text: Column) -> Column:
    """Break up whatever could begin a control string; `unescape` gives the text back."""
    return F.regexp_replace(text, ESCAPED, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED + r"\\", "$1")


def format_turns(df: DataFrame) -> DataFrame:
    """`df` with `formatted` and `loss_spans` (start and length in characters of each answer's text).

    No turns give an empty string; null turns give null.
    """
    piece = lambda t: F.struct(
        F.concat(F.when(t["role"] == ANSWER_ROLE, ANSWER_OPEN).otherwise(TURN_OPEN), escape(t["role"]),
                 F.lit(ROLE_END)).alias("head"),
        escape(t["text"]).alias("body"),
        F.when(t["role"] == ANSWER_ROLE, ANSWER_CLOSE).otherwise(TURN_CLOSE).alias("tail"),
        (t["role"] == ANSWER_ROLE).alias("answer"))
    pieces = once(df, "_pieces", F.transform("turns", piece))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        size = F.length(p["body"])
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct((begin + size + F.length(p["tail"])).alias("at"), F.when(
            p["answer"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return pieces.withColumns({
        "formatted": text, "loss_spans": F.aggregate("_pieces", start, step, lambda s: s["spans"])}).drop("_pieces")


def read_back(df: DataFrame) -> DataFrame:
    """`df` with `read_turns` parsed from `formatted` and `loss_text` cut out of it at `loss_spans`."""
    def parse(piece: Column) -> Column:
        answer = piece.startswith(ANSWER_OPEN)
        head = F.when(answer, len(ANSWER_OPEN)).otherwise(len(TURN_OPEN))
        body = piece.substr(head + 1, F.length(piece))
        at = F.instr(body, F.lit(ROLE_END))
        return F.struct(unescape(body.substr(F.lit(1), at - 1)).alias("role"),
                        unescape(body.substr(at + len(ROLE_END), F.length(body))).alias("text"))
    # a closing control string ends each turn, so what follows the last one is empty
    pieces = F.filter(F.split("formatted", r"</s>|\[/INST\]", -1), lambda p: p != "")
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"])))
    return once(df.withColumn("loss_text", F.array_join(loss, "")), "read_turns", F.transform(pieces, parse))


def records(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as one record each, in the layout that fits it.

    A user's turn and its answer, with a system turn before them or not, make a prompt record; talks
    that open with a system turn make a from-value list; all others a message list.  Null roles and
    texts count as empty, rows of one turn follow each other by role and text, and rows without
    conv_id make one record.  A conversation is gathered whole, being one row of the result.
    """
    turns = F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    talks = once(rows.groupBy("conv_id").agg(turns.alias("t")), "t", F.col("t"))
    roles = F.array_join(F.transform("t", lambda t: t["role"]), ",")
    short, system = F.size("t") == 2, F.size("t") == 3
    prompt = (short & (roles == "user,assistant")) | (system & (roles == "system,user,assistant"))
    from_value = ~prompt & (F.col("t")[0]["role"] == "system")
    text = lambda i: F.element_at("t", i)["text"]
    return talks.select(
        "conv_id",
        F.when(prompt & system, F.col("t")[0]["text"]).alias("system"),
        F.when(prompt, text(-2)).alias("prompt"), F.when(prompt, text(-1)).alias("response"),
        F.when(from_value, F.transform("t", lambda t: F.struct(
            t["role"].alias("from"), t["text"].alias("value")))).alias("conversations"),
        F.when(~prompt & ~from_value, F.transform("t", lambda t: F.struct(
            t["role"].alias("role"), t["text"].alias("content")))).alias("messages"))

"""Chat formatting by schema fingerprints.

Records with prompt, instruction or message layouts come as one DataFrame whose nested columns are the union of the
layouts. The nested paths that a record fills are hashed; the fingerprint selects a declarative mapping that turns the
record into canonical turns (role, text). Turns are rendered with a template that marks each turn and escapes control
strings inside texts reversibly; parse() reads them back from the output.

Template: an assistant turn is ``<s> role NEWLINE text </s>``, any other turn ``[INST] role NEWLINE text [/INST]``. In
texts each control string gets a backslash after its first character, and one that has backslashes there gets
one more, so none is left that the template could have written, and taking one away restores the text. In roles, which end
at the first line end, percent signs and line ends are also written as %25 and %0A.

Defined cases: a null text or role counts as empty; rows of a conversation are ordered by turn, then role, then text,
null turns first, and repeated rows stay; a null conv_id is a conversation like any other; records whose fingerprint no
mapping has keep their row, with null turns and layout; an empty table gives no rows. All work is done by DataFrame
functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import boxed, unboxed, without

#: The template's control strings, as one pattern: first character, backslashes, the rest.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|/?SYS>)"
TURN = r"(?s)(\[INST\] .*? \[/INST\]|<s> .*? </s>)"
LOSS_ROLE = "assistant"


def _text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _turn(role: str | Column, text: str | Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(_text(role).alias("role"), _text(text).alias("text"))


def _turns_of(path: str, role: str, text: str) -> Column:
    return F.transform(F.col(path), lambda x: _turn(x[role], x[text]))


@dataclass(frozen=True)
class Mapping:
    """A layout: its name, the nested paths that its records fill, and for each turn, or list of turns, where it comes from.

    turns: (role, path) pairs, or (path of an array, name of its role field, name of its text field).
    """

    layout: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, ...], ...]

    def fingerprint(self) -> int:
        """As xxhash64() of the engine gives it for the sorted paths."""
        n = xxhash.xxh64(" ".join(sorted(self.paths)).encode(), seed=42).intdigest()
        return n - (1 << 64) if n >> 63 else n

    def canonical(self) -> Column:
        lists = []
        for rule in self.turns:
            if len(rule) == 2:
                lists.append(F.array(_turn(rule[0], rule[1])))
            else:
                lists.append(_turns_of(*rule))
        return lists[0] if len(lists) == 1 else F.concat(*lists)


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), (("messages", "role", "content"),)),
    Mapping("shares", ("conversations[].from", "conversations[].value"), (("conversations", "from", "value"),)),
    Mapping("prompt", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_only", ("prompt",), (("user", "prompt"),)),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("input", "instruction", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_messages", ("messages[].content", "messages[].role", "system"), (("system", "system"), ("messages", "role", "content"))),
    Mapping("nothing", (), ()),
)


def filled_paths(schema: T.StructType, at: Column | None = None, name: str = "") -> list[tuple[str, Column]]:
    """(path, whether a record fills it) for each leaf; [] marks elements of an array, which fill what any of them fills."""
    out = []
    for field in schema:
        column = F.col(f"`{field.name}`") if at is None else at[field.name]
        out += _paths_below(field.dataType, column, f"{name}{field.name}")
    return out


def _paths_below(kind: T.DataType, column: Column, name: str) -> list[tuple[str, Column]]:
    if isinstance(kind, T.StructType):
        return filled_paths(kind, column, f"{name}.")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            leaves = [p for p, _ in _paths_below(kind.elementType, F.lit(None).cast(kind.elementType), f"{name}[]")]

            def fills(k: int) -> Column:
                return F.exists(column, lambda x: _paths_below(kind.elementType, x, "")[k][1])

            return [(p, F.coalesce(fills(k), F.lit(False))) for k, p in enumerate(leaves)]
        return [(f"{name}[]", F.coalesce(F.size(column) > 0, F.lit(False)))]
    return [(name, column.isNotNull())]


def fingerprint(records: DataFrame, columns: list[str]) -> Column:
    schema = T.StructType([records.schema[c] for c in columns])
    paths = sorted(filled_paths(schema), key=lambda x: x[0])
    return F.xxhash64(F.array_join(F.array(*(F.when(filled, F.lit(p)) for p, filled in paths)), " "))


def canonical_turns(records: DataFrame, columns: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with layout and turns in place of the layout columns; mappings that need absent columns are passed over."""
    there = {p for p, _ in filled_paths(T.StructType([records.schema[c] for c in columns]))}
    print_of = fingerprint(records, columns)
    empty = F.array().cast("array<struct<role:string,text:string>>")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))
    for m in mappings:
        if set(m.paths) <= there:
            layout = F.when(F.col("_print") == F.lit(m.fingerprint()), m.layout).otherwise(layout)
            turns = F.when(F.col("_print") == F.lit(m.fingerprint()), m.canonical() if m.turns else empty).otherwise(turns)
    rest = without(records.columns, [*columns, "layout", "turns"])
    return records.select(*boxed(rest), *columns, print_of.alias("_print")).select(*unboxed(rest), layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render(turns: Column) -> Column:
    def one(t: Column) -> Column:
        role = F.replace(F.replace(t["role"], F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
        body = F.concat(escape(role), F.lit("\n"), escape(t["text"]))
        return F.when(t["role"] == LOSS_ROLE, F.concat(F.lit("<s> "), body, F.lit(" </s>"))).otherwise(
            F.concat(F.lit("[INST] "), body, F.lit(" [/INST]"))
        )

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text, loss) of what render() wrote; loss: whether the text is under the loss mask."""

    def one(turn: Column) -> Column:
        body = F.regexp_replace(turn, r"(?s)^(?:\[INST\]|<s>) (.*) (?:\[/INST\]|</s>)\z", "$1")
        at = F.instr(body, "\n")
        role = unescape(F.substring(body, F.lit(1), at - 1))
        return F.struct(
            F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")).alias("role"),
            unescape(F.substring(body, at + 1, F.length(body))).alias("text"),
            F.startswith(turn, F.lit("<s>")).alias("loss"),
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), one)


def loss_spans(formatted: Column) -> Column:
    """[start, end) in code points of the stretches of the formatted text that are under the loss mask."""
    parts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        end = acc["at"] + F.length(turn)
        span = F.struct((acc["at"] + F.instr(turn, "\n")).alias("start"), (end - F.lit(len(" </s>"))).alias("end"))
        spans = F.when(F.startswith(turn, F.lit("<s>")), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(parts, zero, step, lambda acc: acc["spans"])


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """One record for each conversation of rows by turn, in the narrowest layout that holds it: conv_id, prompt, completion,
    instruction, input, output, messages."""
    message = F.struct(F.col("turn"), _text("role").alias("role"), _text("text").alias("content"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    roles = F.array_join(F.transform("m", lambda x: x["role"]), ",")
    n = F.size("m")
    pair, triple = (n == 2) & (roles == "user,assistant"), (n == 3) & (roles == "system,user,assistant")
    of = lambda k: F.get(F.col("m"), F.lit(k))["content"]
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return whole.select(
        "conv_id", F.when(pair, of(0)).alias("prompt"), F.when(pair, of(1)).alias("completion"), F.when(triple, of(0)).alias("instruction"),
        F.when(triple, of(1)).alias("input"), F.when(triple, of(2)).alias("output"), F.when(~pair & ~triple, plain).alias("messages"),
    )


LAYOUT_COLUMNS = ["prompt", "completion", "instruction", "input", "output", "messages"]


def format_chats(records: DataFrame, columns: list[str] = LAYOUT_COLUMNS) -> DataFrame:
    """records with layout, turns and formatted."""
    return canonical_turns(records, columns).withColumn("formatted", render(F.col("turns")))

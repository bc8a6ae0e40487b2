"""Chat formatting by schema fingerprints (operator 10), in DataFrame functions throughout.

A record's fingerprint is the hash of the nested field paths that it fills. A declarative mapping is
registered under the fingerprint of each layout that it understands; it lists where turns come from. So
prompt, instruction and message layouts all become the same canonical turns, and a record of an
unknown layout is told apart from an empty one.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. In roles and texts ``&``, ``<`` and ``[``
are written as ``&amp;``, ``&lt;`` and ``&#91;``: no control string can occur inside a text, of this template
or of those that use ``<s>`` or ``[INST]``, and the escape is undone exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
#: Characters that begin control strings, and how they are written; & comes first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))

TURN = "struct<role: string, text: string>"
#: The union of the layouts that records come in; a record fills some of the fields.
RECORD = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("instruction", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
        T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))),
    ]
)


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    required, optional: the field paths of a record; list items are ``name[].field``. parts: either
    (role, fields joined by a blank line) for each turn, or (list, role field, text field).
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    parts: tuple[tuple, ...]

    def path_sets(self):
        for keep in product((False, True), repeat=len(self.optional)):
            yield sorted([*self.required, *(p for p, k in zip(self.optional, keep, strict=True) if k)])


MAPPINGS = (
    Mapping("prompt", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("messages", ("messages",), ("messages[].role", "messages[].content"), (("messages", "role", "content"),)),
    Mapping("sharegpt", ("conversations",), ("conversations[].from", "conversations[].value"), (("conversations", "from", "value"),)),
)
#: The sharegpt layout's names of the roles.
ROLES = {"human": "user", "gpt": "assistant"}


def fingerprint_of(paths: list[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(paths)))


def _fills(field: str):
    return lambda x: x[field].isNotNull()


def fingerprint(record: str, schema: T.StructType = RECORD) -> Column:
    """Hash of the sorted paths of the fields that ``record`` fills."""
    filled = []
    for f in schema.fields:
        own = F.col(f"{record}.`{f.name}`")
        filled.append(F.when(own.isNotNull(), F.lit(f.name)))
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            for g in f.dataType.elementType.names:
                filled.append(F.when(F.exists(own, _fills(g)), F.lit(f"{f.name}[].{g}")))
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*filled))), "\n"))


def _turns(record: str, m: Mapping) -> Column:
    if len(m.parts[0]) == 3:
        name, role, text = m.parts[0]
        return F.transform(F.col(f"{record}.`{name}`"), lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))
    each = []
    for role, names in m.parts:
        own = [F.col(f"{record}.`{n}`") for n in names]
        text = own[0] if len(own) == 1 else F.array_join(F.array_compact(F.array(*own)), "\n\n")
        each.append(F.when(F.coalesce(*own).isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.array_compact(F.array(*each))


def canonical(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with layout (null if unknown) and turns: array of role and text, of each record's layout.

    ``record`` is a struct column of type RECORD. Null roles and texts become empty; in the sharegpt
    layout ``human`` and ``gpt`` become user and assistant. A null record, or one of no known layout, has layout and turns null.
    """
    prints = [(fingerprint_of(p), m) for m in MAPPINGS for p in m.path_sets()]
    df = df.withColumn("_print", fingerprint(record))
    layout = F.coalesce(*[F.when(F.col("_print") == k, F.lit(m.name)) for k, m in prints])
    df = df.withColumn("layout", F.when(F.col(record).isNotNull(), layout)).drop("_print")
    turns = F.coalesce(*[F.when(F.col("layout") == m.name, _turns(record, m)) for m in MAPPINGS])
    other = lambda x: F.coalesce(*[F.when(x["role"] == k, F.lit(v)) for k, v in ROLES.items()], x["role"], F.lit(""))
    role = lambda x: F.when(F.col("layout") == "sharegpt", other(x)).otherwise(F.coalesce(x["role"], F.lit("")))
    return df.withColumn("turns", F.transform(turns, lambda x: F.struct(role(x).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))))


def from_json(df: DataFrame, column: str, record: str = "record") -> DataFrame:
    """``df`` with a record struct parsed from a JSON column; unknown fields count for nothing."""
    return df.withColumn(record, F.from_json(column, RECORD))


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_role(c: Column) -> Column:
    """As escape(); a role is one line."""
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with formatted: the turns in the template; null turns give null, no turns an empty string."""
    one = lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(END))
    return df.withColumn("formatted", F.array_join(F.transform(turns, one), ""))


def parse_formatted(df: DataFrame) -> DataFrame:
    """``df`` with read_turns (role, text, loss: is it under the loss mask) read back from formatted."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), F.lit(1), F.greatest(F.size(F.split("formatted", r"<\|im_end\|>\n", -1)) - 1, F.lit(0)))
    role = lambda x: F.regexp_replace(F.substring_index(x, "\n", 1), r"^<\|im_start\|>", "")
    one = lambda x: F.struct(unescape(F.replace(role(x), F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"), (role(x) == "assistant").alias("loss"))
    return df.withColumn("_parts", parts).withColumn("read_turns", F.transform("_parts", one)).drop("_parts")


def loss_spans(turns: Column) -> Column:
    """Offsets (code points, end exclusive) in formatted of the texts of assistant turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first: int, last: int>>").alias("spans"))

    def step(acc, x):
        first = acc["at"] + F.lit(len(START) + 1) + F.length(escape_role(x["role"]))
        last = first + F.length(escape(x["text"]))
        span = F.struct(first.alias("first"), last.alias("last"))
        return F.struct((last + F.lit(len(END))).alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def records_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id and record of conversations that come as rows (conv_id, turn, role, text).

    Rows are ordered by turn, those of one turn by role and text, nulls first. A user's row that an
    assistant's follows and nothing else becomes a prompt record, all others messages records.
    """
    turn = F.struct("turn", "role", "text")
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    pair = (F.size("t") == 2) & F.get("t.role", F.lit(0)).eqNullSafe("user") & F.get("t.role", F.lit(1)).eqNullSafe("assistant") & F.get("t.text", F.lit(0)).isNotNull() & F.get("t.text", F.lit(1)).isNotNull()
    values = {"prompt": F.when(pair, F.get("t.text", F.lit(0))), "completion": F.when(pair, F.get("t.text", F.lit(1))), "messages": F.when(~pair, messages)}
    return own.select("conv_id", F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields]).alias("record"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, layout, formatted of conversations that come as rows. Other columns are ignored."""
    return format_turns(canonical(records_of_rows(rows))).select("conv_id", "layout", "formatted")


def read_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted."""
    df = parse_formatted(formatted)
    turns = F.array_join(F.transform("read_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    df = df.withColumn("_loss", F.array_join(F.transform(F.filter("read_turns", lambda x: x["loss"]), lambda x: x["text"]), ""))
    return df.select("conv_id", F.size("read_turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))

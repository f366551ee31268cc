"""Chat formatting, with DataFrame functions alone.

A table's layout is known by fingerprints: hashes of its nested field paths (arrays as []), as far as a layout uses them.
The largest layout whose fingerprint they have selects a declarative mapping (a SQL expression) to canonical turns, an
array of (role, text). JSON texts of mixed layouts are told apart row by row in the same way; fields that no layout uses
do not matter, and an empty array of messages is a conversation without turns.

The template is `### <role>: <text></turn>` and a newline for each turn. Inside roles and texts the control
characters are escaped, so that no marker can be forged and every text is read back exactly. The loss mask is
a list of runs (masked, n characters); assistant texts are masked.

Defined results: null text or role is empty; a null conversation id is one conversation; turns go by turn (null
first), then role, then text; repeated rows are repeated turns; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: layout -> (field paths, how to get array<struct<role,text>> from a row, or, in BY_ROWS, from the rows of a conversation)
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "turn_rows": (
        ("conv_id", "role", "text", "turn"),
        "transform(sort_array(collect_list(named_struct('turn', turn, 'role', coalesce(role, ''), 'text', coalesce(text, '')))), m -> named_struct('role', m.role, 'text', m.text))",
    ),
    "messages": (("messages[].content", "messages[].role"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    "from_value": (
        ("conversations[].from", "conversations[].value"),
        "transform(conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))",
    ),
    "prompt_completion": (("completion", "prompt"), "array(named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', completion))"),
    "prompt_response": (("prompt", "response"), "array(named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', response))"),
    "instruction": (("instruction", "output"), "array(named_struct('role', 'user', 'text', instruction), named_struct('role', 'assistant', 'text', output))"),
    "instruction_input": (
        ("input", "instruction", "output"),
        "array(named_struct('role', 'user', 'text', CASE WHEN coalesce(input, '') = '' THEN instruction ELSE concat(instruction, '\\n\\n', input) END), named_struct('role', 'assistant', 'text', output))",
    ),
    "question_answer": (("answer", "question"), "array(named_struct('role', 'user', 'text', question), named_struct('role', 'assistant', 'text', answer))"),
}
BY_ROWS = {"turn_rows"}


def fingerprint(paths) -> str:
    """Hash of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


#: The layouts by fingerprint, those of more fields first.
BY_FINGERPRINT = {fingerprint(LAYOUTS[n][0]): n for n in sorted(LAYOUTS, key=lambda n: (-len(LAYOUTS[n][0]), n))}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema, down to its leaves."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def layout_of(paths) -> str:
    """The layout of most fields whose fingerprint the paths have."""
    for mark, name in BY_FINGERPRINT.items():
        if fingerprint(set(paths) & set(LAYOUTS[name][0])) == mark:
            return name
    raise ValueError(f"no chat layout has the fields {sorted(paths)}")


def turns_of(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, turns array<struct<role,text>>) from a table in any of the layouts."""
    layout = layout_of(field_paths(df.schema))
    turns = F.expr(LAYOUTS[layout][1])
    if layout in BY_ROWS:
        return df.groupBy(F.col("conv_id").alias(key)).agg(turns.alias("turns"))
    return df.select(F.col(key), _filled(turns).alias("turns"))


def _filled(turns: Column) -> Column:
    return F.transform(turns, lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))


def _fields(names) -> dict[str, list[str]]:
    """Top-level fields of the layouts, with the leaves of those that are arrays."""
    out: dict[str, list[str]] = {}
    for path in sorted({p for n in names for p in LAYOUTS[n][0]}):
        head, _, leaf = path.partition("[].")
        out.setdefault(head, []).extend([leaf] if leaf else [])
    return out


def turns_of_json(df: DataFrame, json: str, key: str = "conv_id") -> DataFrame:
    """As turns_of for a column of JSON texts, each row by its own fingerprint; unknown layouts, and those of single turns, give null turns."""
    names = [n for n in BY_FINGERPRINT.values() if n not in BY_ROWS]
    fields = _fields(names)
    ddl = ", ".join(f"`{k}` " + (f"array<struct<{', '.join(f'`{x}`:string' for x in v)}>>" if v else "string") for k, v in fields.items())
    keys = F.coalesce(F.json_object_keys("_json"), F.array().cast("array<string>"))

    def has(path: str) -> Column:
        head, _, leaf = path.partition("[].")
        if not leaf:
            return F.array_contains(keys, head)
        items = F.from_json(F.get_json_object("_json", f"$.{head}"), "array<string>")
        return F.coalesce((F.size(items) == 0) | F.exists(items, lambda x: F.coalesce(F.array_contains(F.json_object_keys(x), leaf), F.lit(False))), F.lit(False))

    rows = df.select(F.col(key).alias("_key"), F.col(json).alias("_json"))
    held = {p: has(p) for p in sorted({p for n in names for p in LAYOUTS[n][0]})}
    rows = rows.select("_key", F.from_json("_json", ddl).alias("_all"), *[c.alias(f"_has_{k}") for k, c in enumerate(held.values())])
    at = {p: f"_has_{k}" for k, p in enumerate(held)}

    def marks(paths) -> Column:
        """The fingerprint of those of the paths that the row has."""
        present = F.filter(F.array(*[F.when(F.col(at[p]), F.lit(p)) for p in sorted(paths)]), lambda x: x.isNotNull())
        return F.substring(F.sha2(F.array_join(present, "\n"), 256), 1, 16)

    turns, mark = F.lit(None).cast("array<struct<role:string,text:string>>"), marks(held)
    for n in reversed(names):
        paths, how = LAYOUTS[n]
        turns = F.when(marks(paths) == fingerprint(paths), _filled(F.expr(how))).otherwise(turns)
    return rows.select("_key", mark.alias("fingerprint"), *[F.col(c) for c in at.values()], "_all.*").select(F.col("_key").alias(key), "fingerprint", turns.alias("turns"))


def escape(text: Column) -> Column:
    r"""Backslash, < and # become \b, \l and \h: no marker of the template is left."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As escape, and : becomes \c, for the first colon ends the role."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


END = "</turn>\n"


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss_runs` (array of masked, n) to rows with turns."""
    head = lambda x: F.concat(F.lit("### "), escape_role(x["role"]), F.lit(": "))
    pieces = F.transform("turns", lambda x: F.concat(head(x), escape(x["text"]), F.lit(END)))
    run = lambda on, n: F.struct(on.alias("masked"), n.cast("long").alias("n"))
    runs = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(run(F.lit(False), F.length(head(x))), run(x["role"] == "assistant", F.length(escape(x["text"]))), run(F.lit(False), F.lit(len(END)))),
        )
    )
    return turns.withColumn("formatted", F.array_join(pieces, "")).withColumn("loss_runs", runs)


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Read turns back from `formatted` alone, and the masked texts from `formatted` and `loss_runs`."""
    pieces = F.split("formatted", END)
    parsed = F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.struct(unescape_role(F.substring_index(F.substr(p, F.lit(5)), ": ", 1)).alias("role"), unescape(F.substr(p, F.instr(p, ": ") + 2)).alias("text"), p.alias("piece")),
    )
    out = formatted.withColumn("parsed", parsed)
    masked = F.filter(
        F.transform("parsed", lambda x, i: F.when(F.get("loss_runs", i * 3 + 1)["masked"], unescape(F.substr(x["piece"], (F.get("loss_runs", i * 3)["n"] + 1).cast("int"), F.get("loss_runs", i * 3 + 1)["n"].cast("int"))))),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("loss_text", F.array_join(masked, "")).drop("turns").withColumnRenamed("parsed", "turns")

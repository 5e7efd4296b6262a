"""Chat formatting: schema fingerprints select declarative mappings into canonical turns. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's marks. Escaped text has neither HEAD's `#` nor END's `<`, so that no text can look like a mark.
HEAD, END = "### ", "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """paths: the nested fields that tell the layout; turns: SQL for array<struct<role string, text string>> over them.
    rows: the layout has one turn a row, to be gathered by `key` in the order of `order`."""

    name: str
    paths: tuple[str, ...]
    turns: str
    key: str | None = None
    order: str | None = None


_S = "named_struct('role', {0}, 'text', coalesce(cast({1} as string), ''))"
_ROLE = "case lower({0}) when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' else coalesce(cast({0} as string), '') end"
_LIST = "transform({0}, m -> " + _S.format(_ROLE.format("m.{1}"), "m.{2}") + ")"
_TWO = "array(" + _S.format("'user'", "{0}") + ", " + _S.format("'assistant'", "{1}") + ")"
_OPTIONAL = "filter(array(" + ", ".join(_S.format(f"'{r}'", "{" + str(i) + "}") for i, r in enumerate(("system", "user", "assistant"))) + "), (t, i) -> i > 0 or t.text <> '')"

#: Told apart by their fields; of several that fit, the one with most fields holds.
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), _LIST.format("messages", "role", "content")),
    Layout("sharegpt", ("conversations[].from", "conversations[].value"), _LIST.format("conversations", "from", "value")),
    Layout("instruction_input", ("instruction", "input", "output"), _TWO.format("concat_ws('\n\n', instruction, nullif(input, ''))", "output")),
    Layout("instruction", ("instruction", "output"), _TWO.format("instruction", "output")),
    Layout("prompt_completion", ("prompt", "completion"), _TWO.format("prompt", "completion")),
    Layout("system_prompt_response", ("system", "prompt", "response"), _OPTIONAL.format("system", "prompt", "response")),
    Layout("prompt_response", ("prompt", "response"), _TWO.format("prompt", "response")),
    Layout("question_answer", ("question", "answer"), _TWO.format("question", "answer")),
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), _S.format("coalesce(cast(role as string), '')", "text"), "conv_id", "turn"),
)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a schema; elements of arrays are written []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def select_layout(paths: list[str], spark) -> Layout:
    """The layout whose hashed paths are all among the hashed paths of the schema; further fields do not matter."""
    digest = lambda ps: F.array_sort(F.transform(F.array(*[F.lit(p) for p in sorted(set(ps))]), lambda p: F.xxhash64(p)))
    have = digest(paths)
    fits = [F.size(F.array_except(digest(x.paths), have)) == 0 for x in LAYOUTS]
    hits = [x for x, ok in zip(LAYOUTS, spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(fits)]).first(), strict=True) if ok]
    if not hits:
        raise ValueError(f"no layout fits the fields {sorted(set(paths))}")
    return max(hits, key=lambda x: len(x.paths))


def json_fingerprint(record: Column) -> Column:
    """Per row: a hash of the nested field paths of a JSON record, whatever its value types."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.xxhash64(F.regexp_replace(shape, r": (?!OBJECT|ARRAY)[A-Z]+(\([^)]*\))?", ""))


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turns) for a table in any of LAYOUTS, chosen by the fingerprint of its schema.

    A null text or role is empty; turns with the same number are ordered by role and text; rows with a null conversation
    form one conversation; an empty table gives an empty result; columns that no layout names are left out.
    """
    layout = select_layout(field_paths(df.schema), df.sparkSession)
    turn = F.expr(layout.turns)
    if layout.key is None:
        return df.select(F.col(conv_id).alias("conv_id"), turn.alias("turns"))
    gathered = df.select(F.col(layout.key).alias("conv_id"), F.struct(F.col(layout.order).alias("at"), turn.alias("turn")).alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return gathered.select("conv_id", F.transform("rows", lambda r: r["turn"]).alias("turns"))


def canonical_json_turns(df: DataFrame, record: str, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns) for JSON records of mixed layouts in one column: each row's own field paths choose its
    mapping. Records that fit none, or are no JSON, have a null layout and null turns."""
    kinds = {"messages": "array<struct<role:string,content:string>>", "conversations": "array<struct<from:string,value:string>>"}
    names = sorted({p.split("[")[0].split(".")[0] for x in LAYOUTS if x.key is None for p in x.paths})
    parsed = F.from_json(F.col(record), ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names))
    # the paths of the record, read off the shape that its own values have
    has = lambda p: F.col("_r." + p.split("[")[0]).isNotNull() & (F.size(F.filter(F.col("_r." + p.split("[")[0]), lambda m: m[p.split(".")[1]].isNotNull())) > 0 if "[]" in p else F.lit(True))
    rows = df.select(F.col(conv_id).alias("conv_id"), parsed.alias("_r"), json_fingerprint(F.col(record)).alias("fingerprint"))
    ranked = sorted((x for x in LAYOUTS if x.key is None), key=lambda x: -len(x.paths))
    pick = F.coalesce(*[F.when(_all([has(p) for p in x.paths]), F.lit(x.name)) for x in ranked])
    rows = rows.select("conv_id", "fingerprint", pick.alias("layout"), "_r.*")
    turns = F.coalesce(*[F.when(F.col("layout") == x.name, F.expr(x.turns)) for x in ranked])
    return rows.select("conv_id", "fingerprint", "layout", turns.alias("turns"))


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _escape(c: Column) -> Column:
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescape(c: Column) -> Column:
    for a, b in (("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): turns in the template, and the [start, end) code points of assistants' texts.

    A turn is HEAD, the role, a line end, the text, END; `\\`, `#` and `<` in roles and texts become `\\b`, `\\h` and `\\l`,
    a line end in a role `\\n`. A conversation without turns gives an empty text.
    """
    parts = F.transform("turns", lambda t: F.struct(F.replace(_escape(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), F.lit("\\n")).alias("role"), _escape(F.coalesce(t["text"], F.lit(""))).alias("text"), (t["role"] == "assistant").alias("loss")))
    rows = turns.select("conv_id", parts.alias("parts"))
    line = lambda t: F.concat(F.lit(HEAD), t["role"], F.lit("\n"), t["text"], F.lit(END))
    head = lambda t: F.char_length(t["role"]) + len(HEAD) + 1
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    span = lambda acc, t: F.array(F.struct((acc["at"] + head(t)).alias("start"), (acc["at"] + head(t) + F.char_length(t["text"])).alias("end")))
    walk = F.aggregate("parts", zero, lambda acc, t: F.struct((acc["at"] + F.char_length(line(t))).alias("at"), F.when(t["loss"], F.concat(acc["spans"], span(acc, t))).otherwise(acc["spans"]).alias("spans")))
    return rows.select("conv_id", F.array_join(F.transform("parts", line), "").alias("formatted"), walk["spans"].alias("loss_spans"))


def read_chat(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    chunks = F.filter(F.split(formatted, END), lambda c: c != "")
    body = lambda c: F.substr(c, F.lit(len(HEAD) + 1))
    cut = lambda c: F.instr(body(c), "\n")
    role = lambda c: _unescape(F.replace(F.substr(body(c), F.lit(1), cut(c) - 1), F.lit("\\n"), F.lit("\n")))
    return F.transform(chunks, lambda c: F.struct(role(c).alias("role"), _unescape(F.substr(body(c), cut(c) + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: _unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def op5_format_chat(spark, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = format_chat(canonical_turns(rows)).select("conv_id", "formatted", read_chat(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 13 + length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), chr(10), '\n'))
    + length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

"""Chat formatting [native]: schema fingerprints select mappings to canonical turns; a template marks the turns.

A record is a struct or JSON. The fingerprint is the SHA-256 of its nested field paths (its shape
without scalar types: the struct's type, or that of the parsed JSON); it selects one of ``LAYOUTS``, each of which declares where roles and
texts are. A struct whose type is no layout, as when files of several layouts are read as one table, is fingerprinted row by row, by the fields that are not null there. Texts of a struct are read from its fields, so their length has no limit. The template escapes its own control strings inside texts by one backslash after
their first character (and one more for each that is there already), so that reading back is exact.

Defined results: a null text or role is empty; a record of unknown shape has layout null and
no turns; JSON that cannot be parsed for its length (a string of 20,000,000 characters or more) is an error;
other names of roles are replaced in layouts of message lists, never in a row that is a turn; equal turns
sort by role, then text; a null conversation id is one conversation; texts
are used whole; an empty table gives an empty table (the query adds its own conversation -1); other columns
pass through ``canonical`` and ``formatted``, one named like the output is replaced.
"""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrove.llm.common import free_name, table

TURNS = "array<struct<role:string,text:string>>"
#: Longest string that Spark's JSON parser takes.
LONGEST_JSON = 20_000_000
#: Other names of the roles, as message lists have them.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: name: (example of the shape, mapping). A mapping is either (array path, role field, text field) or a list of (role or $path, text path).
LAYOUTS: dict[str, tuple[dict, tuple | list]] = {
    "turn_row": ({"role": "", "text": ""}, [("$.role", "$.text")]),
    "messages": ({"messages": [{"role": "", "content": ""}]}, ("$.messages", "role", "content")),
    "conversations": ({"conversations": [{"from": "", "value": ""}]}, ("$.conversations", "from", "value")),
    "dialogue": ({"turns": [{"role": "", "text": ""}]}, ("$.turns", "role", "text")),
    "prompt_completion": ({"prompt": "", "completion": ""}, [("user", "$.prompt"), ("assistant", "$.completion")]),
    "prompt_response": ({"prompt": "", "response": ""}, [("user", "$.prompt"), ("assistant", "$.response")]),
    "system_prompt_response": ({"system": "", "prompt": "", "response": ""}, [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")]),
    "question_answer": ({"question": "", "answer": ""}, [("user", "$.question"), ("assistant", "$.answer")]),
    "instruction_output": ({"instruction": "", "output": ""}, [("user", "$.instruction"), ("assistant", "$.output")]),
    "instruction_input_output": ({"instruction": "", "input": "", "output": ""}, [("user", "$.instruction+$.input"), ("assistant", "$.output")]),
    "nested_data": ({"data": {"messages": [{"role": "", "content": ""}]}}, ("$.data.messages", "role", "content")),
}

CONTROL = r"(/?INST\]|ASST\]|ROLE\||/?s>)"
START = "<s>"


def shape(example: object) -> str:
    """The shape of a value as ``fingerprint`` sees it: sorted fields, scalars as ``_``."""
    if isinstance(example, dict):
        return "OBJECT<" + ", ".join(f"{k}: {shape(v)}" for k, v in sorted(example.items())) + ">"
    if isinstance(example, list):
        return f"ARRAY<{shape(example[0]) if example else '_'}>"
    return "_"


def shape_of(kind: T.DataType) -> str:
    """The shape of a Spark type, as ``shape`` has it."""
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {shape_of(f.dataType)}" for f in sorted(kind, key=lambda f: f.name)) + ">"
    return f"ARRAY<{shape_of(kind.elementType)}>" if isinstance(kind, T.ArrayType) else "_"


def layout_hash(example: dict) -> str:
    return hashlib.sha256(shape(example).encode()).hexdigest()


def fingerprint(record: Column) -> Column:
    """SHA-256 of the nested field paths of a variant."""
    scalar = r"\b(VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|VARIANT|DECIMAL\(\d+,\s?\d+\))(?=[,>]|$)"
    return F.sha2(F.regexp_replace(F.schema_of_variant(record), scalar, "_"), 256)


def present(value: Column, kind: T.DataType) -> Column:
    """The shape of a struct's row: of fields that are not null, and of the first element of arrays."""
    if isinstance(kind, T.StructType):
        own = [F.when(value[f.name].isNotNull(), F.concat(F.lit(f"{f.name}: "), present(value[f.name], f.dataType))) for f in sorted(kind, key=lambda f: f.name)]
        return F.concat(F.lit("OBJECT<"), F.array_join(F.array(*own), ", "), F.lit(">"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("ARRAY<"), F.when(F.size(value) > 0, present(F.get(value, 0), kind.elementType)).otherwise("_"), F.lit(">"))
    return F.lit("_")


def _at(kind: T.DataType, path: str) -> T.DataType | None:
    for name in path.split(".")[1:]:
        kind = kind[name].dataType if isinstance(kind, T.StructType) and name in kind.fieldNames() else None
    return kind


def _readable(kind: T.StructType, mapping: tuple | list) -> bool:
    """Whether a struct's type has all fields that a mapping reads."""
    if isinstance(mapping, tuple):
        found = _at(kind, mapping[0])
        return isinstance(found, T.ArrayType) and isinstance(found.elementType, T.StructType) and {*mapping[1:]} <= {*found.elementType.fieldNames()}
    return all(isinstance(_at(kind, p), T.AtomicType) for pair in mapping for x in pair if x[0] == "$" for p in x.split("+"))


def _role(role: Column) -> Column:
    low = F.coalesce(role, F.lit(""))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[low], low)


def _turns(mapping: tuple | list, get, items) -> Column:
    """Turns by a mapping; ``get`` reads the text at a path, ``items`` the (role, text) structs of the array at one."""
    if isinstance(mapping, tuple):
        path, role, text = mapping
        return F.transform(items(path, role, text), lambda x: F.struct(_role(x[role]).alias("role"), F.coalesce(x[text].cast("string"), F.lit("")).alias("text")))

    def value(p: str) -> Column:
        parts = [F.coalesce(get(x), F.lit("")) for x in p.split("+")]
        return parts[0] if len(parts) == 1 else F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")

    return F.array(*(F.struct((value(r) if r[0] == "$" else F.lit(r)).alias("role"), value(t).alias("text")) for r, t in mapping))


def _field(record: Column, path: str) -> Column:
    for name in path.split(".")[1:]:
        record = record[name]
    return record


def canonical(df: DataFrame, record: str, out: str = "chat") -> DataFrame:
    """Adds ``out``: struct(fingerprint, layout, turns) of the column ``record``, a struct or JSON."""
    kind = df.schema[record].dataType
    if isinstance(kind, T.StructType):
        typed = hashlib.sha256(shape_of(kind).encode()).hexdigest()
        fixed = any(layout_hash(example) == typed for example, _ in LAYOUTS.values())
        row, f = F.col(record), free_name(df, "fingerprint")
        df = df.withColumn(f, F.lit(typed) if fixed else F.sha2(present(row, kind), 256))
        layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
        for name, (example, mapping) in LAYOUTS.items():
            if _readable(kind, mapping) and (not fixed or layout_hash(example) == typed):
                own = F.col(f) == layout_hash(example)
                layout = F.when(own, F.lit(name)).otherwise(layout)
                turns = F.when(own, _turns(mapping, lambda p: _field(row, p).cast("string"), lambda p, *_: _field(row, p)).cast(TURNS)).otherwise(turns)
        return df.withColumn(out, F.struct(F.col(f).alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))).drop(f)
    parsed = F.try_parse_json(F.col(record))
    too_long = parsed.isNull() & (F.length(record) >= LONGEST_JSON)
    held, f = free_name(df, "variant"), free_name(df, "fingerprint")
    v = F.col(held)
    df = df.withColumn(held, F.when(too_long, F.raise_error(F.lit("a record is too long for the JSON parser"))).otherwise(parsed)).withColumn(f, fingerprint(v))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for name, (example, mapping) in reversed(LAYOUTS.items()):
        own = F.col(f) == layout_hash(example)
        found = _turns(mapping, lambda p: F.variant_get(v, p, "string"), lambda p, role, text: F.variant_get(v, p, f"array<struct<`{role}`:string,`{text}`:string>>"))
        layout = F.when(own, F.lit(name)).otherwise(layout)
        turns = F.when(own, found.cast(TURNS)).otherwise(turns)
    return df.withColumn(out, F.struct(F.col(f).alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))).drop(held, f)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def formatted(df: DataFrame, turns: str, out: str = "chat") -> DataFrame:
    """Adds ``out``: struct(text, loss = array of (start, end) in code points: what the loss covers, the assistant texts)."""
    head = lambda t: F.when(t["role"] == "user", "[INST] ").when(t["role"] == "assistant", "[ASST] ").otherwise(F.concat(F.lit("[ROLE|"), F.url_encode(t["role"]), F.lit("] ")))
    tail = lambda t: F.when(t["role"] == "user", " [/INST]").otherwise("</s>")
    pieces = free_name(df, "pieces")
    df = df.withColumn(pieces, F.transform(turns, lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escaped(t["text"]).alias("body"), tail(t).alias("tail"))))
    text = F.concat(F.lit(START), F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], p["tail"])), ""))
    span = "array<struct<start:int,end:int>>"
    begin = F.struct(F.lit(len(START)).alias("at"), F.array().cast(span).alias("loss"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        more = F.when(p["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(span))
        return F.struct((end + F.length(p["tail"])).alias("at"), F.concat(a["loss"], more).alias("loss"))

    return df.withColumn(out, F.struct(text.alias("text"), F.aggregate(pieces, begin, step, lambda a: a["loss"]).alias("loss"))).drop(pieces)


def read_back(df: DataFrame, chat: str = "chat", out: str = "back") -> DataFrame:
    """Adds ``out``: struct(turns, loss = the unescaped texts under the loss mask), from the formatted text alone and its mask."""
    turn = r"(?s)\[(INST|ASST|ROLE\|[^\]]*)\] (.*?)(?: \[/INST\]|</s>)"
    text = F.col(chat)["text"]
    marks, bodies = free_name(df, "marks"), free_name(df, "bodies")
    df = df.withColumns({marks: F.regexp_extract_all(text, F.lit(turn), F.lit(1)), bodies: F.regexp_extract_all(text, F.lit(turn), F.lit(2))})
    role = lambda m: F.when(m == "INST", "user").when(m == "ASST", "assistant").otherwise(F.url_decode(F.substring(m, 6, 1 << 30)))
    turns = F.zip_with(marks, bodies, lambda m, b: F.struct(role(m).alias("role"), unescaped(b).alias("text")))
    loss = F.transform(F.col(chat)["loss"], lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
    return df.withColumn(out, F.struct(turns.alias("turns"), loss.alias("loss"))).drop(marks, bodies)


#: Fixed value: the text of both turns of conversation -1.
OWN = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(OWN).alias("text"))
    records = rows.unionByName(own).select("conv_id", "turn", F.struct("role", "text").alias("record"))
    turns = canonical(records, "record").select("conv_id", "turn", F.explode("chat.turns").alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t.role", "t.text"))).alias("turns"))
    done = read_back(formatted(convs, "turns"))
    flat = F.array_join(F.transform("back.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("back.loss", "")
    return done.select(
        "conv_id", F.size("back.turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("chat.text").cast("long").alias("formatted_chars"),
    )


SQL = rf"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{OWN}' union all select -1, 1, 'assistant', '{OWN}'),
e as (select *, regexp_replace(text, '([<\[])(\\*){CONTROL}', '\1\\\2\3', 'g') as esc from r),
p as (select *, case role when 'user' then 7 + length(esc) + 8 when 'assistant' then 7 + length(esc) + 4
  else 8 + length(replace(url_encode(role), '%20', '+')) + length(esc) + 4 end as piece from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(piece))::bigint as formatted_chars
from p group by conv_id
"""

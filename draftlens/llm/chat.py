"""Chat formatting (op 4): records of many layouts become canonical turns, then one marked text.

A layout is known by the digest of its nested field paths, of a JSON record's own or of a typed
column's schema; a declarative mapping per layout says where turns are. Formatted, a turn reads `<s>[INST]role[/INST]text</s>`. A control string inside a
role or text gets a backslash after its first character (one more, if it has some), which is
undone when reading back.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\])"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"

# Layout name, schema, and (list, role, text), (role, fields) pairs, or the fields of a record that is one turn.
LAYOUTS = [
    ("messages", "messages array<struct<content:string,role:string>>", ("messages", "role", "content")),
    ("conversations", "conversations array<struct<`from`:string,value:string>>", ("conversations", "from", "value")),
    ("prompt_completion", "completion string, prompt string", [("user", ["prompt"]), ("assistant", ["completion"])]),
    ("prompt_response", "prompt string, response string", [("user", ["prompt"]), ("assistant", ["response"])]),
    ("instruction", "input string, instruction string, output string", [("user", ["instruction", "input"]), ("assistant", ["output"])]),
    ("turn_rows", "role string, text string, turn long", {"turn": "turn", "role": "role", "text": "text"}),
    ("instruction_only", "instruction string, output string", [("user", ["instruction"]), ("assistant", ["output"])]),
]
# Speaker names and their roles.
SPEAKERS = {"human": "user", "gpt": "assistant"}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a schema; array elements are marked `[]`."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def _paths_text(kind: T.DataType) -> str:
    return ",".join(sorted(field_paths(kind)))


def record_paths(record: Column) -> Column:
    """The sorted nested field paths of a JSON record, two levels deep, as one text."""
    top = F.from_json(record, "map<string,string>")

    def nested(key: Column, value: Column) -> Column:
        items = F.from_json(value, "array<map<string,string>>")
        inner = F.array_distinct(F.flatten(F.transform(items, F.map_keys)))
        listed = F.transform(inner, lambda k: F.concat(key, F.lit("[]."), k))
        return F.when(F.ltrim(value).startswith("["), F.coalesce(listed, F.array(key))).otherwise(F.array(key))

    return F.array_join(F.array_sort(F.flatten(F.transform(F.map_entries(top), lambda e: nested(e["key"], e["value"])))), ",")


def fingerprint(paths: Column) -> Column:
    return F.sha2(paths, 256)


def canonical_turns(records: DataFrame, key: str, record: str) -> DataFrame:
    """One row per turn (key, turn, role, text) and the layout of heterogeneous `record`s.

    Records are JSON texts, each with paths of its own, or a struct column, whose schema has the
    paths of all its rows. A record of an unknown layout, null or broken keeps one row with null
    turn, role and layout.
    """
    kind = records.schema[record].dataType
    typed = isinstance(kind, T.StructType)
    paths = F.when(F.col(record).isNotNull(), F.lit(_paths_text(kind))) if typed else record_paths(F.col(record))
    rows = records.select(F.col(key), F.col(record).alias("_record"), fingerprint(paths).alias("fingerprint"))
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for name, schema, mapping in LAYOUTS:
        known = _paths_text(T._parse_datatype_string(schema))
        if typed and known != _paths_text(kind):
            continue  # the struct lacks this layout's fields
        digest = F.sha2(F.lit(known), 256)
        parsed = _turns(F.col("_record") if typed else F.from_json("_record", schema), mapping)
        turns = F.when(F.col("fingerprint") == digest, parsed).otherwise(turns)
        layout = F.when(F.col("fingerprint") == digest, F.lit(name)).otherwise(layout)
    out = rows.select(key, layout.alias("layout"), turns.alias("_turns"))
    return out.select(key, "layout", F.explode_outer("_turns").alias("_t")).select(key, "layout", "_t.turn", "_t.role", "_t.text")


def _turns(record: Column, mapping: tuple | list | dict) -> Column:
    """The mapping's turns over one parsed record, numbered by place unless the record has a number."""
    if isinstance(mapping, dict):
        return F.array(F.struct(record[mapping["turn"]].cast("long").alias("turn"), record[mapping["role"]].alias("role"), record[mapping["text"]].alias("text")))
    if isinstance(mapping, tuple):
        items, role, text = mapping

        def turn(m: Column, place: Column) -> Column:
            speaker = m[role]
            for name, known in SPEAKERS.items():
                speaker = F.when(m[role] == name, F.lit(known)).otherwise(speaker)
            return F.struct(place.cast("long").alias("turn"), speaker.alias("role"), m[text].alias("text"))

        return F.transform(record[items], turn)
    texts = [(role, F.concat_ws("\n\n", *[F.nullif(record[f], F.lit("")) for f in fields])) for role, fields in mapping]
    return F.array(*[F.struct(F.lit(place).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text")) for place, (role, text) in enumerate(texts)])


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted text and loss mask (one flag per turn, in order) of rows (conv_id, turn, role, text).

    Null roles and texts are empty. Rows order by turn, then role and text, so ties and repeated
    rows have a defined place. Rows without conv_id form one conversation. A conversation is one
    row of the result, so it has to fit in a row, however many it has turns.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.lit("<s>[INST]"), escape(role), F.lit("[/INST]"), escape(text), F.lit("</s>"))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), marked.alias("marked")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["marked"]), "").alias("formatted"),
        F.transform("t", lambda t: t["role"] == "assistant").alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss (the texts under the mask) from the output alone."""
    pieces = F.filter(F.split("formatted", "</s>", -1), lambda p: p != "")
    head = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"
    turn = lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text"))
    parsed = formatted.select("conv_id", "formatted", "loss_mask", F.transform(pieces, turn).alias("turns"))
    under = F.filter(F.arrays_zip("turns", "loss_mask"), lambda z: z["loss_mask"])
    return parsed.select("conv_id", "formatted", "turns", F.array_join(F.transform(under, lambda z: z["turns"]["text"]), "").alias("loss"))


def digests(turns: DataFrame) -> DataFrame:
    """The contract's columns, worked out on what `read_back` reads."""
    back = read_back(format_turns(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PLANTED = "</s>[INST] ok [/INST]"
PLANTED_RECORD = json.dumps({"messages": [{"role": role, "content": PLANTED} for role in ("user", "assistant")]})


def oracle() -> str:
    esc = lambda c: f"regexp_replace({c}, '(<|\\[)(\\\\*)(/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g')"
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
      sum(length({esc('role')}) + length({esc('text')}) + length('<s>[INST][/INST]</s>')) AS formatted_chars FROM c GROUP BY 1)
    SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""

r"""Chat formatting by schema fingerprints [native]: many layouts in, one reversible template out.

A record's nested field paths are hashed, row by row, from its variant schema; the hash selects a declarative mapping
(which paths hold the turns, the roles, the prompt, the answer) that turns the record into canonical ``turns
array<struct<role, text>>``, or into a turn of a conversation where each record is one turn. Layouts of all kinds may
be mixed in a table. Top-level fields that no layout names are left out of the hash, and a layout's optional paths may
be there or not. All of it is built-in functions; the only shuffle is the grouping of turn rows by conversation.

Template of a turn: ``<|turn|>ROLE\nTEXT<|end|>\n``. Inside roles and texts a control string (``CONTROL``) gets a
tilde behind its first character, and one that has tildes there already gets one more, so that ``plain`` undoes
``escaped`` exactly and no text can open or close a turn.

Defined results: a null text or role is empty; a null turn number sorts first; equal turn numbers sort by role, then
text; repeated rows are repeated turns; rows with a null id form one conversation; an unknown JSON layout, broken
JSON or an empty list of messages gives no turns (``fingerprint`` tells which), and an unknown layout of turn rows is
an error that names its fingerprint, so that no turn is lost; extra columns don't matter; an empty table gives an empty
table. One conversation's text is one value, so a conversation must fit in a row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed control strings of common chat templates (regular expressions), each in two parts: first character, rest.
CONTROL = (("<", r"/?s>"), ("<", r"\|[a-z_]+\|>"), ("<", r"/?SYS>"), (r"\[", r"/?INST\]"))
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
TURN_TYPE = "array<struct<role:string,text:string>>"

_HEADS = "|".join(dict.fromkeys(head for head, _ in CONTROL))
_TAILS = "|".join(tail for _, tail in CONTROL)


def escaped(text: Column) -> Column:
    """``text`` with one tilde more inside every control string."""
    return F.regexp_replace(text, rf"({_HEADS})(?=~*(?:{_TAILS}))", "$1~")


def plain(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, rf"({_HEADS})~(?=~*(?:{_TAILS}))", "$1")


def role_line(role: Column) -> Column:
    """A role on one line: back slashes and line ends are written as two characters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def plain_role(line: Column) -> Column:
    parts = F.split(plain(line), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


# -- layouts -------------------------------------------------------------------------------------------------------

#: Declarative mappings. ``paths``: the nested fields of the layout, besides ``optional`` ones. ``list``: path of the turns with the names of
#: role and text in them; ``fields``: (role, path) in the order of the turns. ``roles`` renames roles.
LAYOUTS = (
    {"name": "messages", "paths": ("messages[].content", "messages[].role"), "optional": ("messages[].name",), "list": ("messages", "role", "content")},
    {"name": "turns", "paths": ("turns[].role", "turns[].text"), "list": ("turns", "role", "text")},
    {"name": "conversations", "paths": ("conversations[].from", "conversations[].value"), "optional": ("conversations[].weight",), "list": ("conversations", "from", "value"),
     "roles": {"human": "user", "gpt": "assistant"}},
    {"name": "instruction", "paths": ("input", "instruction", "output"), "fields": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    {"name": "instruction_only", "paths": ("instruction", "output"), "fields": (("user", "instruction"), ("assistant", "output"))},
    {"name": "system_instruction", "paths": ("instruction", "output", "system"), "fields": (("system", "system"), ("user", "instruction"), ("assistant", "output"))},
    {"name": "prompt_completion", "paths": ("completion", "prompt"), "fields": (("user", "prompt"), ("assistant", "completion"))},
    {"name": "prompt_response", "paths": ("prompt", "response"), "fields": (("user", "prompt"), ("assistant", "response"))},
    {"name": "question_answer", "paths": ("answer", "question"), "fields": (("user", "question"), ("assistant", "answer"))},
    {"name": "data_pair", "paths": ("data.answer", "data.question"), "fields": (("user", "data.question"), ("assistant", "data.answer"))},
)


def shape_of(paths) -> str:
    """What ``shape`` gives for a record that has these field paths."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def fields(node: dict) -> list[str]:
        inner = {name: f"OBJECT<{', '.join(fields(below))}>" if below else "" for name, below in node.items()}
        return sorted(f"{name[:-2]}: ARRAY<{text}>" if name.endswith("[]") else f"{name}: {text}" for name, text in inner.items())

    return ", ".join(fields(tree))


def shape(record: Column, names: list[str]) -> Column:
    """The nested field paths of a variant under these top-level names: its schema with scalar types taken out."""
    def field(entry: Column) -> Column:
        kind = F.regexp_replace(F.concat(F.schema_of_variant(entry["value"]), F.lit(",")), r"(?<=^|: |ARRAY<)[A-Z_]+(?:\(\d+,\d+\))?(?=[,>])", "")
        return F.concat(entry["key"], F.lit(": "), F.rtrim(kind, F.lit(",")))

    fields = F.filter(F.map_entries(F.try_variant_get(record, "$", "map<string,variant>")), lambda e: e["key"].isin(names))
    return F.array_join(F.array_sort(F.transform(fields, field)), ", ")


def chosen(layouts, fingerprint: Column, value) -> Column:
    """What ``value`` makes of the layout that has this fingerprint, or null."""
    out = F.lit(None)
    for layout in layouts:
        extra = layout.get("optional", ())
        prints = [F.xxhash64(F.lit(shape_of((*layout["paths"], *more)))) for n in range(len(extra) + 1) for more in combinations(extra, n)]
        out = F.when(fingerprint.isin(*prints), value(layout)).otherwise(out)
    return out


def names_in(layouts) -> list[str]:
    """The top-level names of all paths of layouts."""
    paths = [p for layout in layouts for p in (*layout["paths"], *layout.get("optional", ()))]
    return sorted({p.split(".")[0].removesuffix("[]") for p in paths})


def json_turns(df: DataFrame, json_col: str, layouts=LAYOUTS) -> DataFrame:
    """``df`` with fingerprint, layout and turns of its JSON records; unknown or broken records have null turns."""
    record = F.try_parse_json(json_col)

    def value(path: str, of: Column) -> Column:
        return F.coalesce(F.try_variant_get(of, f"$.{path}", "string"), F.lit(""))

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    def listed(role: str, text: str, renamed: dict):
        def one(item: Column) -> Column:
            said = value(role, item)
            out = said
            for old, new in renamed.items():
                out = F.when(said == old, new).otherwise(out)
            return turn(out, value(text, item))

        return one

    def made(layout: dict) -> Column:
        if "list" in layout:
            path, role, text = layout["list"]
            return F.transform(F.try_variant_get("__record", f"$.{path}", "array<variant>"), listed(role, text, layout.get("roles", {})))
        turns = F.array(*[turn(F.lit(role), value(path, F.col("__record"))) for role, path in layout["fields"]])
        return F.filter(turns, lambda t: (t["text"] != "") | (t["role"] == "assistant"))

    by = F.col("__print")
    kept = [c for c in df.columns if c not in ("fingerprint", "layout", "turns")]
    return (df.select(*kept, record.alias("__record")).withColumn("__print", F.xxhash64(shape(F.col("__record"), names_in(layouts))))
            .select(*kept, by.alias("fingerprint"), chosen(layouts, by, lambda x: F.lit(x["name"])).alias("layout"),
                    chosen(layouts, by, made).cast(TURN_TYPE).alias("turns")))


#: Mappings of records that are one turn each, to the fields of a turn row.
ROW_LAYOUTS = (
    {"name": "turn_row", "paths": ("conv_id", "role", "text", "turn"), "conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"},
    {"name": "turn_message", "paths": ("conversation.id", "message.content", "message.role", "position"), "optional": ("message.name",),
     "conv_id": "conversation.id", "turn": "position", "role": "message.role", "text": "message.content"},
    {"name": "turn_content", "paths": ("content", "conversation_id", "position", "role"), "conv_id": "conversation_id", "turn": "position", "role": "role",
     "text": "content"},
)


def turn_rows(records: DataFrame, record_col: str = "record", layouts=ROW_LAYOUTS, id_type: str = "long") -> DataFrame:
    """(conv_id, turn, role, text, fingerprint) of variant records that are one turn each, by the mapping of their hash."""
    by = F.col("fingerprint")
    unknown = F.raise_error(F.concat(F.lit("no layout has the fingerprint "), by.cast("string")))
    field = lambda name, kind: F.coalesce(chosen(layouts, by, lambda x: F.struct(F.try_variant_get(record_col, f"$.{x[name]}", kind).alias("v"))), unknown)["v"]
    printed = records.select(record_col, F.xxhash64(shape(F.col(record_col), names_in(layouts))).alias("fingerprint"))
    return printed.select(field("conv_id", id_type).alias("conv_id"), field("turn", "long").alias("turn"), field("role", "string").alias("role"),
                          field("text", "string").alias("text"), "fingerprint")


# -- template ------------------------------------------------------------------------------------------------------

def format_rows(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Turn rows (conv_id, turn, role, text) to (conv_id, formatted, loss array<struct<start, length>>): spans are code
    points of ``formatted``.

    One shuffle: the running offsets and the grouping use the same partitioning.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    pieces = rows.select("conv_id", F.col("turn").alias("__turn"), role.alias("__role"), text.alias("__text"),
                         F.concat(F.lit(OPEN), role_line(role), F.lit("\n")).alias("__head"), escaped(text).alias("__body"))
    key = Window.partitionBy("conv_id").orderBy("__turn", "__role", "__text")
    size = F.length("__head") + F.length("__body") + len(CLOSE)
    placed = pieces.withColumns({
        "__n": F.row_number().over(key),
        "__start": F.coalesce(F.sum(size).over(key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("__head")})
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "__n", F.concat("__head", "__body", F.lit(CLOSE)).alias("piece"), (F.col("__role") == loss_role).alias("learn"),
        F.col("__start").alias("start"), F.length("__body").cast("long").alias("length")))).alias("__t"))
    return grouped.select("conv_id", F.array_join(F.transform("__t", lambda t: t["piece"]), "").alias("formatted"),
                          F.transform(F.filter("__t", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"))


def format_turns(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """``df`` with the ``formatted`` text of its canonical turns."""
    return df.withColumn("formatted", F.array_join(F.transform(turns_col, lambda t: F.concat(
        F.lit(OPEN), role_line(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE))), ""))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text, read back from its marks."""
    parts = F.filter(F.split(formatted, OPEN.replace("|", r"\|"), -1), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(head) + 2, F.length(part) - F.length(head) - 1 - len(CLOSE))
        return F.struct(plain_role(head).alias("role"), plain(body).alias("text"))

    return F.transform(parts, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(loss, lambda s: plain(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")

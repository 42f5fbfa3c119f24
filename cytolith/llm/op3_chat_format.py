"""Chat formatting by schema fingerprints, with DataFrame functions only.

A layout is a declarative mapping that says where roles and texts are, with a fingerprint: the hash of the nested field
paths (``messages[].role``) that it needs, sorted. A frame or a JSON record fits a layout if the hash of those of its own
paths that the layout needs is that fingerprint; of the layouts that fit, the one that needs most paths is taken, the first
one of equals. So extra fields don't matter, whatever other layout knows them, and records of different layouts in one
column become canonical turns, an array of (role, text). A list has the paths of all its elements.

The template writes each turn as ``<turn ROLE>TEXT</turn>``. Inside texts and roles ``&``, ``<`` and ``[`` (and ``>`` in
roles) are written as references, so neither the template's own control strings nor the common ones of other templates
can stand there, and reading back is exact. The loss mask covers the texts of assistant turns.

Defined results: a null role or text is an empty one. Rows of a turn table are ordered by turn (null first), then role,
then text, and repeated rows are repeated turns; a null conversation id is one conversation. A record that fits no layout
(an empty list has no paths of elements, so it is one) has null turns and goes to a table of its own, with counts by paths,
not into the formatted ones; a typed frame that fits none is an error. Extra columns are ignored; an empty table gives an
empty result. A conversation is one row of the result, so memory follows the longest one; very long texts and very many
turns take time in proportion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, let, running, slices

ASSISTANT = "assistant"
TURNS = "array<struct<role:string,text:string>>"
#: Characters and their references, in the order of writing.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLE_REFERENCES = (*REFERENCES, (">", "&gt;"))
END = "</turn>"


@dataclass(frozen=True)
class Layout:
    """Where turns are: in a list of messages, in fixed fields with a role each, or in rows of a table."""

    name: str
    #: Path of the list, and the names of role and text in its elements.
    messages: tuple[str, str, str] | None = None
    #: (role, path) in turn order, before the messages if there are any.
    fields: tuple[tuple[str, str], ...] = ()
    #: (conversation, turn, role, text) of a table with a row for each turn.
    rows: tuple[str, str, str, str] | None = None
    #: Paths that may be missing; null or empty, they give no turn.
    optional: frozenset[str] = frozenset()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> frozenset[str]:
        """What it needs."""
        return self.known - self.optional

    @property
    def known(self) -> frozenset[str]:
        listed = (self.messages[0], *(f"{self.messages[0]}[].{x}" for x in self.messages[1:])) if self.messages else ()
        return frozenset((*listed, *(self.rows or ()), *(path for _, path in self.fields)))


HUMAN = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
SYSTEM = ("system", "system")
NO_SYSTEM = frozenset({"system"})
LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", messages=("messages", "role", "content"), fields=(SYSTEM,), optional=NO_SYSTEM),
    Layout("conversation", messages=("conversation", "role", "content"), fields=(SYSTEM,), optional=NO_SYSTEM),
    Layout("sharing", messages=("conversations", "from", "value"), fields=(SYSTEM,), optional=NO_SYSTEM, roles=HUMAN),
    Layout("prompt and response", fields=(SYSTEM, ("user", "prompt"), (ASSISTANT, "response")), optional=NO_SYSTEM),
    Layout("prompt and completion", fields=(SYSTEM, ("user", "prompt"), (ASSISTANT, "completion")), optional=NO_SYSTEM),
    Layout("instruction", fields=(SYSTEM, ("user", "instruction"), ("user", "input"), (ASSISTANT, "output")), optional=NO_SYSTEM | {"input"}),
    Layout("question and answer", fields=(SYSTEM, ("user", "question"), (ASSISTANT, "answer")), optional=NO_SYSTEM),
    Layout("nested data", fields=(("user", "data.prompt"), (ASSISTANT, "data.response"))),
)
KNOWN = frozenset().union(*(x.known for x in LAYOUTS))


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a schema; ``[]`` stands for a list's elements. Names with dots or brackets are no paths."""
    if isinstance(kind, T.StructType):
        found = set()
        for f in kind.fields:
            if not set(f.name) & set(".[]`"):
                path = f"{at}.{f.name}" if at else f.name
                found |= {path} | field_paths(f.dataType, path)
        return found
    return field_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else set()


def fingerprint(paths: set[str] | frozenset[str]) -> int:
    """Hash of some field paths, as Spark's xxhash64 of them, sorted and joined."""
    value = xxhash.xxh64_intdigest("|".join(sorted(paths)), 42)
    return value - (1 << 64) if value >> 63 else value


#: The layouts by fingerprint, those that need most first.
BY_FINGERPRINT = {fingerprint(x.paths): x for x in sorted(LAYOUTS, key=lambda x: -len(x.paths))}


def _turn(role: Column, text: Column, roles: dict[str, str]) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in roles.items():
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(layout: Layout, messages: Column | None, at) -> Column:
    """Turns of the fields (at gives a path's value), then of the messages. A field that may be missing gives none where it is empty."""
    listed = [(_turn(F.lit(role), at(path), {}), path in layout.optional) for role, path in layout.fields]
    said = F.concat(*[F.when(t["text"] == "", F.array().cast(TURNS)).otherwise(F.array(t)) if may_miss else F.array(t) for t, may_miss in listed]) if listed else F.array().cast(TURNS)
    if not layout.messages:
        return said
    _, role, text = layout.messages
    return F.concat(said, F.transform(F.coalesce(messages, F.array()), lambda m: _turn(m[role], m[text], layout.roles)))


def from_frame(df: DataFrame) -> DataFrame:
    """conv_id (for turn rows; else none) and turns of each conversation of a typed frame."""
    paths = field_paths(df.schema)
    layout = next((x for mark, x in BY_FINGERPRINT.items() if fingerprint(x.paths & paths) == mark), None)
    if layout is None:
        raise ValueError(f"no layout fits the fields {sorted(KNOWN & paths)}")
    if layout.rows:
        conv, turn, role, text = layout.rows
        rows = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), _turn(F.col(role), F.col(text), layout.roles).alias("said")).alias("t"))
        return rows.groupBy("conv_id").agg(F.collect_list("t").alias("t")).select("conv_id", F.transform(F.array_sort("t"), lambda t: t["said"]).alias("turns"))
    messages = F.filter(F.col(layout.messages[0]), lambda m: m.isNotNull()) if layout.messages else None
    return df.select(_turns(layout, messages, lambda path: F.col(path) if path in paths else F.lit(None).cast("string")).alias("turns"))


def _listed(record: Column, path: str) -> Column:
    """The objects of a list in a JSON record, as maps."""
    return F.filter(F.from_json(F.get_json_object(record, f"$.{path}"), "array<map<string,string>>"), lambda m: m.isNotNull())


def record_paths(record: Column) -> Column:
    """The known field paths that a JSON record has, sorted."""
    held = []
    for path in sorted(KNOWN):
        parent, _, name = path.rpartition(".")
        if parent.endswith("[]"):
            has = F.exists(_listed(record, parent[:-2]), lambda m: F.map_contains_key(m, name))  # noqa: B023
        else:
            has = F.array_contains(F.json_object_keys(F.get_json_object(record, f"$.{parent}") if parent else record), name)
        held.append(F.when(has, F.lit(path)))
    return F.array_compact(F.array(*held))


def _of_layout(paths: Column, results: list[tuple[Layout, Column]]) -> Column:
    """The result of the layout that fits some paths, null if none does."""
    cases = F
    for layout, result in results:
        own = F.filter(paths, lambda p: p.isin(*layout.paths))  # noqa: B023
        cases = cases.when(F.xxhash64(F.array_join(own, "|")) == fingerprint(layout.paths), result)
    return cases


RECORD_LAYOUTS = [x for x in BY_FINGERPRINT.values() if not x.rows]


def from_records(record: Column) -> Column:
    """Turns of a column of JSON records, by each record's own layout; null if none fits."""
    at = lambda path: F.get_json_object(record, f"$.{path}")
    return let(record_paths(record), lambda paths: _of_layout(paths, [(x, _turns(x, _listed(record, x.messages[0]) if x.messages else None, at)) for x in RECORD_LAYOUTS]))


def format_records(df: DataFrame, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """Of a frame with a column of JSON records: the rows that fit a layout, with formatted and mask; and the others, with paths (known ones, joined)."""
    turns, paths = fresh(df, "turns"), fresh(df, "paths")
    told = df.withColumn(turns, from_records(F.col(record)))
    fits = told.filter(F.col(turns).isNotNull()).withColumn("formatted", formatted(F.col(turns))).drop(turns)
    rejects = told.filter(F.col(turns).isNull()).withColumn(paths, F.array_join(record_paths(F.coalesce(F.col(record), F.lit(""))), "|")).drop(turns)
    return fits.withColumn("mask", loss_mask(F.col("formatted"))), rejects


def reject_counts(rejects: DataFrame, paths: str = "paths") -> DataFrame:
    """paths, n of the records that fit no layout."""
    return rejects.groupBy(paths).agg(F.count("*").alias("n"))


def _written(text: Column, references: tuple[tuple[str, str], ...]) -> Column:
    for plain, ref in references:
        text = F.replace(text, F.lit(plain), F.lit(ref))
    return text


def _read(text: Column, references: tuple[tuple[str, str], ...]) -> Column:
    for plain, ref in reversed(references):
        text = F.replace(text, F.lit(ref), F.lit(plain))
    return text


def formatted(turns: Column) -> Column:
    """The template's text of an array of turns."""
    return F.array_join(F.transform(F.coalesce(turns, F.array().cast(TURNS)), lambda t: F.concat(F.lit("<turn "), _written(t["role"], ROLE_REFERENCES), F.lit(">"), _written(t["text"], REFERENCES), F.lit(END))), "")


def _pieces(text: Column) -> Column:
    """Turns as written, each without its end mark."""
    return F.filter(F.split(text, END), lambda p: p != "")


def _head(piece: Column) -> Column:
    return F.substring_index(piece, ">", 1)


def loss_mask(text: Column) -> Column:
    """Spans (start, end; code points, end exclusive) of a formatted text that the loss is taken over."""

    def spans(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x) + len(END)), lambda a, b: a + b)
        placed = F.zip_with(p, ends, lambda x, end: F.struct(_head(x).alias("head"), (end - len(END) - F.length(x) + F.length(_head(x)) + 1).alias("start"), (end - len(END)).alias("end")))
        return F.transform(F.filter(placed, lambda x: x["head"] == f"<turn {ASSISTANT}"), lambda x: F.struct(x["start"], x["end"]))

    return let(_pieces(text), spans)


def read_back(text: Column) -> Column:
    """Turns of a formatted text."""
    return F.transform(_pieces(text), lambda p: F.struct(
        _read(F.substring(_head(p), len("<turn ") + 1, F.length(p)), ROLE_REFERENCES).alias("role"),
        _read(F.substring(p, F.length(_head(p)) + 2, F.length(p)), REFERENCES).alias("text"),
    ))


def under_mask(text: Column, mask: Column) -> Column:
    """The texts under a mask, unescaped, one after the other."""
    return F.array_join(F.transform(slices(text, mask), lambda x: _read(x, REFERENCES)), "")


def format_conversations(df: DataFrame) -> DataFrame:
    """The conversations of a frame with formatted (text) and mask (loss spans)."""
    rows = from_frame(df)
    out = rows.withColumn("formatted", formatted(F.col("turns"))).drop("turns")
    return out.withColumn("mask", loss_mask(F.col("formatted")))


def report(df: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations of a table with a row for each turn."""
    done = format_conversations(df).withColumns({"back": read_back(F.col("formatted")), "loss": under_mask(F.col("formatted"), F.col("mask"))})
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )

"""Chat formatting by schema fingerprinting.

Records arrive in many layouts: turn rows, ``messages`` arrays, ``from``/``value``
arrays, instruction triples, prompt and answer pairs. The nested field paths of a
record are hashed; the hash selects a declarative mapping, and the mapping turns
the record into canonical turns ``(conv_id, turn, role, text)``. No mapping holds
code: it only names paths.

Canonical turns are rendered one segment a turn, so a conversation of any length
is never gathered in one value; ``read_back`` streams over sorted segments with
constant memory a conversation.

Defined results
* null role or text: empty string; null ``turn``: before every other turn.
* rows that repeat (also the same ``turn`` twice): kept, ordered by turn, role, text.
* null ``conv_id``: one conversation of its own.
* empty input: no turns; unknown layout: ``ValueError`` for a frame, and a row of
  ``unmatched_records`` for a JSON record.
* extra fields: ignored, also where they have names such as ``segment``; only
  paths that some mapping names enter the fingerprint.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- fingerprints


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. ``turns``: one array of messages, or fixed fields in order."""

    name: str
    paths: tuple[str, ...]
    array: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    flat: bool = False

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), role="role", text="text", flat=True),
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout("sharing", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("dialog", ("dialog[].speaker", "dialog[].utterance"), "dialog", "speaker", "utterance"),
    Layout("instruction_input", ("instruction", "input", "output"), fixed=(("user", "instruction"), ("user+", "input"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_completion", ("prompt", "completion"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("system", "prompt", "response"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("question", "answer"), fixed=(("user", "question"), ("assistant", "answer"))),
)
BY_FINGERPRINT = {x.fingerprint: x for x in LAYOUTS}
KNOWN_PATHS = frozenset(p for x in LAYOUTS for p in x.paths)
#: Other names of the two speaking roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves; ``[]`` marks an array level."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def layout_of(schema: T.StructType) -> Layout:
    """The mapping whose fingerprint the schema has, after fields no mapping names are left out."""
    known = [p for p in field_paths(schema) if p in KNOWN_PATHS]
    if (found := BY_FINGERPRINT.get(fingerprint_of(known))) is not None:
        return found
    inside = [x for x in LAYOUTS if set(x.paths) <= set(known)]
    if not inside:
        raise ValueError(f"no mapping for the layout {sorted(known)}")
    return max(inside, key=lambda x: (len(x.paths), x.name))


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.coalesce(names[F.lower(role)], role, F.lit(""))


def _from_record(layout: Layout, get) -> Column:
    """array<struct<role,text>> of one record; ``get`` gives a top-level field."""
    if layout.array:
        return F.transform(get(layout.array), lambda m: F.struct(_role(m[layout.role]).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text")))
    turns, joined = [], {}
    for role, name in layout.fixed:
        if role.endswith("+"):
            joined[role[:-1]] = name
    for role, name in layout.fixed:
        if role.endswith("+"):
            continue
        text = F.coalesce(get(name), F.lit(""))
        if role in joined:
            more = F.coalesce(get(joined[role]), F.lit(""))
            text = F.when(more == "", text).otherwise(F.concat(text, F.lit("\n\n"), more))
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns of a frame whose rows all have one layout."""
    layout = layout_of(df.schema)
    if layout.flat:
        return df.select(F.col(id_col).alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    each = df.select(F.col(id_col).alias("conv_id"), F.posexplode(_from_record(layout, F.col)).alias("turn", "m"))
    return each.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


_RECORD = T.StructType(
    [T.StructField(x.array, T.ArrayType(T.StructType([T.StructField(x.role, T.StringType()), T.StructField(x.text, T.StringType())]))) for x in LAYOUTS if x.array]
    + [T.StructField(n, T.StringType()) for n in sorted({n for x in LAYOUTS for _, n in x.fixed})]
)


def _field(name: str):
    return lambda m: m[name]


def _record_fingerprint(r: Column) -> Column:
    """The same hash for one parsed JSON record, from the paths that it holds."""
    present = []
    for x in LAYOUTS:
        if x.array:
            for leaf in (x.role, x.text):
                held = F.exists(F.transform(F.coalesce(r[x.array], F.array()), _field(leaf)), lambda v: v.isNotNull())
                present.append(F.when(held, F.lit(f"{x.array}[].{leaf}")))
    present += [F.when(r[n].isNotNull(), F.lit(n)) for n in sorted({n for x in LAYOUTS for _, n in x.fixed})]
    return F.sha2(F.array_join(F.array_sort(F.array_compact(F.array(*present))), "\n"), 256)


def json_turns(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns of JSON records of mixed layouts; each record picks its own mapping."""
    parsed = df.select(F.col(id_col).alias("conv_id"), F.from_json(F.col(json_col), _RECORD).alias("r"))
    parsed = parsed.withColumn("fp", _record_fingerprint(F.col("r")))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in LAYOUTS:
        if not x.flat:
            turns = F.when(F.col("fp") == x.fingerprint, _from_record(x, lambda n: F.col("r")[n])).otherwise(turns)
    each = parsed.select("conv_id", F.posexplode(turns).alias("turn", "m"))
    return each.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def unmatched_records(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """Records whose fingerprint no mapping has."""
    fp = _record_fingerprint(F.from_json(F.col(json_col), _RECORD))
    return df.select(F.col(id_col).alias("conv_id"), fp.alias("fingerprint")).filter(~F.col("fingerprint").isin(*BY_FINGERPRINT))


# -------------------------------------------------------------------- template

OPEN, MID, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates give a meaning, besides this template's own.
CONTROLS = (OPEN, MID, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_SPLIT = re.compile("|".join(f"({re.escape(c[0])})({re.escape(c[1:])})" for c in CONTROLS))
#: (first character)(rest) of any control string, in a form both Java and RE2 read.
_ANGLE = "|".join(re.escape(c[1:]).replace("\\<", "<").replace("\\>", ">") for c in CONTROLS if c[0] == "<")
_SQUARE = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "[")


def escape(text: Column) -> Column:
    """Reversible: backslashes double, and each control string gets one after its first character."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    angled = F.regexp_replace(doubled, f"<({_ANGLE})", "<\\\\$1")
    return F.regexp_replace(angled, f"\\[({_SQUARE})", "[\\\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One segment a turn: conv_id, turn, segment, loss_start, loss_end (code points in the segment; null where no loss)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID))
    body = escape(F.col("text"))
    trained = F.col("role").isin(*trained_roles)
    return turns.select(
        "conv_id", "turn", "role", "text",
        F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        F.when(trained, F.char_length(head)).cast("long").alias("loss_start"),
        F.when(trained, F.char_length(head) + F.char_length(body)).cast("long").alias("loss_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """One row a conversation: the formatted text and its loss spans. For conversations that fit one value."""
    got = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segment", "loss_start", "loss_end"))).alias("s"))
    before = F.transform("s", lambda x, i: F.aggregate(F.slice(F.col("s"), 1, i), F.lit(0).cast("long"), lambda n, y: n + F.char_length(y["segment"])))
    spans = F.transform(F.arrays_zip(F.col("s").alias("x"), before.alias("b")), lambda z: F.struct((z["b"] + z["x"]["loss_start"]).alias("start"), (z["b"] + z["x"]["loss_end"]).alias("end")))
    return got.select("conv_id", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"), F.filter(spans, lambda x: x["start"].isNotNull()).alias("loss_spans"))


_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse sorted segments; state is the digests of one conversation."""
    done: list[tuple] = []
    key, state = None, None

    def close() -> None:
        if state is not None:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(4)]
        for conv, segment, start, end in zip(*cols, strict=True):
            if state is None or conv != key:
                close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            cut = segment.index(MID)
            role = unescape(segment[len(OPEN) : cut])
            text = unescape(segment[cut + len(MID) : -len(CLOSE)])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[4] += len(segment)
            if start is not None:
                masked = unescape(segment[start:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
        if len(done) >= 2000:
            yield _back(done)
            done.clear()
    close()
    yield _back(done)


def _back(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _BACK.split(", ")])


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from rendered segments in order.

    Segments are dealt by conversation and sorted; the reader streams over them, so
    a conversation with a third of all rows costs time, not memory.
    """
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(_read_segments, _BACK)

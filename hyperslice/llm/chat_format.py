"""Chat formatting by schema fingerprints.

A record's nested field paths, sorted and hashed, are its schema's fingerprint. The
fingerprint selects a declarative mapping, which turns prompt, instruction, question
and message layouts into canonical turns; a schema that is met for the first time gets
the mapping of most fields that all its elements have, so further fields do no harm.
Turns are rendered by a template whose
control strings are escaped inside texts, reversibly; spans of assistant text form
the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, distinct_names, read


Path = tuple[str, ...]
#: Steps of a path: a field's name has a point before it, so no name looks like the step into a list.
ELEMENT, NO_ELEMENT = "[]", "[none]"
#: Nesting down to which paths are followed; what lies deeper counts as a leaf.
DEPTH = 32


def field_paths(value: Any, at: Path = ()) -> tuple[set[Path], set[Path]]:
    """Paths of the leaves of a nested record, and those that every element of each list has."""
    if len(at) < DEPTH and isinstance(value, dict) and value:
        parts = [field_paths(v, (*at, f".{k}")) for k, v in value.items()]
        return set().union(*(p for p, _ in parts)), set().union(*(e for _, e in parts))
    if len(at) < DEPTH and isinstance(value, list):
        if not value:
            return {(*at, NO_ELEMENT)}, {(*at, NO_ELEMENT)}
        parts = [field_paths(v, (*at, ELEMENT)) for v in value]
        return set().union(*(p for p, _ in parts)), set.intersection(*(e for _, e in parts))
    return {at}, {at}


def fingerprint(paths: set[Path], every: set[Path]) -> str:
    """The hash of the sorted paths, each with a mark of whether every element has it."""
    return hashlib.sha256(json.dumps([[*p, p in every] for p in sorted(paths)]).encode()).hexdigest()[:16]


def path_of(text: str) -> Path:
    """The path that a mapping writes as names with points, and [] behind a list."""
    steps: list[str] = []
    for part in text.split("."):
        steps += [f".{part.removesuffix(ELEMENT)}", *[ELEMENT] * part.endswith(ELEMENT)]
    return tuple(steps)


#: Mappings: the field paths of a layout, and its turns in order. A turn is (role, path of the text), or
#: (path of a list, field of the role, field of the text). Turns of an absent or empty optional field are left out.
LAYOUTS: list[tuple[tuple[str, ...], list[tuple]]] = [
    (("prompt", "response"), [("user", "prompt"), ("assistant", "response")]),
    (("prompt", "completion"), [("user", "prompt"), ("assistant", "completion")]),
    (("system", "prompt", "response"), [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    (("instruction", "output"), [("user", "instruction"), ("assistant", "output")]),
    (("instruction", "input", "output"), [("user", "instruction", "input"), ("assistant", "output")]),
    (("question", "answer"), [("user", "question"), ("assistant", "answer")]),
    (("messages[].role", "messages[].content"), [("messages", ("role",), ("content",))]),
    (("messages[].role", "messages[].content", "system"), [("system", "system"), ("messages", ("role",), ("content",))]),
    (("conversations[].from", "conversations[].value"), [("conversations", ("from",), ("value",))]),
    (("turns[].author.role", "turns[].content.text"), [("turns", ("author", "role"), ("content", "text"))]),
]
#: Layouts from the most fields down; of equally many the first stands.
_BY_SIZE = sorted(((tuple(map(path_of, paths)), mapping) for paths, mapping in LAYOUTS), key=lambda x: -len(x[0]))
#: Mappings of the fingerprints met so far; None: an unknown layout.
_KNOWN: dict[str, list[tuple] | None] = {}
SCHEMAS_KNOWN = 100_000
#: Names of roles in layouts with a field "from".
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_SURROGATE = re.compile("[\ud800-\udfff]")


def mapping_of(mark: str, every: set[Path]) -> list[tuple] | None:
    """The mapping that a fingerprint selects: of most fields, all of which every element has. A list may be empty."""
    if mark not in _KNOWN:
        if len(_KNOWN) >= SCHEMAS_KNOWN:
            _KNOWN.clear()
        empty = {p[:-1] for p in every if p[-1:] == (NO_ELEMENT,)}
        _KNOWN[mark] = next((m for paths, m in _BY_SIZE if all(p in every or (ELEMENT in p and p[: p.index(ELEMENT)] in empty) for p in paths)), None)
    return _KNOWN[mark]


def schema(record: Any) -> tuple[str, list[tuple] | None]:
    """A record's fingerprint and its mapping."""
    paths, every = field_paths(record)
    mark = fingerprint(paths, every)
    return mark, mapping_of(mark, every)


def canonical(record: Any) -> list[tuple[str, str]] | None:
    """(role, text) turns of a record, or None for an unknown layout. Null roles and texts are empty, other values are JSON; lone surrogates become U+FFFD."""
    mapping = schema(record)[1]
    if mapping is None:
        return None

    def at(value: Any, path: tuple) -> str:
        for k in path:
            value = value[k]
        text = "" if value is None else value if isinstance(value, str) else json.dumps(value)
        return _SURROGATE.sub("\ufffd", text)

    turns = []
    for first, *rest in mapping:
        if isinstance(rest[0], tuple):
            for x in record[first]:
                role = at(x, rest[0])
                turns.append((ROLES.get(role, role) if rest[0] == ("from",) else role, at(x, rest[1])))
        else:
            turns.append((first, "\n\n".join(t for p in rest if (t := at(record, (p,))) or len(rest) == 1)))
    return turns


BEGIN, END, AFTER_ROLE, AFTER_TURN = "<|im_start|>", "<|im_end|>", "\n", "\n"
#: Strings that control a model's template; none of them can overlap another.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
ESCAPE = "␛"
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(f"{ESCAPE}([01])")
_TURN = re.compile(f"{re.escape(BEGIN)}(.*?){AFTER_ROLE}(.*?){re.escape(END)}{AFTER_TURN}", re.DOTALL)


def escaped(text: str) -> str:
    """``text`` without control strings: an escape and 1 after the first character of each; an escape itself becomes escape, 0."""
    return _CONTROL.sub(lambda m: f"{m[0]}{ESCAPE}1", text.replace(ESCAPE, f"{ESCAPE}0"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == "0" else "", text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered text, and the (start, end) of the assistant's texts in it. A line feed in a role is escaped as well."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{BEGIN}{escaped(role).replace(AFTER_ROLE, f'{ESCAPE}2')}{AFTER_ROLE}"
        body = escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, END, AFTER_TURN
        at += len(head) + len(body) + len(END) + len(AFTER_TURN)
    return "".join(parts), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns that ``formatted`` has rendered."""
    return [(unescaped(m[1].replace(f"{ESCAPE}2", AFTER_ROLE)), unescaped(m[2])) for m in _TURN.finditer(text)]


def format_records(records: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """``keys`` plus layout (the schema's fingerprint), formatted, and mask (array of spans, code points) of JSON records.

    Unknown layouts (also where one element of a list lacks a field) have only their
    fingerprint; nulls, and what isn't JSON or is nested too deep for the parser, have null
    results; an empty list of messages gives an empty text. Further fields are ignored.
    Texts of any length; one record is one row: repeated rows give repeated results, an
    empty table an empty one. Columns that aren't in ``keys`` are ignored; a key with the
    name of a result is refused.
    """
    distinct_names(keys, ["layout", "formatted", "mask"])
    bounded_batches(records.sparkSession)
    chosen = records.select(*keys, F.col(record).alias("__record"))
    head = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[: len(keys)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(raw: str | None) -> tuple:
        try:
            value = json.loads(raw) if raw is not None else None
        except (ValueError, RecursionError):
            value = None
        if value is None:
            return None, None, None
        mark, turns = schema(value)[0], canonical(value)
        if turns is None:
            return mark, None, None
        text, spans = formatted(turns)
        return mark, text, [{"start": a, "end": b} for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(r) for r in b.column(len(keys)).to_pylist()]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), span))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *made], [*keys, "layout", "formatted", "mask"])

    return chosen.mapInArrow(run, f"{head}, layout string, formatted string, mask array<struct<start:bigint,end:bigint>>")


def read_back(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` plus counts and digests of the turns and of the text under the mask, taken from ``formatted`` and ``mask``; null texts give nulls."""
    distinct_names(keys, ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    bounded_batches(texts.sparkSession)
    chosen = texts.select(*keys, "formatted", "mask")
    head = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[: len(keys)])
    fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def one(text: str | None, mask: list | None) -> tuple:
        if text is None:
            return (None,) * 5
        turns = parsed(text)
        loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in mask)
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        return len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t, m) for t, m in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)]
            made = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *made], [*keys, *(n for n, _ in fields)])

    types = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in fields)
    return chosen.mapInArrow(run, f"{head}, {types}")


def records_of_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, record): rows of single turns gathered to JSON records, by turn, then role, then text (nulls first, as empty).

    The records have the layouts that such data come in: the key's hash chooses among
    those that hold the conversation's roles without loss, some with a further field. A
    conversation is one record, so its turns meet in one row (of 2 GB at most); rows with a
    null key make one conversation. An empty table gives an empty one.
    """
    message = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    gathered = turns.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(message)).alias("m"))
    chance = F.pmod(F.xxhash64("key"), F.lit(8))

    def said(i: int, name: str) -> Column:
        return F.get("m", F.lit(i))["content"].alias(name)

    def every(*fields: Column) -> Callable[[Column], Column]:
        return lambda m: F.struct(*[f(m) for f in fields])

    own_names = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    roles = F.transform("m", lambda m: m["role"])
    known = F.forall("m", lambda m: m["role"].isin("user", "assistant", "system"))
    pair, triple = (F.to_json(roles) == r for r in ('["user","assistant"]', '["system","user","assistant"]'))
    messages = F.transform("m", every(lambda m: m["role"].alias("role"), lambda m: m["content"].alias("content"))).alias("messages")
    conversations = F.transform("m", every(lambda m: own_names[m["role"]].alias("from"), lambda m: m["content"].alias("value"))).alias("conversations")
    nested = F.transform("m", every(lambda m: F.struct(m["role"].alias("role")).alias("author"), lambda m: F.struct(m["content"].alias("text")).alias("content"))).alias("turns")
    source = F.lit("chat").alias("source")
    record = (
        F.when(pair & (chance == 0), F.to_json(F.struct(said(0, "prompt"), said(1, "response"))))
        .when(pair & (chance == 1), F.to_json(F.struct(source, said(0, "question"), said(1, "answer"))))
        .when(pair & (chance == 2), F.to_json(F.struct(said(0, "instruction"), said(1, "output"))))
        .when(triple & (chance < 3), F.to_json(F.struct(said(0, "system"), said(1, "prompt"), said(2, "response"))))
        .when(known & chance.isin(3, 4), F.to_json(F.struct(conversations)))
        .when(known & (chance == 5), F.to_json(F.struct(source, nested)))
        .when(chance == 6, F.to_json(F.struct(messages, source)))
        .otherwise(F.to_json(F.struct(messages)))
    )
    return gathered.select(F.col("key").alias(key), record.alias("record"))


#: Conversation -1: a user and an assistant say the same, with control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and the planted one, formatted from records of several layouts and read back; empty texts for nulls."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    texts = format_records(records_of_turns(turns.unionByName(own)), ["conv_id"])
    return read_back(texts, ["conv_id"])


def _sql_escaped(column: str) -> str:
    pattern = "|".join(re.escape(c[0]) + "(" + re.escape(c[1:]) + ")" for c in CONTROL)
    return f"length({column}) + length({column}) - length(replace({column}, chr({ord(ESCAPE)}), '')) + 2 * len(regexp_extract_all({column}, '{pattern}'))"


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PLANTED}'), (-1, 1, 'assistant', '{PLANTED}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(BEGIN) + len(END) + 2} + {_sql_escaped("role")} + {_sql_escaped("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

"""Chat formatting: the fingerprint of a record's nested field paths selects a declarative mapping into canonical turns,
which a template with reversible escapes and a loss mask writes out and reads back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import read

#: Declarative mappings. "paths": the layout's field paths ([] stands for the elements of an array). Either "turns"
#: names the array with its role and text fields and how roles are renamed, or "parts" lists (role, fields) whose
#: non-empty texts are joined by a blank line.
MAPPINGS = {
    "messages": {"paths": ["messages", "messages[].role", "messages[].content"], "turns": ("messages", "role", "content"), "roles": {}},
    "from_value": {"paths": ["conversations", "conversations[].from", "conversations[].value"], "turns": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    "prompt_response": {"paths": ["prompt", "response"], "parts": (("user", ("prompt",)), ("assistant", ("response",)))},
    "prompt_completion": {"paths": ["prompt", "completion"], "parts": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "instruction": {"paths": ["instruction", "input", "output"], "parts": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "system_instruction": {"paths": ["system", "instruction", "input", "output"], "parts": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
}


def field_paths(value: object, at: str = "") -> set[str]:
    """All nested field paths of a JSON value; array elements share the path of their array with []."""
    found: set[str] = set()
    todo = [(value, at)]
    while todo:
        v, p = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                name = f"{p}.{k}" if p else k
                found.add(name)
                todo.append((x, name))
        elif isinstance(v, list):
            todo += [(x, f"{p}[]") for x in v]
    return found


def fingerprint(paths: set[str] | list[str]) -> str:
    """Hash of a set of field paths; their order doesn't count."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m["paths"]): name for name, m in MAPPINGS.items()}
#: An empty array shows no element paths.
BY_FINGERPRINT |= {fingerprint([m["turns"][0]]): name for name, m in MAPPINGS.items() if "turns" in m}


def canonical(record: str | None) -> tuple[str | None, str | None, list[tuple[str, str]] | None]:
    """Fingerprint, mapping and turns (role, text) of a JSON record. Mapping and turns are null where none fits, all three
    where the record is null or no JSON object. Null roles and texts: empty."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return None, None, None
    mark = fingerprint(field_paths(value))
    name = BY_FINGERPRINT.get(mark)
    if not name:
        return mark, None, None
    m = MAPPINGS[name]
    text = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    if "turns" in m:
        array, role, content = m["turns"]
        if not isinstance(value[array], list):
            return mark, None, None
        return mark, name, [(m["roles"].get(text(t[role]), text(t[role])), text(t[content])) for t in value[array]]
    parts = [(role, "\n\n".join(x for f in fields if (x := text(value[f])))) for role, fields in m["parts"]]
    return mark, name, [(r, t) for r, t in parts if r != "system" or t]


#: Template: what stands before and after an escaped text, by role; other roles are named in the marker itself.
USER, ASSISTANT, OTHER_ROLE = ("<s>[INST] ", " [/INST]"), (" ", " </s>"), ("<<ROLE:", ">>", "<</ROLE>>")
#: Control strings of the template, as regular expressions, and the escape character.
CONTROL = re.compile(r"\\|<(?=s>|/s>|<ROLE:|</ROLE>>)|\[(?=/?INST\])|>(?=>)|(?<=<)<(?=ROLE:)")
#: In a role's marker every one of these is escaped, as the marker's own end must stay apart from the role's.
ROLE_CONTROL = re.compile(r"[\\<>\[]")
ESCAPED = re.compile(r"\\([\\<>\[])")
TURN = re.compile(r"<s>\[INST\] ((?:\\.|[^\\])*?) \[/INST\]| ((?:\\.|[^\\])*?) </s>|<<ROLE:((?:\\.|[^\\])*?)>>((?:\\.|[^\\])*?)<</ROLE>>", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return ROLE_CONTROL.sub(lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the loss mask: spans of code points with the assistant's (escaped) texts."""
    out, mask, at = [], [], 0
    for role, text in turns:
        before, after = USER if role == "user" else ASSISTANT if role == "assistant" else (OTHER_ROLE[0] + escape_role(role) + OTHER_ROLE[1], OTHER_ROLE[2])
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(before), at + len(before) + len(body)))
        out.append(before + body + after)
        at += len(out[-1])
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render() wrote."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        user, assistant, role, other = m.groups()
        turns.append(("user", unescape(user)) if user is not None else ("assistant", unescape(assistant)) if assistant is not None else (unescape(role), unescape(other)))
        at = m.end()
    return turns


FORMATTED = "fingerprint string, mapping string, formatted string, mask array<struct<start:int,end:int>>"


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """The rows with fingerprint, mapping, formatted and mask (spans of code points). Where no mapping fits, formatted and
    mask are null and the fingerprint tells which layout is missing. Columns with these names are replaced."""
    names = ("fingerprint", "mapping", "formatted", "mask")

    @F.pandas_udf(FORMATTED)
    def put(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for x in p:
                mark, name, turns = canonical(x)
                text, mask = render(turns) if turns is not None else (None, None)
                rows.append((mark, name, text, mask and [{"start": a, "end": b} for a, b in mask] if mask is not None else None))
            yield pd.DataFrame({n: [r[i] for r in rows] for i, n in enumerate(names)})

    return records.drop(*names).withColumn("__f", put(F.col(column))).select("*", "__f.*").drop("__f")


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """The rows with what can be read from formatted and mask alone: the number of turns and their digest, the size and
    digest of the unescaped text under the mask. Null formatted: nulls. Columns with these names are replaced."""
    names = [f.split()[0] for f in READ.split(", ")]

    def one(text: str | None, mask: list | None) -> tuple:
        if text is None:
            return (None,) * 5
        h = hashlib.sha256()
        turns = parse(text)
        for role, body in turns:
            h.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in (mask if mask is not None else ()))
        return len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)

    @F.pandas_udf(READ)
    def get(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, mask in parts:
            rows = [one(t, m) for t, m in zip(text, mask, strict=True)]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="object" if "sha" in n else "Int64") for i, n in enumerate(names)})

    return formatted.drop(*names).withColumn("__r", get("formatted", "mask")).select("*", "__r.*").drop("__r")


def records(rows: DataFrame) -> DataFrame:
    """conv_id and record: each conversation's rows by turn (then role and text; null turns last) as one JSON record, in
    one of four layouts by conv_id, so that the fingerprints have something to tell apart. A conversation is one record
    and so held by one task, like any row. Layouts that cannot hold a conversation's roles give way to messages."""
    turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("turns")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pair = (F.size(t) == 2) & (F.get(t, F.lit(0))["role"] == "user") & (F.get(t, F.lit(1))["role"] == "assistant")
    plain = F.forall(t, lambda x: x["role"].isin("user", "assistant", "system"))
    way = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(4))
    first, second = F.get(t, F.lit(0))["text"], F.get(t, F.lit(1))["text"]
    as_from = F.transform(t, lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    record = (
        F.when(pair & (way == 2), F.to_json(F.struct(first.alias("prompt"), second.alias("response"))))
        .when(pair & (way == 3), F.to_json(F.struct(first.alias("instruction"), F.lit("").alias("input"), second.alias("output"))))
        .when(plain & (way == 1), F.to_json(F.struct(as_from.alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return whole.select("conv_id", record.alias("record"))


def op7(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_records(records(rows.unionByName(extra)))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "mapping")


QUERIES = {"op7_chat_format": op7}

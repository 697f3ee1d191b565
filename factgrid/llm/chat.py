"""Chat formatting: a finite-state machine over roles, and a declarative template that yields segments with loss flags.

A template names the control strings around each role's text and whether the text bears loss; TRANSITIONS says which role
may follow which. A conversation's rows, in order of turn, become segments (text, loss) whose concatenation is the
formatted string: control strings never bear loss, a text bears it as its role says. Inside texts, a backslash is doubled
and a control string gets a backslash after its first character, so no control string stands in a text and the texts can
be had back exactly. `parsed` reads a formatted string back into turns.

An order of roles that the machine doesn't accept makes the conversation invalid (`valid` false, `fault` the first turn
that doesn't fit); it is formatted all the same, and roles that the template doesn't know are written with their names.
Nulls: a null text is empty, a null role is the empty role, rows with a null conv_id form one conversation; null turns come
last, and rows with equal turns are ordered by role and text. An empty table gives an empty result. Other columns are left
out. A conversation is one record of the output, so its turns meet in one task; conversations are dealt by conv_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.llm.common import only, schema

TEMPLATE = {
    "begin": "<s>",
    "end": "</s>",
    "roles": {
        "system": {"before": "[SYS]", "after": "[/SYS]", "loss": False},
        "user": {"before": "[INST]", "after": "[/INST]", "loss": False},
        "assistant": {"before": "[ANS]", "after": "[/ANS]", "loss": True},
    },
    "other": {"before": "[TURN]", "named": "[/NAME]", "after": "[/TURN]", "loss": False},
}
#: State (the role before, None at the start): roles that may come.
TRANSITIONS = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
FINAL = {"user", "assistant"}


def controls(template: dict) -> list[str]:
    found = {template["begin"], template["end"], *(template["other"][k] for k in ("before", "named", "after"))}
    return sorted(found | {r[k] for r in template["roles"].values() for k in ("before", "after")}, key=lambda x: (-len(x), x))


def escaped(text: str, strings: list[str]) -> str:
    text = text.replace("\\", "\\\\")
    for s in strings:
        if s in text:
            text = text.replace(s, f"{s[0]}\\{s[1:]}")
    return text


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        if text[k + 1 : k + 2] == "\\":
            out.append("\\")
            at = k + 2
        else:
            at = k + 1
    return "".join(out) + text[at:]


def segments(turns: list[tuple[str, str]], template: dict) -> list[tuple[str, bool]]:
    """(text, loss) in order; their concatenation is the formatted conversation."""
    strings, other = controls(template), template["other"]
    out = [(template["begin"], False)]
    for role, text in turns:
        if rule := template["roles"].get(role):
            out += [(rule["before"], False), (escaped(text, strings), rule["loss"]), (rule["after"], False)]
        else:
            out += [(other["before"], False), (escaped(role, strings), False), (other["named"], False), (escaped(text, strings), other["loss"]), (other["after"], False)]
    return [*out, (template["end"], False)]


def fault(roles: list[str]) -> int | None:
    """The first turn that the machine doesn't accept; the number of turns if it may not end there; None if all is well."""
    state = None
    for k, role in enumerate(roles):
        if role not in TRANSITIONS.get(state, ()):
            return k
        state = role
    return None if state in FINAL else len(roles)


def parsed(formatted: str, template: dict) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    other, at, end = template["other"], len(template["begin"]), len(formatted) - len(template["end"])
    if not formatted.startswith(template["begin"]) or not formatted.endswith(template["end"]):
        raise ValueError("not a formatted conversation")
    turns = []

    def until(string: str) -> str:
        nonlocal at
        k = formatted.index(string, at)
        text, at = formatted[at:k], k + len(string)
        return unescaped(text)

    while at < end:
        for role, rule in template["roles"].items():
            if formatted.startswith(rule["before"], at):
                at += len(rule["before"])
                turns.append((role, until(rule["after"])))
                break
        else:
            if not formatted.startswith(other["before"], at):
                raise ValueError("not a formatted conversation")
            at += len(other["before"])
            turns.append((until(other["named"]), until(other["after"])))
    return turns


_OUT = "conv_id long, formatted string, segments array<struct<text: string, loss: boolean>>, valid boolean, fault int"


def _formatted(template: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            texts, parts, faults = [], [], []
            for rows in batch.column(1).to_pylist():
                turns = [(r["role"], r["text"]) for r in rows]
                own = segments(turns, template)
                parts.append([{"text": t, "loss": x} for t, x in own])
                texts.append("".join(t for t, _ in own))
                faults.append(fault([r for r, _ in turns]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(parts, kind), pa.array([f is None for f in faults], pa.bool_()), pa.array(faults, pa.int32())], names=["conv_id", "formatted", "segments", "valid", "fault"])

    return run


def formatted(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, formatted, segments, valid, fault of each conversation."""
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string")
    row = F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    slim = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return slim.mapInArrow(_formatted(template), schema(_OUT))


def _digests(template: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("formatted").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                turns = parsed(text, template)
                named = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                loss = "".join(unescaped(s["text"]) for s in own if s["loss"])
                out.append((len(turns), named, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, batch.column("valid")], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    return run


def digests(output: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """What the formatted strings and their segments hold, read back."""
    return output.mapInArrow(_digests(template), schema("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"))

"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags.

Rows are dealt by conversation and sorted by turn within their partitions; a task then streams over them and holds one
turn at a time, so a conversation may be longer than memory. `segments` emits for each turn an opening mark, the escaped
text and a closing mark, each with its loss flag; `read_back` parses the segments again into turns and a loss text.

Escapes: a backslash is doubled, and wherever a control string starts, overlapping ones included, a backslash comes behind
its first character, so no control string is left inside a text; dropping each backslash and keeping what follows it undoes
both. Control strings have two characters or more and hold no backslash. Null texts and roles are empty. Rows of one turn
go by role and text; repeated rows stay. Rows without a conv_id are one conversation, without a turn they come first. An order
that the machine does not allow is formatted all the same and flagged. An empty table gives the rows of an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is put around a turn, which roles are learnt, and which role may follow which ("" is the start or the end).
TEMPLATE = {
    "open": "### {role}:\n",
    "close": "</turn>\n",
    "control": ["###", "</turn>"],
    "loss": ["assistant"],
    "follows": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user", "tool", ""], "tool": ["assistant"]},
}


def escape(text: str, control: list[str]) -> str:
    starts = "|".join(map(re.escape, control))
    return re.sub(rf"(?=({starts})).", r"\g<0>\\", text.replace("\\", "\\\\"), flags=re.DOTALL)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str, control: list[str]) -> str:
    return escape(role, control).replace(":", "\\:").replace("\n", "\\\n")


class Machine:
    """State: the last role of the conversation. Emits one turn's segments."""

    def __init__(self, template: dict):
        self.template, self.conv, self.role, self.started = template, None, "", False

    def turn(self, conv: int | None, role: str, text: str) -> tuple[bool, list[tuple[str, bool]]]:
        if not self.started or conv != self.conv:
            self.conv, self.role, self.started = conv, "", True
        fine = role in self.template["follows"].get(self.role, [])
        self.role = role
        control = self.template["control"]
        opening = self.template["open"].replace("{role}", escape_role(role, control))
        return fine, [(opening, False), (escape(text, control), role in self.template["loss"]), (self.template["close"], False)]


def segments(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, role, turn_ok, segments ARRAY<STRUCT<text, loss>>): one row a turn, in order within its partition."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(template)
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for b in batches:
            ok, made = [], []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                fine, parts = machine.turn(conv, role, text)
                ok.append(fine)
                made.append([{"text": t, "loss": x} for t, x in parts])
            yield pa.RecordBatch.from_pydict({"conv_id": b.column("conv_id"), "role": b.column("role"), "turn_ok": pa.array(ok, pa.bool_()), "segments": pa.array(made, kind)})

    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(kernel, "conv_id bigint, role string, turn_ok boolean, segments array<struct<text:string,loss:boolean>>")


def read_back(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row a conversation from the output of `segments`, in whose partitions and order it has to be."""
    close, (before, behind) = template["close"], template["open"].split("{role}")
    header = re.compile(re.escape(before) + r"((?:\\.|[^\\:])*)" + re.escape(behind), re.DOTALL)
    ends = template["follows"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> dict:
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "ok": True, "role": ""}

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "order_ok")
            return pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, v, k in zip(names, cols, kinds, strict=True)})

        def row(conv: int | None, s: dict) -> tuple:
            return conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["ok"] and "" in ends.get(s["role"], [])

        conv, state = None, None
        for b in batches:
            done = []
            for c, ok, parts in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn_ok", "segments")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append(row(conv, state))
                    conv, state = c, fresh()
                text = "".join(p["text"] for p in parts)
                found = header.match(text)
                body = text[found.end() : text.index(close, found.end())]
                role, plain = unescape(found[1]), unescape(body)
                learnt = unescape("".join(p["text"] for p in parts if p["loss"]))
                state["turns"].update(f"{role}\n{plain}\n".encode())
                state["loss"].update(learnt.encode())
                state["n"] += 1
                state["loss_chars"] += len(learnt)
                state["chars"] += len(text)
                state["ok"] &= ok
                state["role"] = role
            if done:
                yield flush(done)
        yield flush([row(conv, state)] if state is not None else [])

    return formatted.mapInArrow(kernel, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, order_ok boolean")


def planted(spark: SparkSession) -> DataFrame:
    """A conversation whose texts look like the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")


def chat_report(conversations: DataFrame) -> DataFrame:
    """The contract columns of op7, and whether the machine allows the order."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(segments(rows.unionByName(planted(rows.sparkSession))))

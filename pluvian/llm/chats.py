"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before it
as context, and only that reply under the loss mask.

Template: `[INST] user text [/INST]`, `<s>assistant text</s>`, `[ROLE]name` newline `text[/ROLE]` for any other role. A control
string inside a text gets one backslash more before its last part (`</s>` becomes `</\\s>`, `</\\s>` becomes `</\\\\s>`), so none is
left, and taking one backslash away gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvian.llm.columns import own_names

ESCAPE = re.compile(r"(\[/?\\*(?=(?:INST|ROLE)\])|</?\\*(?=s>))")
UNESCAPE = re.compile(r"(\[/?\\*)\\(?=(?:INST|ROLE)\])|(</?\\*)\\(?=s>)")
TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|\[ROLE\](.*?)\n(.*?)\[/ROLE\]", re.S)


def escaped(text: str) -> str:
    return ESCAPE.sub(r"\1\\", text)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[1] or m[2], text)


def _role_out(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(text))


def shown(role: str, text: str) -> tuple[str, str, str]:
    """A turn as (before, escaped text, after)."""
    if role == "user":
        return "[INST] ", escaped(text), " [/INST]"
    if role == "assistant":
        return "<s>", escaped(text), "</s>"
    return f"[ROLE]{_role_out(role)}\n", escaped(text), "[/ROLE]"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of an example."""
    out = []
    for m in TURN.finditer(formatted):
        if m[1] is not None:
            out.append(("user", unescaped(m[1])))
        elif m[2] is not None:
            out.append(("assistant", unescaped(m[2])))
        else:
            out.append((_role_in(m[3]), unescaped(m[4])))
    return out


def format_chats(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv, example, text, loss_start, loss_end): one row per assistant turn, by `example` from 0.

    The loss mask is code points [loss_start, loss_end) of `text`. Turns behind the last reply, or all where there is none,
    come as one more example with an empty mask, so no turn is lost. Turns are ordered by `turn` (null first), then role,
    then text; repeated rows are turns of their own. Null roles and texts count as empty, a null conversation is one of its
    own, and an empty table gives no rows. Columns beyond the named ones are ignored.

    The last example of a conversation holds all of it in one row, so gathering a conversation asks for no more room than
    the result does.
    """
    rows = own_names(chats, conv, turn, role, text).toDF("conv", "turn", "role", "text").select(
        "conv", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                made, context, open_ = [], [], False
                for t in b.column(1)[i].as_py():
                    before, body, after = shown(t["role"], t["text"])
                    open_ = t["role"] != "assistant"
                    if not open_:
                        start = sum(map(len, context)) + len(before)
                        made.append(("".join([*context, before, body, after]), start, start + len(body)))
                    context.append(before + body + after)
                if open_:
                    rest = "".join(context)
                    made.append((rest, len(rest), len(rest)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([i] * len(made), pa.int64())), pa.array(range(len(made)), pa.int32()),
                     pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()),
                     pa.array([m[2] for m in made], pa.int64())],
                    ["conv", "example", "text", "loss_start", "loss_end"])
    kind = whole.schema["conv"].dataType.simpleString()
    return whole.mapInArrow(run, f"conv {kind}, example int, text string, loss_start bigint, loss_end bigint"
                            ).withColumnRenamed("conv", conv)


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, example, turns, loss_text, n_chars) of every example; turns are (role, text)."""
    rows = own_names(examples, conv, "example", "text", "loss_start", "loss_end")
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            loss = [unescaped(t[a:z]) for t, a, z in zip(texts, b.column(3).to_pylist(), b.column(4).to_pylist())]
            turns = [[{"role": r, "text": t} for r, t in turns_of(x)] for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(turns, turn), pa.array(loss, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [conv, "example", "turns", "loss_text", "n_chars"])
    kind = rows.schema[conv].dataType.simpleString()
    return rows.mapInArrow(run, f"`{conv}` {kind}, example int, turns array<struct<role:string,text:string>>, "
                                "loss_text string, n_chars bigint")

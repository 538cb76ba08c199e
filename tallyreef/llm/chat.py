"""Chat formatting whose output a deterministic parser turns back into the source turns."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Role -> opening and closing of a turn. Any other role is named in its opening.
TEMPLATE = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("<<ROLE:", ">> ", " <</ROLE>>")
#: Control strings, as they may not stand in a text.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>", ">> "]
_CONFLICT = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_END = {close: re.compile(r"\\.|" + re.escape(close), re.S) for close in [*(c for _, c in TEMPLATE.values()), OTHER[1], OTHER[2]]}
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape(text: str, level: int) -> str:
    """Level 0: as it is; 1: a backslash before control strings and backslashes; 2: one before every character."""
    if level == 0:
        return text
    return _CONFLICT.sub(lambda m: "\\" + m[0], text) if level == 1 else "".join("\\" + c for c in text)


def _until(text: str, at: int, close: str) -> int:
    """Where the first closing from at on stands that is not escaped; -1 if none."""
    for m in _END[close].finditer(text, at):
        if m[0][0] != "\\":
            return m.start()
    return -1


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn of a rendered conversation; None if it does not follow the grammar.

    start and end are where the escaped text stands. The grammar is read from left to right and by what the next turn
    opens with, so a conversation parses as its turns do one by one.
    """
    turns, at = [], 0
    while at < len(text):
        for role, (opening, close) in TEMPLATE.items():
            if text.startswith(opening, at):
                start = at + len(opening)
                break
        else:
            if not text.startswith(OTHER[0], at) or (named := _until(text, at + len(OTHER[0]), OTHER[1])) < 0:
                return None
            role, start, close = unescape(text[at + len(OTHER[0]) : named]), named + len(OTHER[1]), OTHER[2]
        end = _until(text, start, close)
        if end < 0:
            return None
        turns.append((role, unescape(text[start:end]), start, end))
        at = end + len(close)
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's rendering and where its text stands in it, escaped as far as it takes to parse back to the same turn."""
    for level in (0, 1, 2):
        inner = escape(text, level)
        if role in TEMPLATE:
            opening, close = TEMPLATE[role]
        else:
            opening, close = OTHER[0] + escape(role, level) + OTHER[1], OTHER[2]
        out = opening + inner + close
        start, end = len(opening), len(opening) + len(inner)
        if parse(out) == [(role, text, start, end)]:
            return out, start, end
    raise AssertionError(f"turn cannot be rendered: {role!r}")


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered turns: conv_id, seq, piece, loss_start, loss_end; a conversation's text is its pieces by seq.

    loss_start and loss_end bound the assistant's text in the piece and are null for other roles. Rows go by turn, ties by
    role and text; repeated rows are turns of their own; null texts and roles are empty; rows with a null conv_id form one
    conversation; further columns are left out. A task holds one batch of turns, however long the conversation.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn_"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text_"))
    dealt = rows.repartition(C.n_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn_", "role_", "text_").drop("turn_")

    def run(batches):
        current, seq = None, -1
        for pdf in batches:
            out = []
            for name, who, said in zip(pdf["conv_id"].astype("Int64").tolist(), pdf["role_"], pdf["text_"], strict=True):
                name = None if name is pd.NA else name
                current, seq = (name, seq + 1) if (name == current and seq >= 0) else (name, 0)
                piece, start, end = render_turn(who, said)
                loss = (start, end) if who == "assistant" else (None, None)
                out.append((name, seq, piece, *loss))
            yield pd.DataFrame(out, columns=["conv_id", "seq", "piece", "loss_start", "loss_end"]).astype({"conv_id": "Int64", "seq": "int64", "loss_start": "Int64", "loss_end": "Int64"})

    return dealt.mapInPandas(run, "conv_id long, seq long, piece string, loss_start long, loss_end long")


def digest(pieces: DataFrame) -> DataFrame:
    """What the rendered conversations say when parsed: turns, loss text and length of each.

    A conversation whose pieces do not follow the grammar fails the job. Digests are updated piece by piece.
    """
    spark = pieces.sparkSession
    dealt = pieces.repartition(C.n_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "seq")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        state = None

        def done():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for pdf in batches:
            out = []
            columns = [pdf[c].astype("Int64").tolist() for c in ("conv_id", "seq", "loss_start", "loss_end")]
            for name, seq, start, end, piece in zip(*columns, pdf["piece"], strict=True):
                name = None if name is pd.NA else name
                if seq == 0:
                    if state is not None:
                        out.append(done())
                    state = [name, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = parse(piece)
                if found is None:
                    raise ValueError(f"conversation {name} does not follow the grammar at turn {seq}")
                for role, said, _, _ in found:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if start is not pd.NA:
                    loss = unescape(piece[start:end])
                    state[3] += len(loss)
                    state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([done()], columns=names).astype({"conv_id": "Int64"})

    return dealt.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

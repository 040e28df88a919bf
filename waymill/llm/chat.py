"""Chat formatting: conversations as budgeted, turn-aligned training windows with a loss mask.

Template: `<<SYS>>text<</SYS>>` for a system turn, `[INST] text [/INST]` for a user's,
`[ANS] text </s>` for an assistant's, and `[TURN]role[ROLE]text[/TURN]` for any other role,
after `<s>` at a window's start. Inside texts and roles the characters that start control
strings, and the escape itself, are written as two-character escapes, so no text can hold a
control string and unescaping gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\o"}  # fixed values: escape, less-than, open bracket
_BACK = {v: k for k, v in ESCAPES.items()}
MARKS = {  # fixed values: what stands before and after a text, by role
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("[ANS] ", " </s>"),
}
START = "<s>"
OUT_CHARS = 1 << 22  # of windows that a task gathers before it hands them on
WINDOWS = (
    "conv_id long, window int, first_turn int, new_from int, last_turn int, n_tokens long, over_budget boolean, "
    "text string, spans array<struct<start:int,stop:int>>"
)
_TURN = re.compile(
    r"<<SYS>>(?P<system>[^<\[]*)<</SYS>>|\[INST\] (?P<user>[^<\[]*) \[/INST\]|\[ANS\] (?P<assistant>[^<\[]*) </s>"
    r"|\[TURN\](?P<role>[^<\[]*)\[ROLE\](?P<other>[^<\[]*)\[/TURN\]"
)


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _BACK[m[0]], text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text starts and stops."""
    before, after = MARKS.get(role) or (f"[TURN]{escape(role)}[ROLE]", "[/TURN]")
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window; ValueError if it isn't one."""
    at, turns = len(START), []
    if not window.startswith(START):
        raise ValueError("a window starts with its mark")
    while at < len(window):
        m = _TURN.match(window, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


def count_tokens(formatted: str) -> int:
    """Words, runs of digits and single other marks: a vocabulary-free stand-in for a tokenizer."""
    return len(_TOKEN.findall(formatted))


_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def windows(turns: Iterable[tuple[str, str]], budget: int, history: int, counter=count_tokens):
    """(first, new_from, last, tokens, text, spans) of the windows over one conversation's turns.

    Running sums of turn tokens choose each window's span: a leading system turn is retained in
    every window; before the new turns stand as many whole turns of repeated history as history
    tokens hold; new turns follow while the budget lasts, one at least. spans mark the new
    assistant texts, so every target is trained on once and repeated ones are masked. Turns are
    read as a stream: only one window and the history before it are held.
    """
    system: tuple | None = None  # (rendered, tokens)
    before: deque = deque()  # the last turns that history tokens hold
    held = 0  # their tokens
    line: list = []  # the window's turns, repeated ones first
    at = fresh = size = 0  # its first new turn, that one's place in line, and the tokens of all

    def window():
        text, spans = START, []
        shown = [system, *line] if system and at else line
        for k, ((part, start, stop, said), _) in enumerate(shown):
            if said and k >= len(shown) - len(line) + fresh:
                spans.append((len(text) + start, len(text) + stop))
            text += part
        return at - fresh, at, at + len(line) - fresh, size, text, spans

    for i, (role, text) in enumerate(turns):
        part = (*render(role, text), role == "assistant")
        turn = part, counter(part[0])
        if i == 0 and role == "system":
            system = turn
        if line and size + turn[1] > budget:
            yield window()
            for new in line[fresh:]:
                if new is not system:
                    before.append(new)
                    held += new[1]
            while held > history:
                held -= before.popleft()[1]
            line = []
        if not line:
            at, size = i, (system[1] if system and i else 0) + held + turn[1]
            line = list(before)
            while line and size > budget:
                size -= line.pop(0)[1]  # history gives way to the first new turn
            fresh = len(line)
        else:
            size += turn[1]
        line.append(turn)
    if line:
        yield window()


def format_conversations(conversations: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """Windows of conversations(conv_id, turn, role, text), one row a window.

    Turns go by turn, then role, then text; repeated rows stay. A null text or role is empty;
    a row with a null conv_id is a conversation of its own. first_turn to last_turn are positions,
    the turns from new_from on are new; over_budget tells a window whose one new turn is too long.
    Other columns are not read; no rows give no windows. A conversation is one sorted stream,
    however long: a task holds one of its windows, and a batch of windows to hand on.
    """
    names = ["conv_id", "window", "first_turn", "new_from", "last_turn", "n_tokens", "over_budget", "text", "spans"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    types = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.bool_(), pa.string(), span]

    def rows(batches):
        lone = 0
        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text")):
                lone += conv is None
                yield (conv, lone if conv is None else 0), (role or "", text.as_py() or "")

    def run(batches):
        out: list[tuple] = []
        chars = 0
        for (conv, _), group in groupby(rows(batches), key=itemgetter(0)):
            for k, (first, new, last, tokens, text, spans) in enumerate(windows(map(itemgetter(1), group), budget, history)):
                out.append((conv, k, first, new, last, tokens, tokens > budget, text, [{"start": s, "stop": e} for s, e in spans]))
                chars += len(text)
                if chars > OUT_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out)), types)], names)
                    out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out)), types)], names)

    # Rows without a conversation are dealt out by what they say, so many of them are no hot key.
    key = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.xxhash64("conv_id"))
    ordered = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition(key).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


def digest_windows(formatted: DataFrame) -> DataFrame:
    """What the windows of format_conversations() say when parsed back, a row a conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows(batches):
        lone = 0
        for batch in batches:
            small = batch.select(["conv_id", "new_from", "last_turn", "spans"]).to_pylist()
            for w, text in zip(small, batch.column("text")):
                lone += w["conv_id"] is None  # each is a conversation of one turn, and so of one window
                yield (w["conv_id"], lone if w["conv_id"] is None else 0), w, text.as_py()

    def run(batches):
        out = []
        for (conv, _), group in groupby(rows(batches), key=itemgetter(0)):
            n, turns, loss_chars, loss, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for _, w, text in group:
                parsed = parse(text)
                for role, said in parsed[len(parsed) - (w["last_turn"] - w["new_from"]) :]:
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in w["spans"]:
                    target = unescape(text[s["start"] : s["stop"]])
                    loss_chars += len(target)
                    loss.update(target.encode("utf-8", "surrogatepass"))
                chars += len(text)
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out)), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out)), types)], names)

    key = F.when(F.col("conv_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("conv_id"))
    ordered = formatted.repartition(key).sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

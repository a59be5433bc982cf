"""Chat formatting: conversations cut into budgeted, turn-aligned windows with a loss mask.

A turn is written ``### {role}: {text} </turn>\\n``.  Inside roles and texts a backslash goes before every backslash and
before the first character of every control string, so no text can look like a marker and the escape is undone exactly.

Windows: the running (prefix) sums of the turns' tokens choose the longest span of new turns that fits the budget with
what is repeated before it.  Every window after the first repeats the conversation's system turn, if its first turn is
one, and up to ``history`` turns before the new ones while these stay within a share of the budget.  Only the new
assistant turns are under the loss mask: what a window repeats is masked out, so each target is learnt once.

Rows are dealt by conversation, sorted within their partition and streamed, so a conversation of any length takes memory
for one window only; so are windows when they are read back, since files keep no order across their splits.

Defined results: null text or role reads as empty; turns are ordered by turn (null first), then role and text, so ties
and repeated rows have one order and each row is a turn; a turn longer than the budget is a window of its own, uncut; a
null conv_id is a conversation; an empty table gives no windows; other columns never take part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The control strings of the template.
TURN, MIDDLE, END = "### ", ": ", " </turn>\n"
CONTROL = ("###", "</turn>")

ESCAPED = re.compile(r"\\|(?=###)#|(?=</turn>)<")
ROLE_ESCAPED = re.compile(r"[\\#:<]")
UNESCAPED = re.compile(r"\\(.)", re.S)
PARSED = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\ ]++|\\.| (?!</turn>\n))*+) </turn>\n", re.S)

WINDOWS = "conv_id long, window int, first_turn long, n_repeated int, n_new int, n_tokens long, text string, spans array<struct<start:int,end:int>>"
WINDOW_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64()),
     ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)


def escape(text: str) -> str:
    r"""Put a backslash before backslashes and control strings.  A text's last '#' can't join what follows it:
    a turn's text is always followed by a blank and '<'."""
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return ROLE_ESCAPED.sub(lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


def count_tokens(text: str) -> int:
    """The default length of a turn: its words, and four for the markers."""
    return len(text.split()) + 4


def windows_of(turns: Iterable[tuple[str, str]], *, budget: int, history: int, share: float, tokens: Callable[[str], int]) -> Iterator[tuple]:
    """(first new turn, repeated turns, new turns, tokens, formatted text, loss spans) of one conversation's windows."""
    system: tuple[str, str, int] | None = None
    past: list[tuple[str, str, int]] = []  # the last turns that have been written as new ones
    new: list[tuple[str, str, int]] = []
    sums = [0]  # prefix sums over the turns of `new`
    start = number = 0

    def repeated() -> list[tuple[str, str, int]]:
        kept, used = [], 0
        for turn in reversed(past):
            if len(kept) == history or used + turn[2] > share * budget:
                break
            kept.append(turn)
            used += turn[2]
        return ([system] if system and start else []) + kept[::-1]

    def written() -> tuple:
        before, parts, spans, at = repeated(), [], [], 0
        for i, (role, text, _) in enumerate(before + new):
            head, body = f"{TURN}{escape_role(role)}{MIDDLE}", escape(text)
            if i >= len(before) and role == "assistant":
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += (head, body, END)
            at += len(head) + len(body) + len(END)
        return start, len(before), len(new), sum(t[2] for t in before) + sums[-1], "".join(parts), spans

    base = 0
    for role, text in turns:
        turn = (role, text, tokens(text))
        if new and base + sums[-1] + turn[2] > budget:
            yield written()
            keep = history if history > 0 else 0
            # the system turn is repeated on its own, never as history
            past = ([t for t in past + new if t is not system])[-keep:] if keep else []
            start, new, sums = number, [], [0]
            base = sum(t[2] for t in repeated())
        if number == 0 and role == "system":
            system = turn
        new.append(turn)
        sums.append(sums[-1] + turn[2])
        number += 1
    if new:
        yield written()


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    from itertools import groupby

    rows = (row for b in batches for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, ((role or "", text or "") for _, role, text in own)


def format_conversations(
    turns: DataFrame, *, budget: int = 1024, history: int = 2, share: float = 0.25, tokens: Callable[[str], int] = count_tokens
) -> DataFrame:
    """Windows of turns(conv_id, turn, role, text).  Those of a conversation stand together, in order, in one partition.

    spans: [start, end) in code points of the texts under the loss mask, as they stand escaped.
    """
    if budget < 1 or history < 0:
        raise ValueError("budget must be positive and history not negative")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for conv, own in _conversations(batches):
            for i, w in enumerate(windows_of(own, budget=budget, history=history, share=share, tokens=tokens)):
                out.append((conv, i, *w))
                held += len(w[4])
                if held > 4_000_000 or len(out) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), WINDOW_SCHEMA.types, strict=True)], schema=WINDOW_SCHEMA)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), WINDOW_SCHEMA.types, strict=True)], schema=WINDOW_SCHEMA)

    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, WINDOWS)


def parse_window(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window; raises if anything is left over."""
    out, at = [], 0
    for m in PARSED.finditer(text):
        if m.start() != at:
            raise ValueError("not a formatted window")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a formatted window")
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from its windows alone, in whatever order and partitions these are."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        names = ("conv_id", "n_repeated", "text", "spans")
        rows = (row for b in batches for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True))
        out = []
        for conv, own in groupby(rows, key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = n_loss = n_chars = n_windows = 0
            for _, repeated, text, spans in own:
                for role, said in parse_window(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for span in spans:
                    target = unescape(text[span["start"] : span["end"]])
                    loss.update(target.encode())
                    n_loss += len(target)
                n_chars += len(text)
                n_windows += 1
            out.append((conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars, n_windows))
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    dealt = windows.select("conv_id", "window", "n_repeated", "text", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

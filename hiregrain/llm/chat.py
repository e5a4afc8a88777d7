"""Chat formatting in budgeted windows.

The turns of a conversation, in order, are cut into windows of at most ``budget`` tokens. Prefix sums of the turns' tokens
choose turn-aligned spans: each window repeats the system turn that opened the conversation and the last turns before the
span, as many as fit in ``history`` tokens, and then takes new turns while they fit. Only the new assistant turns are in
the loss mask, so a target that is repeated as history is masked there and every target counts once.

Template: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Roles and texts are escaped so that
no control string can come from them: a backslash is doubled and ``<|`` becomes ``<`` backslash ``|``; a line feed in a role
becomes backslash ``n``. :func:`parse` undoes it.

Defined results: null texts and roles are empty; turns of equal number are ordered by role and text; a turn larger than
the budget is never cut but stands alone after the system turn with ``over_budget`` true; rows without a conversation id
form one conversation; an empty table gives no windows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrain.llm.tokens import chunk_ids

START, END = "<|im_start|>", "<|im_end|>\n"  # fixed values: the template's control strings
BUDGET, HISTORY = 1_024, 256
WINDOWS = (
    "conv_id long, window int, first_turn long, n_system int, n_history int, n_new int, n_tokens long, over_budget boolean, text string, loss array<struct<start:int,end:int>>"
)
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_WINDOW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("n_system", pa.int32()), ("n_history", pa.int32()),
    ("n_new", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string()), ("loss", _LOSS),
])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, parts = [], text.split("\\\\")
    for part in parts:
        out.append(part.replace("<\\|", "<|"))
    return "\\".join(out)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text starts and ends."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    turns = []
    for part in text.split(START)[1:]:
        head, _, body = part.partition("\n")
        role = "\\".join(p.replace("\\n", "\n").replace("<\\|", "<|") for p in head.split("\\\\"))
        turns.append((role, unescape(body[: -len(END)])))
    return turns


class Windows:
    """Windows of one conversation, turn by turn; holds one window and the history before it, never more."""

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None
        self.turns: list[tuple[str, int, int, bool]] = []  # formatted, text start, text end, is a target
        self.sums = [0]  # prefix sums of tokens over self.turns
        self.first = self.seen = self.number = 0  # first: where the new turns begin in self.turns
        self.opening = False  # the current window holds the system turn as a new turn

    def add(self, role: str, text: str, formatted: tuple[str, int, int], tokens: int) -> Iterator[dict]:
        if self.seen == 0 and role == "system":
            self.system, self.opening, self.seen = (formatted[0], tokens), True, 1
            return
        fixed = self.system[1] if self.system else 0
        if len(self.turns) > self.first:
            start = self._history()
            if fixed + self.sums[-1] - self.sums[start] + tokens > self.budget:
                yield self._close()
        self.turns.append((*formatted, role == "assistant"))
        self.sums.append(self.sums[-1] + tokens)
        self.seen += 1
        if len(self.turns) == self.first + 1:  # the first new turn decides how much history fits
            while self._history() < self.first and fixed + self.sums[-1] - self.sums[self._history()] > self.budget:
                self._drop(self._history() + 1)

    def _history(self) -> int:
        """First turn of the history: the longest run before the new turns within its own limit."""
        return bisect_left(self.sums, self.sums[self.first] - self.history, 0, self.first + 1)

    def _drop(self, n: int) -> None:
        self.turns, self.sums, self.first = self.turns[n:], self.sums[n:], self.first - n

    def _close(self) -> dict:
        start = self._history()
        parts, loss, at = [], [], 0
        tokens = self.sums[-1] - self.sums[start]
        if self.system:
            parts.append(self.system[0])
            at, tokens = len(parts[0]), tokens + self.system[1]
        for i, (text, a, b, target) in enumerate(self.turns[start:], start):
            if target and i >= self.first:
                loss.append({"start": at + a, "end": at + b})
            parts.append(text)
            at += len(text)
        new = len(self.turns) - self.first + self.opening
        row = {
            "conv_id": self.conv_id, "window": self.number, "first_turn": self.seen - new, "n_system": int(bool(self.system) and not self.opening),
            "n_history": self.first - start, "n_new": new, "n_tokens": tokens, "over_budget": tokens > self.budget, "text": "".join(parts), "loss": loss,
        }
        self.number, self.opening, self.first = self.number + 1, False, len(self.turns)
        self._drop(self._history())
        return row

    def finish(self) -> Iterator[dict]:
        if self.opening or len(self.turns) > self.first:
            yield self._close()


def format_conversations(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window (``WINDOWS``) of the turns ``conv_id, turn, role, text``; a conversation's windows stay together, in order.

    One shuffle, by conversation. A conversation of any length passes through its task turn by turn.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_ids(tokenizer)
        current: Windows | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids, roles, texts = (part.column(c).to_pylist() for c in ("conv_id", "role", "text"))
                formatted = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
                counts = [len(x) // 4 for x in encoder.encode([f[0] for f in formatted])]
                made = []
                for conv_id, role, text, form, tokens in zip(ids, roles, texts, formatted, counts, strict=True):
                    if current is None or current.conv_id != conv_id:
                        if current is not None:
                            made.extend(current.finish())
                        current = Windows(conv_id, budget, history)
                    made.extend(current.add(role, text, form, tokens))
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=_WINDOW)
        if current is not None:
            yield pa.RecordBatch.from_pylist(list(current.finish()), schema=_WINDOW)

    return ordered.mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of every conversation, from its windows alone: parsed turns without repeats, and all text under the loss mask.

    ``windows`` as :func:`format_conversations` gives them, a conversation's windows in order in one partition.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, said, lost, sums = None, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]

        def row() -> dict:
            return {
                "conv_id": current[0], "n_turns": sums[0], "turns_sha256": said.hexdigest(), "loss_chars": sums[1],
                "loss_sha256": lost.hexdigest(), "formatted_chars": sums[2], "n_windows": sums[3],
            }

        kinds = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")])
        for batch in batches:
            made = []
            for w in batch.select(["conv_id", "n_system", "n_history", "text", "loss"]).to_pylist():
                if current != (w["conv_id"],):
                    if current is not None:
                        made.append(row())
                    current, said, lost, sums = (w["conv_id"],), hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                new = parse(w["text"])[w["n_system"] + w["n_history"] :]
                for role, text in new:
                    said.update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    text = unescape(w["text"][span["start"] : span["end"]])
                    lost.update(text.encode())
                    sums[1] += len(text)
                sums[0] += len(new)
                sums[2] += len(w["text"])
                sums[3] += 1
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=kinds)
        if current is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=kinds)

    return windows.mapInArrow(run, schema)

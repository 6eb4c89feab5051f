"""Chat formatting in budgeted windows.

Turns are put in order; prefix sums of their tokens choose spans of whole turns within a token
budget. Every window starts with the conversation's system turn and repeats the last turns before
its span, up to a token limit, as context. The loss mask covers each assistant turn once: in the
window whose span holds it.

A turn is written ``<s>role\\ntext</s>``. In roles and texts ``\\`` becomes ``\\\\``, ``<`` becomes ``\\l`` and
``[`` becomes ``\\b`` (in roles a line break also becomes ``\\n``), so no control string can stand in a
text and every text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BUDGET, HISTORY = 1024, 256
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its escaped text begins and ends."""
    head = "<s>" + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class _Conversation:
    """Windows of one conversation, from its turns in order. Holds one window, its history and the system turn."""

    def __init__(self, key, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system, self.n, self.window = None, 0, 0
        self.recent, self.recent_tokens = deque(), 0
        self.turns, self.tokens = [], 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, len(text.split()))
        if self.n == 0 and role == "system":
            self.system = turn
        if self.turns and self.fixed() + self.tokens + turn[2] > self.budget:
            yield self.flush()
        # history makes room for a turn that does not fit beside it, its oldest turns first
        while not self.turns and self.recent and self.fixed() + turn[2] > self.budget:
            self.recent_tokens -= self.recent.popleft()[2]
        self.turns.append(turn)
        self.tokens += turn[2]
        self.n += 1

    def fixed(self) -> int:
        """Tokens of the system turn and the history, which the open window repeats."""
        return (self.system[2] if self.system and self.window else 0) + self.recent_tokens

    def flush(self) -> tuple:
        """The window of the open span; its last turns become the history of the next."""
        first = self.n - len(self.turns)
        before = ([self.system] if self.system and first else []) + list(self.recent)
        out, mask, at = [], [], 0
        for i, (role, text, _) in enumerate([*before, *self.turns]):
            written, a, b = format_turn(role, text)
            if i >= len(before) and role == "assistant":
                mask.append([at + a, at + b])
            out.append(written)
            at += len(written)
        row = (self.key, self.window, first, len(self.turns), len(before), sum(t[2] for t in [*before, *self.turns]), "".join(out), mask)
        for i, turn in enumerate(self.turns):
            if not (self.system and first + i == 0):
                self.recent.append(turn)
                self.recent_tokens += turn[2]
        while self.recent and self.recent_tokens > self.history:
            self.recent_tokens -= self.recent.popleft()[2]
        self.turns, self.tokens = [], 0
        self.window += 1
        return row


COLUMNS = ["key", "window", "first_turn", "n_new", "n_repeated", "n_tokens", "formatted", "mask"]


def _same(a: str | None, b: str | None) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _windowed(batches, budget: int, history: int) -> Iterator[pd.DataFrame]:
    now, rows = None, []
    for batch in batches:
        for key, role, text in zip(batch["key"], batch["role"], batch["text"]):
            if now is None or not _same(now.key, key):
                if now:
                    rows.append(now.flush())
                now = _Conversation(key, budget, history)
            rows += now.add(role, text)
        yield pd.DataFrame(rows, columns=COLUMNS)
        rows = []
    if now:
        yield pd.DataFrame([now.flush()], columns=COLUMNS)


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, key: str = "conv_id") -> DataFrame:
    """``(key, window, first_turn, n_new, n_repeated, n_tokens, formatted, mask)``, from ``(key, turn, role, text)``.

    Tokens are words. A window over the budget holds one new turn that does not fit beside the system turn, and no history. Rows of equal ``turn`` go by
    role and text; null turns come first, null roles and texts are empty, null keys are one conversation.
    Conversations are read turn by turn from sorted partitions, so a task never holds one whole.
    """
    kind = dict(turns.dtypes)[key]
    rows = turns.select(
        F.col(key).cast("string").alias("key"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    ).repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    schema = (
        "key string, window long, first_turn long, n_new long, n_repeated long, n_tokens long, formatted string, mask array<array<int>>"
    )
    rows = rows.mapInPandas(partial(_windowed, budget=budget, history=history), schema)
    return rows.select(F.col("key").cast(kind).alias(key), *COLUMNS[1:])


class _Digest:
    """What one conversation's windows, read back in order, hold."""

    def __init__(self, key):
        self.key, self.n, self.loss, self.chars, self.windows = key, 0, 0, 0, 0
        self.turns, self.targets = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, n_repeated: int, mask) -> None:
        for role, text in parse(formatted)[n_repeated:]:
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            self.n += 1
        for a, b in mask:
            target = unescape(formatted[a:b])
            self.targets.update(target.encode("utf-8", "replace"))
            self.loss += len(target)
        self.chars += len(formatted)
        self.windows += 1

    def row(self) -> tuple:
        return self.key, self.n, self.turns.hexdigest(), self.loss, self.targets.hexdigest(), self.chars, self.windows


def _digested(batches) -> Iterator[pd.DataFrame]:
    columns = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    now = None
    for batch in batches:
        rows = []
        for key, formatted, n_repeated, mask in zip(batch["key"], batch["formatted"], batch["n_repeated"], batch["mask"]):
            if now is None or not _same(now.key, key):
                if now:
                    rows.append(now.row())
                now = _Digest(key)
            now.add(formatted, n_repeated, mask)
        yield pd.DataFrame(rows, columns=columns)
    if now:
        yield pd.DataFrame([now.row()], columns=columns)


def digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows)`` read back from ``windows``."""
    kind = dict(formatted.dtypes)[key]
    rows = formatted.select(F.col(key).cast("string").alias("key"), "window", "formatted", "n_repeated", "mask")
    rows = rows.repartition("key").sortWithinPartitions("key", "window")
    schema = (
        "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    )
    rows = rows.mapInPandas(_digested, schema)
    return rows.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)

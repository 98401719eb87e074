r"""Chat formatting in budgeted windows.

A turn is written as `### Role: text </turn>` and a line feed. Inside roles and texts a backslash
becomes `\\`, `###` becomes `\h` and `</turn>` becomes `\t`, so control strings stand only
where the template puts them and every text can be read back.

Windows are aligned to turns: prefix sums of turn tokens choose the longest span of new turns that
fits the budget beside the system turn and the repeated history. Repeated turns carry no loss; each
assistant text is a target in exactly one window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE = "### ", " </turn>\n"
_BACK = {"\\\\": "\\", "\\h": "###", "\\t": "</turn>", "\\c": ":"}
TARGET = "assistant"
#: The share of the budget that a system turn may take and still be repeated in every window.
SYSTEM = 0.25
WINDOW_SCHEMA = "conv_id long, window int, text string, loss array<struct<start:int,end:int>>, repeated int"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\t")


def unescape(s: str) -> str:
    return re.sub(r"\\[\\htc]", lambda m: _BACK[m[0]], s)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text begins and ends in it."""
    named = role[:1].upper() + role[1:] if "a" <= role[:1] <= "z" else "\\" + role
    head = OPEN + escape(named).replace(":", "\\c") + ": "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a formatted window."""
    at = 0
    while at < len(text):
        colon = text.index(": ", at)
        role = unescape(text[at + len(OPEN) : colon])
        start = colon + 2
        end = text.index(CLOSE, start)
        yield (role[1:] if role.startswith("\\") else role[:1].lower() + role[1:]), unescape(text[start:end]), start, end
        at = end + len(CLOSE)


def tokens(text: str) -> int:
    """What a turn weighs: its words and the three marks of the template."""
    return len(text.split()) + 3


@dataclass
class _Conversation:
    """Windows of one conversation, made turn by turn; holds one window's turns at most."""

    budget: int
    history: int
    system: tuple[str, str] | None = None
    old: list[tuple[str, str]] = field(default_factory=list)
    new: list[tuple[str, str]] = field(default_factory=list)
    weight: int = 0
    count: int = 0
    first: bool = True

    def _head(self) -> list[tuple[str, str]]:
        """The system turn, in windows after the first, unless it is so long that repeating it would crowd them."""
        return [self.system] if self.system and self.count and tokens(self.system[1]) <= SYSTEM * self.budget else []

    def _cost(self) -> int:
        return sum(tokens(t) for _, t in [*self._head(), *self.old])

    def push(self, role: str, text: str) -> tuple | None:
        """Takes a turn; gives the window that it closes, if any."""
        done = None
        if self.new and self._cost() + self.weight + tokens(text) > self.budget:
            done = self.flush()
        if self.first and role == "system":
            self.system = (role, text)
        self.first = False
        self.new.append((role, text))
        self.weight += tokens(text)
        return done

    def flush(self) -> tuple:
        head = self._head()
        parts, loss, at = [], [], 0
        for k, (role, text) in enumerate([*head, *self.old, *self.new]):
            turn, a, b = render(role, text)
            if role == TARGET and k >= len(head) + len(self.old):
                loss.append((at + a, at + b))
            parts.append(turn)
            at += len(turn)
        out = (self.count, "".join(parts), loss, len(head) + len(self.old))
        kept, spent = [], 0
        for role, text in reversed(self.new if self.count else [x for k, x in enumerate(self.new) if k or not self.system]):
            if spent + tokens(text) > self.history:
                break
            kept.insert(0, (role, text))
            spent += tokens(text)
        self.old, self.new, self.weight, self.count = kept, [], 0, self.count + 1
        return out


def windows(turns: DataFrame, budget: int = 512, history: int = 96) -> DataFrame:
    """Formatted windows of every conversation, in order within each partition.

    Returns conv_id, window (from 0), text, loss (code-point spans of assistant texts that count)
    and repeated (leading turns that earlier windows already held). A turn that alone exceeds the
    budget gets a window of its own and is never cut. A system turn that opens a conversation is
    repeated in every window if it takes at most SYSTEM of the budget; a longer one stands in the
    first window alone, so that the windows together are at most a fixed multiple of the turns. Rows go by turn, ties by role and text; null
    roles and texts are empty, null turns come first, rows with a null conv_id are one conversation.
    Turns stream through sorted partitions, so a conversation of any length holds one window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for conv, role, text in zip(b["conv_id"].tolist(), b["role"], b["text"]):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *state.flush()))
                    now, state = conv, _Conversation(budget, history)
                if closed := state.push(role, text):
                    out.append((now, *closed))
            yield _frame(out)
        if state is not None:
            yield _frame([(now, *state.flush())])

    clean = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, WINDOW_SCHEMA)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "window", "text", "loss", "repeated"])
    out["conv_id"] = pd.array([int(x) if x else None for x in out["conv_id"]], "Int64")
    out["loss"] = pd.Series([[{"start": a, "end": b} for a, b in x] for x in out["loss"]], dtype=object)
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows alone (they must come straight from windows()).

    A conversation without assistant turns has no loss characters and the digest of no text; the
    one of all null ids has a null conv_id; repeated windows would count again. An empty table gives
    no rows.
    """

    def digest(rows: Iterable[tuple]) -> Iterator[tuple]:
        now, open_ = None, False
        for conv, text, loss, repeated in rows:
            if not open_ or conv != now:
                if open_:
                    yield now, n, turns.hexdigest(), chars, masked.hexdigest(), size
                now, open_, n, chars, size = conv, True, 0, 0, 0
                turns, masked = hashlib.sha256(), hashlib.sha256()
            size += len(text)
            for k, (role, said, _, _) in enumerate(parse(text)):
                if k >= repeated:
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
            for s in loss:
                said = unescape(text[s["start"] : s["end"]])
                chars += len(said)
                masked.update(said.encode("utf-8", "replace"))
        if open_:
            yield now, n, turns.hexdigest(), chars, masked.hexdigest(), size

    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip([None if pd.isna(x) else int(x) for x in b["conv_id"]], b["text"], b["loss"], b["repeated"].tolist()))
        held: list[tuple] = []
        for d in digest(rows):
            held.append(d)
            if len(held) == 4096:
                yield pd.DataFrame(held, columns=columns).astype({"conv_id": "Int64"})
                held = []
        yield pd.DataFrame(held, columns=columns).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

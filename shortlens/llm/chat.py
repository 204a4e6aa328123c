"""Chat formatting: who speaks in each line of a raw transcript, and the transcript in one canonical form.

Lines are what a hidden Markov model emits. Its states are the roles, each either opening a turn or going on with one. A line is
seen as a few features: the speaker marker it begins with and how plainly it is one, whether it is the first or follows an
empty line, whether it asks, how long it is. Where the rows of a table cut a transcript is no feature. Viterbi's path of states
cuts the transcript into turns. Long transcripts are decoded in parts: the best score between any two states over a part
is a small table, tables of neighbouring parts combine to one, and once the states at the borders of a part are known its
lines are decoded on their own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlens.llm.common import store
from shortlens.operators.ranking import with_position
from shortlens.runtime import HOT_ROWS, largest_group

ROLES = ("system", "user", "assistant")
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
S = len(STATES)
# Parts of a transcript combined at a time; 32 tables are 9 kB, so an Arrow batch of rows that hold as many stays small.
PART = 32
# Names by which transcripts mark a speaker.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "you", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "chatbot"),
}
_ROLE_OF = {name: role for role, names in MARKERS.items() for name in names}
# Names that also stand before a line of ordinary text.
HEADINGS = {"instructions", "context", "question", "answer", "you", "me", "model", "agent", "customer"}
_MARKER = re.compile(
    r"^[\s>*#\-]*(<\|(?:im_start\|>)?\s*|\[\s*|\*\*\s*|<\s*/?\s*)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*(\|>|\]|\*\*\s*:|:\s*\*\*|>|:|\)|$)\s*", re.I
)
# A line begins with no marker, with a plain one of a role, or with something that may be one: `A)`, `Answer:`, a bare `you`.
KINDS = ("none", *ROLES, *[f"{role}?" for role in ROLES])
# Lengths from which the next class begins.
LENGTH_CLASSES = (4, 21, 99)
LENGTHS = len(LENGTH_CLASSES) + 1
# How often a state counts as seen as the default model has it, and how much of the default model is mixed into a counted
# one, so that what the counted transcripts never show (turns without an empty line between them) stays possible.
PRIOR = 4.0
BLEND = 0.02
# Messages whose lines are worked on together.
TOGETHER = 1024
BLANK = " \t\n\x0b\x0c\r"
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def read_marker(line: str) -> tuple[str, str]:
    """(kind of the marker that a line begins with, the line without it)."""
    match = _MARKER.match(line)
    if not match:
        return "none", line
    opening, name, closing = match.groups()
    name = name.lower()
    doubtful = name in HEADINGS or closing in (")", "") or (len(name) == 1 and closing != ":")
    plain = (opening or "").startswith("<|") or closing == "|>" or not doubtful
    return _ROLE_OF[name] + ("" if plain else "?"), line[match.end() :]


def marker(line: str) -> tuple[str, str]:
    """(role its marker names or "none", the line without the marker)."""
    kind, rest = read_marker(line)
    return kind.rstrip("?"), rest


def escape(line: str) -> str:
    """A line of content in which nothing reads as one of the canonical marks."""
    return _MARK.sub(r"<\\\1|", line)


def unescape(line: str) -> str:
    return _ESCAPED.sub(r"<\1|", line)


def _line_features(lines: list[str], first: bool, gap: bool) -> list[tuple[int, int, int, int]]:
    rows = []
    for k, line in enumerate(lines):
        kind, rest = read_marker(line)
        place = 0 if first and k == 0 else 1 if gap else 2
        rows.append((KINDS.index(kind), place, int(rest.rstrip().endswith("?")), bisect_right(LENGTH_CLASSES, len(rest))))
        gap = not line.strip(BLANK)
    return rows


def features(lines: list[str], first: bool, gap: bool = False) -> np.ndarray:
    """One row per line: marker kind, place (0 first of all, 1 after a gap, 2 within), asks, length class.

    `gap` says whether the line before these was blank.
    """
    return np.array(_line_features(lines, first, gap), np.int64).reshape(len(lines), 4)


SIZES = (len(KINDS), 3, 2, LENGTHS)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])


class Model:
    """Log probabilities: `begin` (state), `step` (state, state), `emit` (state, feature value)."""

    def __init__(self, begin: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.begin, self.step, self.emit = begin, step, emit

    @classmethod
    def from_counts(cls, step: dict, emit: dict, begin: dict, prior: Model | None = None) -> Model:
        """From counts by state number; what cannot happen stays impossible.

        With a prior, a state is counted as if seen `PRIOR` times more as the prior has it, and `BLEND` of every probability is
        the prior's.
        """

        def shares(counts: list[float], believed: np.ndarray | None) -> np.ndarray:
            found = np.array(counts, float)
            if believed is None:
                return found / found.sum()
            found += PRIOR * np.exp(believed)
            return (1 - BLEND) * found / found.sum() + BLEND * np.exp(believed)

        start, transition, table = np.zeros(S), np.zeros((S, S)), np.zeros((S, sum(SIZES)))
        start[:] = shares([begin.get(b, 0) for b in range(S)], prior and prior.begin)
        for a in range(S):
            # A turn opens after any line; a line goes on only with the turn of its own role.
            transition[a] = shares([step.get((a, b), 0) for b in range(S)], prior and prior.step[a])
            for f, size in enumerate(SIZES):
                at = slice(OFFSETS[f], OFFSETS[f] + size)
                table[a, at] = shares([emit.get((a, f, v), 0) for v in range(size)], prior and prior.emit[a, at])
        with np.errstate(divide="ignore"):
            return cls(np.log(start), np.log(transition), np.log(table))

    def lines(self, rows: np.ndarray) -> np.ndarray:
        """Log probability of each line in each state."""
        return self.emit[:, rows + OFFSETS].sum(-1).T if len(rows) else np.zeros((0, S))


def default_model() -> Model:
    """Without transcripts to count from: plain markers are nearly always right, unmarked turns alternate behind a gap."""
    step, emit, begin = {}, {}, {0: 2, 2: 10, 4: 1}
    for a, (role, opens) in enumerate(STATES):
        for b, (other, starts) in enumerate(STATES):
            if not starts and other == role:
                step[a, b] = 60
            elif starts and other != role:
                step[a, b] = 20 if other != "system" else 1
            elif starts:
                step[a, b] = 0.5
        for v, kind in enumerate(KINDS):
            if kind.endswith("?"):
                emit[a, 0, v] = 12 if opens and kind[:-1] == role else 0.5 if opens else 2
            else:
                emit[a, 0, v] = 100 if not opens and kind == "none" else 50 if opens and kind in ("none", role) else 0.05
        for v, n in enumerate((10, 75, 15) if opens else (0, 8, 92)):
            emit[a, 1, v] = n
        asks = 40 if role == "user" else 8
        emit[a, 2, 0], emit[a, 2, 1] = 100 - asks, asks
        for v in range(LENGTHS):
            emit[a, 3, v] = 25
    return Model.from_counts(step, emit, begin)


def _times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Best scores over two parts in a row."""
    return (left[:, :, None] + right[None, :, :]).max(1)


def _path(tables: list[np.ndarray], start: np.ndarray, end: int | None) -> list[int]:
    """The state behind each table on the best way from `start` (scores) to `end` (any, if None)."""
    score, back = start, []
    for table in tables:
        ways = score[:, None] + table
        back.append(ways.argmax(0))
        score = ways.max(0)
    state = int(score.argmax()) if end is None else end
    out = []
    for choice in reversed(back):
        out.append(state)
        state = int(choice[state])
    return out[::-1]


def _only(state: int) -> np.ndarray:
    return np.where(np.arange(S) == state, 0.0, -np.inf)


def _lines_of(text) -> list[str]:
    return (text or "").split("\n")


def _all_lines(model: Model, texts, firsts, gaps) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """(lines of each message, how many, log probabilities of all lines one message after another)."""
    messages = [_lines_of(t) for t in texts]
    rows: list = []
    for lines, first, gap in zip(messages, firsts, gaps):
        rows += _line_features(lines, bool(first), bool(gap))
    return messages, np.array([len(m) for m in messages], np.int64), model.lines(np.array(rows, np.int64).reshape(-1, 4))


def _steps(model: Model, counts: np.ndarray, emissions: np.ndarray, firsts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Line after line, for all messages that have that many: (their lines, score of each step between two states).

    Messages come in the order of `_longest_first`, so those that go on are always the first ones.
    """
    order = _longest_first(counts)
    starts, sizes = (counts.cumsum() - counts)[order], counts[order]
    first = np.asarray(firsts, bool)[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        at = starts[: np.searchsorted(-sizes, -k)] + k
        steps = model.step[None] + emissions[at][:, None, :]
        if k == 0:
            # Any state before the first line leads to the model's beginning.
            steps[first] = (model.begin + emissions[at][first])[:, None, :]
        yield at, steps


def _longest_first(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts, kind="stable")


def _message_tables(model: Model, texts, firsts, gaps) -> np.ndarray:
    """Best score from the state before each message to the state of its last line."""
    _, counts, emissions = _all_lines(model, texts, firsts, gaps)
    tables = np.tile(np.where(np.eye(S, dtype=bool), 0.0, -np.inf), (len(counts), 1, 1))
    for at, steps in _steps(model, counts, emissions, firsts):
        n = len(at)
        tables[:n] = (tables[:n, :, :, None] + steps[:, None]).max(2)
    out = np.empty_like(tables)
    out[_longest_first(counts)] = tables
    return out


def _message_states(model: Model, counts: np.ndarray, emissions: np.ndarray, firsts, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The state of every line on the best way from the state before each message to the one at its end."""
    order = _longest_first(counts)
    score = np.where(np.arange(S)[None, :] == before[order][:, None], 0.0, -np.inf)
    back = []
    for at, steps in _steps(model, counts, emissions, firsts):
        ways = score[: len(at), :, None] + steps
        back.append((at, ways.argmax(1).astype(np.int8)))
        score[: len(at)] = ways.max(1)
    states, current = np.empty(len(emissions), np.int64), after[order].copy()
    for at, choice in reversed(back):
        n = len(at)
        states[at] = current[:n]
        current[:n] = choice[np.arange(n), current[:n]]
    return states


GROUP_TYPE = "conv bigint, pos bigint, n int, tables array<double>, table array<double>"
BORDER_TYPE = "conv bigint, pos bigint, before int, after int"


def _combine(level: DataFrame) -> DataFrame:
    """Up to `PART` neighbours to one row: their tables one after another, and the one table over all of them."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tables = [np.asarray(flat).reshape(-1, S, S) for flat in batch["tables"]]
            yield batch.assign(table=[reduce(_times, group).ravel() for group in tables])

    parts = level.groupBy("conv", F.floor(F.col("pos") / PART).alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "table"))).alias("_parts"))
    flat = parts.select("conv", "pos", F.size("_parts").alias("n"), F.flatten(F.col("_parts")["table"]).alias("tables"))
    return flat.mapInPandas(join, GROUP_TYPE)


def _split(level: DataFrame) -> DataFrame:
    """(conv, pos, before, after) of each table that a row combines, from the states at the row's borders."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            before, after = [], []
            for flat, first, last in zip(batch["tables"], batch["before"], batch["after"]):
                states = _path(list(np.asarray(flat).reshape(-1, S, S)), _only(first), last)
                before += [first, *states[:-1]]
                after += states
            sizes = batch["n"].to_numpy()
            within = np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)
            yield pd.DataFrame(
                {"conv": batch["conv"].repeat(sizes).to_numpy(), "pos": (batch["pos"] * PART).repeat(sizes).to_numpy() + within, "before": before, "after": after}
            )

    return level.select("conv", "pos", "n", "tables", "before", "after").mapInPandas(walk, BORDER_TYPE)


def _ends(level: DataFrame) -> DataFrame:
    """Rows that each combine a whole conversation, with the states that its best path begins before and ends in."""
    last = F.slice("table", 1, S)
    # Any state leads to the beginning, so the first row of the table has the scores; ties go to the first state.
    return level.withColumns({"before": F.lit(0), "after": (F.array_position(last, F.array_max(last)) - 1).cast("int")})


def decode(messages: DataFrame, model: Model) -> DataFrame:
    """(conv, pos, before, after): the state before and at the end of each message, on the best path of its whole conversation.

    `messages` has conv (bigint), pos (0, 1, ... in each conversation), gap (the line before is blank), text. A conversation leaves as soon as one row combines
    it; only longer ones go on to the next level.
    """

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                part = batch.iloc[k : k + TOGETHER]
                found = _message_tables(model, part["text"], (part["pos"] == 0).to_numpy(), part["gap"])
                yield pd.DataFrame({"conv": part["conv"].to_numpy(), "pos": part["pos"].to_numpy(), "table": list(found.reshape(len(part), S * S))})

    longest = messages.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0] + 1
    longer = messages.select("conv", "pos", "gap", "text").mapInPandas(tables, "conv bigint, pos bigint, table array<double>")
    # A first row that is not full has nothing after it.
    whole = (F.col("pos") == 0) & (F.col("n") < PART)
    levels = []
    while longest > 1 or not levels:
        levels.append(store(_combine(longer), "chat-tables"))
        longer = levels[-1].filter(~whole)
        longest = -(-longest // PART)
    borders = store(_split(_ends(levels.pop())), "chat-borders")
    for level in reversed(levels):
        met = level.filter(~whole).join(borders, ["conv", "pos"])
        ended = _ends(level.filter(whole))
        borders = store(_split(ended).unionByName(_split(met)), "chat-borders")
    return borders


ROW_TYPE = "conv bigint, pos bigint, roles array<string>, opens array<boolean>, rendered string, n_lines int"


def _rendered(lines: list[str], states: list[int], first: bool, last: bool) -> tuple[list[str], list[bool], str]:
    """(roles, whether each opens here, canonical form) of a message. Every line of content stands on a line of its own."""
    roles, opens, parts = [], [], []
    for k, (state, line) in enumerate(zip(states, lines)):
        role, starts = STATES[state]
        if starts or k == 0:
            roles.append(role)
            opens.append(starts)
        if not starts:
            parts.append("\n" + escape(line))
            continue
        kind, rest = read_marker(line)
        # Only the marker of the turn's own role goes; a line that holds nothing else leaves no line.
        own = kind.rstrip("?") == role
        shown = rest if own else line
        parts.append(("" if first and k == 0 else "<|end|>\n") + f"<|{role}|>" + ("" if own and not shown else "\n" + escape(shown)))
    return roles, opens, "".join(parts) + ("<|end|>" if last else "")


def _render(model: Model):
    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), TOGETHER):
                batch = whole.iloc[k : k + TOGETHER]
                firsts = (batch["pos"] == 0).to_numpy()
                messages, counts, emissions = _all_lines(model, batch["text"], firsts, batch["gap"])
                states = _message_states(model, counts, emissions, firsts, batch["before"].to_numpy(), batch["after"].to_numpy()).tolist()
                out, at = [], 0
                for conv, pos, first, last, lines in zip(batch["conv"], batch["pos"], firsts, batch["last"], messages):
                    out.append((conv, pos, *_rendered(lines, states[at : at + len(lines)], first, last), len(lines)))
                    at += len(lines)
                yield pd.DataFrame(out, columns=["conv", "pos", "roles", "opens", "rendered", "n_lines"])

    return render


def fit_model(messages: DataFrame) -> Model:
    """Count states and features over all labelled messages (conv, pos, gap, role, text); one message is one turn.

    The default model is the prior; without labelled messages it is the model.
    """
    number = {role: 2 * k for k, role in enumerate(ROLES)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict = {}

            def add(kind, a, b, c):
                found[kind, a, b, c] = found.get((kind, a, b, c), 0) + 1

            for pos, gap, role, previous, text in zip(batch["pos"], batch["gap"], batch["role"], batch["previous"], batch["text"]):
                opener = number[role]
                for k, row in enumerate(_line_features(_lines_of(text), pos == 0, bool(gap))):
                    state = opener + (k > 0)
                    for f, value in enumerate(row):
                        add("emit", state, f, value)
                    if k:
                        add("step", opener + (k > 1), state, 0)
                if pos == 0:
                    add("begin", opener, 0, 0)
                elif previous in number:
                    # The turn before ends in a line that went on, or in its opening line if it has no other.
                    add("step", number[previous] + 1, opener, 0)
                    add("step", number[previous], opener, 0)
            yield pd.DataFrame([(*key, n) for key, n in found.items()], columns=["kind", "a", "b", "c", "n"])

    # The message before: neighbours are found by position, not by a window over a whole conversation.
    own = messages.select("conv", "pos", "gap", "role", "text").filter(F.col("role").isin(*ROLES))
    before = own.select("conv", (F.col("pos") + 1).alias("pos"), F.col("role").alias("previous"))
    counted = own.join(before, ["conv", "pos"], "left").select("pos", "gap", "role", "previous", "text").mapInPandas(count, "kind string, a int, b int, c int, n bigint")
    rows = counted.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")).collect()  # states x features, a few hundred rows
    step = {(r["a"], r["b"]): r["n"] for r in rows if r["kind"] == "step"}
    emit = {(r["a"], r["b"], r["c"]): r["n"] for r in rows if r["kind"] == "emit"}
    begin = {r["a"]: r["n"] for r in rows if r["kind"] == "begin"}
    return Model.from_counts(step, emit, begin, default_model()) if rows else default_model()


def positioned(table: DataFrame, conv_id: str, order: str, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(conv, conv_id, pos, gap, last, seq, ...): conversations as numbers, messages numbered from 0 in order; ties by text.

    `columns` name `text`; `gap` says whether the message before ends in a blank line, `last` whether none follows. Rows without
    a conversation are a conversation of their own each.
    """
    named = table.select(F.col(conv_id).alias("conv_id"), F.col(order).alias("seq"), *columns)
    named = store(named.withColumn("_row", F.monotonically_increasing_id()), "chat-messages")
    alone = F.xxhash64(F.lit("alone"), F.col("_row"))
    named = named.withColumn("conv", F.when(F.col("conv_id").isNull(), alone).otherwise(F.xxhash64(F.col("conv_id").cast("string"))))
    last_line = F.substring_index(F.coalesce("text", F.lit("")), "\n", -1)
    named = named.withColumn("_blank", last_line.rlike(r"\A[\x20\x09-\x0D]*\z"))
    if largest_group(named, ["conv"]) <= hot_rows:
        within = Window.partitionBy("conv").orderBy("seq", "_row")
        placed = named.withColumns(
            {
                "pos": F.row_number().over(within).cast("bigint") - 1,
                "gap": F.coalesce(F.lag("_blank").over(within), F.lit(False)),
                "last": F.lead("_row").over(within).isNull(),
            }
        )
    else:
        # Neighbours are found by position, so a hot conversation is many tasks' work.
        placed = store(with_position(named, "conv", ["seq", "_row"], "pos", hot_rows).withColumn("pos", F.col("pos") - 1), "chat-numbers")
        before = placed.select("conv", (F.col("pos") + 1).alias("pos"), F.col("_blank").alias("gap"))
        ends = placed.groupBy("conv").agg(F.max("pos").alias("_end"))
        placed = placed.join(before, ["conv", "pos"], "left").join(ends, "conv")
        placed = placed.withColumns({"gap": F.coalesce("gap", F.lit(False)), "last": F.col("pos") == F.col("_end")}).drop("_end")
    return store(placed.drop("_blank"), "chat-positions")


def format_chats(messages: DataFrame, model: Model | None = None, conv_id: str = "conv_id", order: str = "seq", text: str = "text") -> DataFrame:
    """(conv_id, seq, pos, roles, opens, n_lines, rendered): one row per row of `messages`, a raw piece of a transcript.

    The pieces of a conversation, in order, each a number of whole lines, are one transcript, however it is cut; `rendered` in the
    same order, put one behind another, is its canonical form: each turn as `<|role|>`, its lines and `<|end|>`. A marker that
    names the turn's role is taken off its first line; other lines are kept whole, and `<|` in them is written `<\\|`
    (`unescape` reads it back). `roles` are those of the turns that a piece holds or goes on
    with, `opens` whether each begins in it. Null texts count as empty, an empty text as one empty line. Rows without a conversation id
    are transcripts of their own; rows with the same order, repeated rows included, follow one another as they are stored.
    An empty table gives an empty result; other columns are not read.
    """
    model = model or default_model()
    placed = positioned(messages.select(conv_id, order, F.col(text).alias("text")), conv_id, order, ["text"])
    borders = decode(placed, model)
    joined = placed.join(borders, ["conv", "pos"]).select("conv", "pos", "gap", "last", "text", "before", "after")
    shown = joined.mapInPandas(_render(model), ROW_TYPE)
    return placed.select("conv", "pos", "conv_id", "seq").join(shown, ["conv", "pos"]).select("conv_id", "seq", "pos", "roles", "opens", "n_lines", "rendered")



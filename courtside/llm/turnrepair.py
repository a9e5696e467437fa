"""Conversation structure repair by secondary-sorted streaming.

Turns are dealt out by conversation and sorted by turn inside each task, and one pass carries the state of a
dynamic programme across Arrow batches. The programme runs from the last turn to the first: for each of the
four states of the wanted order of roles, ``(s?(ua)+)?`` by initials, it knows the least cost of the turns seen
so far. Costs are kept less their minimum, so there are few different states of the programme, and
a step taken before is looked up. Each step leaves one byte, the cheapest edit in each state (two bits, the least
letter where several are as cheap); walking these bytes from the first turn on gives the edits, since a state
and a letter name the next state.

A conversation that fits the buffer (``BUFFER_ROWS`` turns, ``BUFFER_CHARS`` characters) is finished
in the same pass. Of a larger one the pass drops the texts and keeps blocks of those bytes, which Spark stores as rows in the shared
folder; a second pass meets them with the conversation's turns in forward order, and writes
its edits and its hash as the turns go by. The hash runs over the whole repaired text, so a conversation is one
stream by definition; neither pass holds more than a buffer of its turns.

Repeats are found ahead of the stream: rows equal in role and text are numbered by a window over
the same partitioning, so that no task remembers what it has seen.

Defined cases: a null role or text is one space; a null conversation id is a conversation of its own, and
null turns come first. Turns of one number are ordered by role and text. Roles with an empty text
have no initial and cannot be kept. A conversation without turns needs no edit. Only the named
columns are read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from courtside.llm.shared import shuffle_partitions, source
from courtside.workspace import staged

# What one task holds of a conversation before it stores moves in place of texts.
BUFFER_ROWS = 50_000
BUFFER_CHARS = 16 << 20
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LETTERS = "DIKR"  # by their codes; the order is also that of ties
D, I, K, R = range(4)
# States: nothing yet, system, user, assistant. The state each initial leads to.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
# The role that fits next, and the state it leads to.
FITTING = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
MOST = 2**63 - 1
FAULTS = ("", "blank", "duplicate", "truncated")

RESULT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


def damaged(rows: DataFrame) -> DataFrame:
    """The turns of a table after its agreed damage: conv_id, turn, role, text; of a dropped turn only conv_id and ``gone``."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        space("role").alias("role"),
        space("text").alias("text"),
        (F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20).alias("harm"),
    )
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    gone = F.col("harm") == 0
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(~gone, F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(~gone, text).alias("text"),
        gone.alias("gone"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def fault(text: Column, earlier: Column) -> Column:
    """The first fault of a turn, as a place in FAULTS."""
    ends = F.rlike(text, F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    return (
        F.when(~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), 1).when(earlier, 2).when(~ends, 3).otherwise(0).cast("int")
    )


def in_order(turns: DataFrame) -> DataFrame:
    """Turns dealt out by conversation, each with its fault. One shuffle; the window keeps to its partitioning."""
    tasks = shuffle_partitions(turns.sparkSession)
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    dealt = turns.repartition(tasks, "conv_id").withColumn("_earlier", F.row_number().over(same) > 1)
    return dealt.select(
        "conv_id",
        F.col("turn").isNull().alias("unnumbered"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        "gone",
        F.col("_earlier").alias("again"),
        F.when(F.col("gone"), 0).otherwise(fault(F.col("text"), F.col("_earlier"))).alias("fault"),
    )


class Programme:
    """Steps of the dynamic programme, each worked out once."""

    # Costs to go at the end: nothing, or the inserts that close the order.
    END = (0, 2 * INSERT, INSERT, 0)

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def step(self, costs: tuple, initial: str, fault: int) -> tuple[tuple, int, int]:
        """(costs before the turn less their least, that least, the move byte)."""
        key = costs, initial if initial in AFTER else "", fault
        if key not in self.known:
            self.known[key] = self._step(*key)
        return self.known[key]

    @staticmethod
    def _step(costs: tuple, initial: str, fault: int) -> tuple[tuple, int, int]:
        stays = fault in (1, 2)
        extra = TRUNCATED if fault == 3 else 0
        options = []
        for state in range(4):
            ways = {D: DELETE + costs[state]}
            if not stays:
                after = AFTER.get(initial, {}).get(state)
                if after is not None:
                    ways[K] = extra + costs[after]
                ways[R] = REROLE + extra + costs[FITTING[state][1]]
            options.append(ways)
        best = [min(ways.values()) for ways in options]
        for _ in range(4):
            best = [min(best[q], INSERT + best[FITTING[q][1]]) for q in range(4)]
        moves = 0
        for state, ways in enumerate(options):
            ways[I] = INSERT + best[FITTING[state][1]]
            moves |= min(move for move, cost in ways.items() if cost == best[state]) << 2 * state
        least = min(best)
        return tuple(cost - least for cost in best), least, moves


class Writer:
    """Walks moves from the first turn on and writes the edits and the repaired conversation."""

    def __init__(self):
        self.state, self.audit, self.hash, self.begun = 0, [], hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode())
        self.begun = True

    def _insert(self) -> None:
        role, self.state = FITTING[self.state]
        self._write(role, "")
        self.audit.append("I")

    def turn(self, moves: int, role: str, text: str) -> None:
        while (move := moves >> 2 * self.state & 3) == I:
            self._insert()
        self.audit.append(LETTERS[move])
        if move == K:
            self.state = AFTER[role[0]][self.state]
            self._write(role, text)
        elif move == R:
            role, self.state = FITTING[self.state]
            self._write(role, text)

    def end(self) -> tuple[str, str]:
        while self.state in (1, 2):
            self._insert()
        return "".join(self.audit), self.hash.hexdigest()


class Backward:
    """One conversation, given from its last turn to its first."""

    def __init__(self, conv_id, programme: Programme, buffer_rows: int, buffer_chars: int):
        self.conv_id, self.programme = conv_id, programme
        self.buffer_rows, self.buffer_chars = buffer_rows, buffer_chars
        self.costs, self.cost = Programme.END, 0
        self.counts = [0, 0, 0, 0]  # illegal, then by fault
        self.highest = self.lowest = None
        self.numbers = 0
        self.next_initial = None
        self.turns, self.chars, self.moves = [], 0, bytearray()
        self.stored, self.blocks = False, 0

    def turn(self, unnumbered: bool, turn: int, role: str, text: str, fault: int) -> dict | None:
        """Takes a turn; gives a block to store if the buffer is full."""
        self.costs, more, move = self.programme.step(self.costs, role[:1], fault)
        self.cost += more
        self.moves.append(move)
        if fault:
            self.counts[fault] += 1
        if self.next_initial is not None and role[:1] + self.next_initial not in ("su", "ua", "au"):
            self.counts[0] += 1
        self.next_initial = role[:1]
        if not unnumbered and turn != self.lowest:
            self.numbers += 1
            self.lowest = turn
            self.highest = turn if self.highest is None else self.highest
        if not self.stored:
            self.turns.append((role, text))
            self.chars += len(text)
        if len(self.moves) >= self.buffer_rows or self.chars > self.buffer_chars:
            return self.block(unnumbered, turn, role, text)
        return None

    def block(self, unnumbered: bool, turn: int, role: str, text: str) -> dict:
        """The moves held, in forward order, under the first of their turns."""
        moves = bytes(reversed(self.moves))
        self.blocks += 1
        self.stored, self.turns, self.chars, self.moves = True, [], 0, bytearray()
        return {
            "conv_id": self.conv_id, "unnumbered": unnumbered, "turn": turn, "role": role, "text": text,
            "block": self.blocks, "moves": moves,
        }

    def totals(self) -> dict:
        gaps = 0 if self.lowest is None else min(self.highest - self.lowest + 1 - self.numbers, MOST)
        illegal, blank, duplicate, truncated = self.counts
        return {
            "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
            "cost": self.cost + self.costs[0],
        }

    def finish(self) -> dict:
        if self.stored:
            # Under the least possible turn, so that it comes first.
            first = self.block(True, -MOST - 1, "", "")
            return first | self.totals()
        writer = Writer()
        for move, (role, text) in zip(reversed(self.moves), reversed(self.turns)):
            writer.turn(move, role, text)
        audit, digest = writer.end()
        return {"conv_id": self.conv_id, **self.totals(), "audit": audit, "repaired_sha256": digest}


PLACE = ["unnumbered", "turn", "role", "text"]
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_STORED = ["conv_id", *PLACE, "block", "moves", *_COUNTS, "audit", "repaired_sha256"]


def _conversations(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """The rows of all batches as tuples, with whether a new conversation begins."""
    last, first = None, True
    for frame in frames:
        for row in zip(*(frame[name].tolist() for name in columns)):
            yield first or row[0] != last, row
            last, first = row[0], False


def repaired(turns: DataFrame, buffer_rows: int = BUFFER_ROWS, buffer_chars: int = BUFFER_CHARS) -> DataFrame:
    """conv_id and the columns of RESULT, one row for each conversation.

    ``turns``: conv_id, turn, role, text, and ``gone`` for rows that only name a conversation.
    """
    kind = turns.schema["conv_id"].dataType
    dealt = in_order(turns).withColumn("conv_id", F.col("conv_id").cast("string"))
    schema = f"conv_id string, unnumbered boolean, turn bigint, role string, text string, block int, moves binary, {RESULT}"

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        programme, now, out, held = Programme(), None, [], 0
        columns = ["conv_id", *PLACE, "fault", "gone"]
        for new, (conv_id, unnumbered, turn, role, text, fault, gone) in _conversations(frames, columns):
            if new:
                if now is not None:
                    out.append(now.finish())
                now = Backward(conv_id, programme, buffer_rows, buffer_chars)
            if not gone:
                block = now.turn(unnumbered, turn, role, text, fault)
                if block is not None:
                    out.append(block)
                    held += 1
            if len(out) >= 5_000 or held >= 20:
                yield pd.DataFrame(out, columns=_STORED, dtype=object)
                out, held = [], 0
        if now is not None:
            out.append(now.finish())
        if out:
            yield pd.DataFrame(out, columns=_STORED, dtype=object)

    last_first = [F.col("unnumbered").asc(), *(F.col(name).desc() for name in ("turn", "role", "text", "again"))]
    backward = dealt.sortWithinPartitions("conv_id", "gone", *last_first)
    found = staged(backward.mapInPandas(back, schema), "repairs")
    result = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    done = found.where("moves IS NULL").select(result)
    blocks = found.where("moves IS NOT NULL")
    if not blocks.isEmpty():
        done = done.unionByName(_forward(dealt.where("NOT gone"), blocks).select(result))
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))


def _forward(dealt: DataFrame, blocks: DataFrame) -> DataFrame:
    """The conversations that stored moves, finished from them and their turns in forward order."""
    large = blocks.select(F.col("conv_id").alias("_large")).distinct()
    turns = dealt.join(large, F.col("conv_id").eqNullSafe(F.col("_large")), "left_semi")
    stored = blocks.select("conv_id", *PLACE, "block", "moves", *_COUNTS)
    met = turns.select("conv_id", *PLACE).unionByName(stored, allowMissingColumns=True)
    # Counts are whole numbers for the pass below, also where they are missing.
    met = met.fillna(-1, _COUNTS)
    tasks = shuffle_partitions(dealt.sparkSession)
    ordered = met.repartition(tasks, "conv_id").sortWithinPartitions(
        "conv_id", F.col("unnumbered").desc(), "turn", "role", "text", F.col("block").desc_nulls_last()
    )

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for new, (conv_id, role, text, moves, *counts) in _conversations(frames, ["conv_id", "role", "text", "moves", *_COUNTS]):
            if new:
                if now is not None:
                    yield _finished(*now)
                now = conv_id, Writer(), deque(), []
            _, writer, waiting, totals = now
            if moves is not None:
                # A block may come a little before its first turn, if turns are equal.
                if moves:
                    waiting.append(iter(moves))
                if counts[-1] >= 0:
                    totals += counts
                continue
            while (move := next(waiting[0], None)) is None:
                waiting.popleft()
            writer.turn(move, role, text)
        if now is not None:
            yield _finished(*now)

    return ordered.mapInPandas(forward, f"conv_id string, {RESULT}")


def _finished(conv_id, writer: Writer, waiting: deque, totals: list[int]) -> pd.DataFrame:
    audit, digest = writer.end()
    columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    return pd.DataFrame([[conv_id, *totals, audit, digest]], columns=columns, dtype=object)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(source(spark, sf_dir, "conversations")))

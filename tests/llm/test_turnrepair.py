import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest

from courtside.llm import turnrepair as tr

ORDER = re.compile(r"(s?(ua)+)?")
PART = re.compile(r"s?(ua)*u?")
COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def brute_damage(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        held = out[conv_id]
        role, text = (" " if value is None else value for value in (role, text))
        harm = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub(r"[.!?]", "", text)
        elif harm == 4:
            role = "user"
        if harm:
            held += [(turn, role, text)] * (2 if harm == 3 else 1)
    for held in out.values():
        held.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))
    return out


def brute_faults(held):
    faults, seen = [], set()
    for _, role, text in held:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        if not letters:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif letters[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    return faults


def brute_repair(held, faults):
    """Searches edits by cost and then letters; the first complete one is the answer."""
    todo, met = [(0, "", 0, ())], set()
    while True:
        cost, audit, at, made = heapq.heappop(todo)
        initials = "".join(role[0] for role, _ in made)
        # What may follow depends on the last initial alone, so later and dearer ways to it can go.
        if (at, initials[-1:]) in met:
            continue
        met.add((at, initials[-1:]))
        if at == len(held) and ORDER.fullmatch(initials):
            return cost, audit, "\n".join(f"{role}:{text}" for role, text in made)
        ways = [("I", 5, at, (role, "")) for role in ("user", "assistant")]
        if at < len(held):
            _, role, text = held[at]
            ways.append(("D", 2, at + 1, None))
            if faults[at] in ("", "truncated"):
                extra = 5 if faults[at] else 0
                ways += [("R", 1 + extra, at + 1, (other, text)) for other in ("user", "assistant")]
                if role:
                    ways.append(("K", extra, at + 1, (role, text)))
        for letter, more, next_at, row in ways:
            after = made if row is None else (*made, row)
            if PART.fullmatch("".join(role[0] for role, _ in after)):
                heapq.heappush(todo, (cost + more, audit + letter, next_at, after))


def brute(rows):
    out = {}
    for conv_id, held in brute_damage(rows).items():
        faults = brute_faults(held)
        cost, audit, text = brute_repair(held, faults)
        turns = [turn for turn, _, _ in held if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        out[conv_id] = (
            gaps, *(faults.count(name) for name in ("blank", "duplicate", "truncated")),
            sum(pair not in ("su", "ua", "au") for pair in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def result(frame):
    rows = frame.select("conv_id", *tr._COUNTS[:5], "cost", "audit", "repaired_sha256").collect()
    assert len({row[0] for row in rows}) == len(rows)
    return {row[0]: tuple(row[1:]) for row in rows}


@pytest.fixture(scope="module")
def given(spark):
    folder = "/root/testdata/sf0.01/conversations.parquet"
    return spark.read.parquet(folder).select("conv_id", "turn", "role", "text")


def test_query_equals_brute_force(spark, given):
    assert result(tr.query(spark, "/root/testdata/sf0.01")) == brute(map(tuple, given.collect()))


AWKWARD = [
    (1, None, "user", "first."), (1, None, None, None), (1, 5, "assistant", "Yes!"), (1, 5, "assistant", "Yes!"), (1, 9, "", "x."),
    (2, 1, "user", None), (3, 2, "system", "   \t\n"), (4, 1, "tool", "a."), (4, 2, "tool", "b."), (4, 3, "tool", "c"),
    (4, 4, "User", "d?"), (None, 3, "user", "who?"), (None, 4, "assistant", "me."), (None, None, "assistant", "me."),
    (5, 7, "assistant", "A."), (5, 8, "assistant", "B."), (5, 9, "system", "C."), (5, 10, "user", "D. \n"),
    (6, -3, "user", "ends " * 9 + "."), (6, 40, "assistant", "漢字。"), (6, 41, "assistant", "fin.\x00"), (7, 1, "user", "."),
]


@pytest.mark.parametrize("rows, chars", [(50_000, 1 << 24), (1, 1 << 24), (2, 1 << 24), (50_000, 3)])
def test_awkward_turns_in_one_pass_and_with_stored_moves(spark, rows, chars):
    frame = spark.createDataFrame(AWKWARD, COLUMNS)
    assert result(tr.repaired(tr.damaged(frame), rows, chars)) == brute(AWKWARD)


def test_stored_moves_give_the_same_as_one_pass(given):
    turns = tr.damaged(given)
    assert result(tr.repaired(turns, 2)) == result(tr.repaired(turns))


def test_a_giant_conversation_goes_through_blocks(spark):
    rows = spark.range(30_000).selectExpr(
        "bigint(1) AS conv_id", "id AS turn", "CASE WHEN id % 7 = 0 THEN 'tool' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role",
        "concat('t', id % 20000, CASE WHEN id % 11 = 0 THEN '' ELSE '.' END) AS text",
    ).withColumn("gone", tr.F.lit(False))
    assert result(tr.repaired(rows, 1000)) == result(tr.repaired(rows))


def test_dropped_and_empty_conversations(spark):
    gone = [(conv, 1, "user", "x.") for conv in range(200) if zlib.crc32(f"{conv}:1".encode()) % 20 == 0]
    none = hashlib.sha256(b"").hexdigest()
    assert gone
    found = result(tr.repaired(tr.damaged(spark.createDataFrame(gone, COLUMNS))))
    assert found == {row[0]: (0, 0, 0, 0, 0, 0, "", none) for row in gone}
    assert result(tr.repaired(tr.damaged(spark.createDataFrame([], COLUMNS)))) == {}


def test_extra_columns_with_inner_names_and_one_shuffle(spark):
    frame = spark.createDataFrame(AWKWARD, COLUMNS)
    more = frame.selectExpr("*", "1 AS gone", "2 AS moves", "3 AS block", "4 AS harm", "5 AS fault", "6 AS _earlier", "7 AS again")
    assert result(tr.repaired(tr.damaged(more))) == brute(AWKWARD)
    plan = tr.in_order(tr.damaged(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1

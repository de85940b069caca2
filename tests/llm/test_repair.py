"""Conversation repair against plain dynamic programming, and the search against all edits."""

import hashlib
import itertools
import random
import re

import pytest

from brute_repair import answers, repaired
from dawnframe.llm import repair, repair_search

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost int"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def reported(frame):
    got = frame.collect()
    assert frame.columns == list(COLUMNS) and len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_random_conversations(spark):
    rng = random.Random(5)
    texts = ["Yes.", "no", "", " \t", "What?\n", "Fine!", "Yes.", "a. ", "é…", None, "x" * 50 + "1.", "x" * 50 + "2"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ustring", "System"]
    rows = []
    for conv in [None, *range(150)]:
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, -3, 0, 1, 2, 3, 4, 5, 6, 40]), rng.choice(roles), rng.choice(texts)))
    rows += rows[:60]
    assert reported(repair.report(repair.damaged(conversations(spark, rows)))) == answers(rows)


def test_one_conversation_holds_most_turns(spark):
    """Segments over several ranges, joined in one plan; a repeated row a third of the table."""
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"{rng.choice(['Go', 'Stop', 'Again'])} {rng.randint(0, 300)}{rng.choice(['.', '.', ''])}") for i in range(900)]
    rows += [(7, 5000, "user", "Same.")] * 500 + [(8, i, "user", "Hm.") for i in range(3)]
    hurt = repair.damaged(conversations(spark, rows))
    assert reported(repair.report(hurt)) == answers(rows)
    lines = sorted((r.conv_id, r.place, r.role, r.text) for r in repair.repaired(hurt).collect())
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for c, _, r, t in lines if c == 7).encode()).hexdigest()
    assert digest == answers(rows)[7][-1] and [p for c, p, _, _ in lines if c == 7] == list(range(sum(x[0] == 7 for x in lines)))


def test_edges(spark):
    assert repair.report(repair.damaged(conversations(spark, []))).count() == 0
    frame = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (2, -(2**63), "user", "Hi.", 1), (2, 2**63 - 1, "assistant", "Yes.", 1)], "conv_id long, turn long, role string, text string, copies int")
    got = reported(repair.report(frame))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][0] == 2**63 - 1 and got[2][6] == "KK"


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(12):
        turns = [(rng.choice("suao" if rng.random() < 0.4 else "ua"), rng.choice("...tx")) for _ in range(rng.randint(0, 3))]
        best = None
        for edits in itertools.product(*[["D"] if f == "x" else ["D", "K", "Ru", "Ra"] for _, f in turns]):
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(turns) + 1):
                roles, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * len(gaps[0])
                for (kind, fault), edit, gap in zip(turns, edits, gaps[1:], strict=True):
                    roles += ("" if edit == "D" else kind if edit == "K" else edit[1]) + gap
                    audit += edit[0] + "I" * len(gap)
                    cost += 3 * len(gap) + {"D": 4, "K": 0, "R": 3}[edit[0]] + (3 if fault == "t" and edit != "D" else 0)
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert repair_search.search(turns) == best
        assert repair_search.bounds(turns)[0] <= best[0]


def test_bounds_hold_for_every_suffix():
    rng = random.Random(9)
    for _ in range(60):
        turns = [(rng.choice("ssuuuaaao"), rng.choice("...tx")) for _ in range(12)]
        least = repair_search.bounds(turns)
        for i in range(13):
            for entry in range(4):
                assert least[i] <= repair_search.search(turns[i:], entry)[0]


def test_brute_force_itself():
    assert repaired([(1, 0, "assistant", "Hi.")])[5:7] == (3, "IK")

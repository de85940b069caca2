"""The cheapest repair of a run of turns: depth-first branch-and-bound.

A turn is ``(kind, fault)``: kind ``s``, ``u`` or ``a`` for a role that begins so, ``o`` for any other; fault ``x`` where it must be deleted,
``t`` where it is truncated, ``.`` where there is none.  States of the repaired conversation so far: 0 nothing, 1 a
system turn, 2 last a user turn, 3 last an assistant turn.  0 and 3 may be the end.

Edits of a turn are D, K and R (and I before it, as often as need be), written in ASCII order of their letters.  Inserts stand before
turns, so audits of the same turns are never prefixes of one another: which of two is less is settled within
the turns they cover.
"""

from __future__ import annotations

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What must be inserted at the end of a conversation in each state.
TAIL = ("", "II", "I", "")
LEGAL = frozenset(("su", "ua", "au"))
NEXT = (2, 2, 3, 2)  # the state after an inserted or reroled turn
START = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # the state after a kept turn, by its kind
NEVER = 1 << 60

Turn = tuple[str, str]


def bounds(turns: list[Turn]) -> list[int]:
    """For each suffix a cost that no repair of it goes below.

    Forced deletions and truncated turns cost what they cost.  Beyond that, two neighbours (deleted ones left out) that
    can't stand side by side need an edit of one of them or an insert between them, and a turn of another role
    needs an edit; such troubles that share no turn add up, and the dearest set of them is taken.
    """
    least = [0] * (len(turns) + 1)
    forced, after, after_cost = 0, None, 0
    trouble = [0] * (len(turns) + 1)
    for i in range(len(turns) - 1, -1, -1):
        kind, fault = turns[i]
        trouble[i] = trouble[i + 1]
        if fault == "x":
            forced += DELETE
        else:
            own = min(REROLE, DELETE - TRUNCATED) if fault == "t" else min(REROLE, DELETE)
            forced += TRUNCATED if fault == "t" else KEEP
            if kind == "o":
                trouble[i] = max(trouble[i], own + trouble[i + 1])
            elif after is not None and kind + turns[after][0] not in LEGAL:
                trouble[i] = max(trouble[i], min(own, after_cost, INSERT) + trouble[after + 1])
            after, after_cost = i, own
        least[i] = forced + trouble[i]
    return least


def _edits(turn: Turn, state: int) -> list[tuple[str, int, int]]:
    """(letter, state after, cost) of what may be done before the next turn or with it, in ASCII order; only I stays at the turn."""
    kind, fault = turn
    out = [("D", state, DELETE), ("I", NEXT[state], INSERT)]
    if fault != "x":
        more = TRUNCATED if fault == "t" else 0
        if kind in START[state]:
            out.append(("K", START[state][kind], KEEP + more))
        out.append(("R", NEXT[state], REROLE + more))
    return out


def _dead(state: int, goal: int | None) -> bool:
    """States from which the goal can't be reached."""
    return goal is not None and goal < 2 and state > goal


def _explore(turns: list[Turn], entry: int, goal: int | None, least: list[int], most: int, by_promise: bool) -> tuple[int, str] | None:
    """Depth first with an explicit stack.

    By promise: edits with the least cost plus bound first, each leaf a better incumbent.  Otherwise in ASCII order, and the
    first leaf of cost ``most`` is the answer: prefixes are met in the order of their letters.  The dominance table
    holds the least cost with which a node (turn, state) was met; a later prefix that doesn't cost less is worse.
    """
    n = len(turns)
    table = [[NEVER] * 4 for _ in range(n + 1)]
    stack, best = [(0, entry, 0, "")], None
    while stack:
        i, state, cost, audit = stack.pop()
        limit = most if best is None else best[0] - 1
        if cost + least[i] > limit or cost >= table[i][state] or _dead(state, goal):
            continue
        table[i][state] = cost
        if i == n:
            if goal is None:
                cost, audit = cost + INSERT * len(TAIL[state]), audit + TAIL[state]
            elif state != goal:
                continue
            if cost <= limit:
                best = (cost, audit)
                if not by_promise:
                    return best
            continue
        found = [(i + (e != "I"), s, cost + c, audit + e) for e, s, c in _edits(turns[i], state)]
        if by_promise:
            found.sort(key=lambda x: (x[2] + least[x[0]], -x[0]))
        stack += reversed(found)
    return best


def search(turns: list[Turn], entry: int = 0, goal: int | None = None, least: list[int] | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest repair from a state to a state (None: to a conversation's end), the ASCII-least on ties; None if there is none."""
    least = bounds(turns) if least is None else least
    first = _explore(turns, entry, goal, least, NEVER - 1, True)
    return first and _explore(turns, entry, goal, least, first[0], False)


def plans(turns: list[Turn], entries: range) -> dict[str, list]:
    """``search`` for each way through the turns, as {entry and exit: [cost, audit]}."""
    least = bounds(turns)
    found = {f"{a}{b}": search(turns, a, b, least) for a in entries for b in range(4) if not (a > b and b < 2)}
    return {k: list(v) for k, v in found.items() if v}

"""Logs of protocols, judged."""

import random

import pytest

from gustline.operators.checks import ContractError
from gustline.operators.protocol import judged_log
from gustline.plans.protocol import EVIDENCE, MOVES, ONCE, RESERVED, STATES

SCHEMA = "protocol string, seq long, target string, block string, actor string, purpose string, assignments string, candidate string, model string, calibration string, report string"


def judge(spark, rows):
    out = judged_log(spark.createDataFrame(rows, SCHEMA), STATES[0], MOVES, EVIDENCE, RESERVED, ONCE)
    return {(r["protocol"], r["seq"]): (r["state"], r["fault"]) for r in out.collect()}


def by_hand(rows):
    """One event after another."""
    state, opened, out = {}, set(), {}
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for e in sorted((dict(zip(columns, r)) for r in rows), key=lambda e: e["seq"]):
        p, t, b = e["protocol"], e["target"], e["block"]
        now = state.get(p, STATES[0])
        if (t is None) == (b is None):
            fault = "malformed"
        elif t is not None:
            fault = "unknown" if t not in STATES else "transition" if t not in MOVES.get(now, []) else "evidence" if any(not (e[c] or "").strip() for c in EVIDENCE.get(t, [])) else None
            state[p] = t if fault is None else now
        else:
            fault = "unknown" if b not in RESERVED else "closed" if RESERVED[b] != now else "unattributed" if not ((e["actor"] or "").strip() and (e["purpose"] or "").strip()) else "consumed" if b in ONCE and (p, b) in opened else None
            opened |= {(p, b)} if fault is None else set()
        out[p, e["seq"]] = (now, fault)
    return out


def test_against_one_event_after_another(spark):
    rng = random.Random(5)
    rows = []
    for seq in range(3000):
        move = rng.random() < 0.6
        proof = [rng.choice(["x", "x", "x", "x", "x", "", None]) for _ in range(5)]
        rows.append((rng.choice("aaaabcdefgh") + str(seq // 600), seq, rng.choice([*STATES, "nowhere"]) if move else None, None if move and rng.random() < 0.98 else rng.choice([*RESERVED, "other"]), rng.choice(["me", "me", " ", None]), "test", *proof))
    got, want = judge(spark, rows), by_hand(rows)
    assert {f for _, f in want.values()} == {None, "malformed", "unknown", "transition", "evidence", "closed", "unattributed", "consumed"}
    assert {s for s, _ in want.values()} == set(STATES)
    assert got == want


def test_nulls_repeats_and_machines_that_return(spark):
    empty = (None,) * 9
    assert judge(spark, [(None, 1, *empty), ("a", None, *empty), (None, None, "exploratory", *empty[1:])]) == {(None, 1): (STATES[0], "malformed"), ("a", None): (STATES[0], "malformed"), (None, None): (STATES[0], "malformed")}
    assert judge(spark, []) == {}
    with pytest.raises(ContractError):
        judge(spark, [("a", 1, *empty)] * 2)
    for moves in ({"x": ["y"], "y": ["x"]}, {"x": ["x"]}):
        with pytest.raises(ContractError):
            judged_log(spark.createDataFrame([], SCHEMA), "x", moves, {}, {}, [])

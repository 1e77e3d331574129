"""A log of protocol events, judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.operators import protocol
from gustline.plans.registry import query, table

#: States of a protocol, in order, the moves between them, and what a move must show (fixed values).
STATES = ["infrastructure_test", "exploratory", "protocol_frozen", "model_frozen", "calibration_frozen", "final_test_consumed", "operationally_homologated"]
MOVES = {
    "infrastructure_test": ["exploratory", "protocol_frozen"],
    "exploratory": ["protocol_frozen"],
    "protocol_frozen": ["model_frozen"],
    "model_frozen": ["calibration_frozen"],
    "calibration_frozen": ["final_test_consumed"],
    "final_test_consumed": ["operationally_homologated"],
}
EVIDENCE = {"model_frozen": ["assignments", "candidate", "model"], "calibration_frozen": ["calibration"], "final_test_consumed": ["report"]}
RESERVED, ONCE = {"calibration": "model_frozen", "final_test": "calibration_frozen"}, ["final_test"]

_LIST = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"
_PAIRS = ", ".join(f"({STATES.index(a)}, {STATES.index(b)})" for a, bs in MOVES.items() for b in bs)


@query(f"""WITH RECURSIVE ev AS (SELECT user_id AS protocol, event_id AS seq, CASE WHEN event_id % 5 < 3 THEN CAST((event_id + user_id) % 7 AS INTEGER) END AS t, CASE WHEN event_id % 5 >= 3 THEN event_id % 2 END AS b, event_id % 4 <> 0 AS ok, event_id % 11 <> 0 AS named FROM events),
tr(a, b) AS (VALUES {_PAIRS}), w AS (SELECT DISTINCT protocol, 0 AS state, CAST(-1 AS BIGINT) AS at FROM ev UNION ALL
SELECT w.protocol, arg_min(ev.t, ev.seq), min(ev.seq) FROM w JOIN ev ON ev.protocol = w.protocol AND ev.seq > w.at JOIN tr ON tr.a = w.state AND tr.b = ev.t WHERE ev.ok OR ev.t NOT IN (3, 4, 5) GROUP BY w.protocol),
st AS (SELECT ev.protocol, seq, t, ev.b, ok, named, (SELECT max(state) FROM w WHERE w.protocol = ev.protocol AND w.at < ev.seq) AS s, EXISTS (SELECT 1 FROM w WHERE w.protocol = ev.protocol AND w.at = ev.seq) AS taken FROM ev),
f AS (SELECT *, CASE WHEN t IS NOT NULL THEN CASE WHEN taken THEN NULL WHEN (s, t) NOT IN (SELECT (a, b) FROM tr) THEN 'transition' ELSE 'evidence' END WHEN s <> 3 + b THEN 'closed' WHEN NOT named THEN 'unattributed' END AS fault FROM st)
SELECT protocol, seq, {_LIST}[s + 1] AS state, CASE WHEN fault IS NULL AND b = 1 AND seq > min(CASE WHEN fault IS NULL THEN seq END) OVER (PARTITION BY protocol, b) THEN 'consumed' ELSE fault END AS fault FROM f""")
def judged_log(spark, sf_dir):
    """A user's events as a protocol's log: three of five are moves, the others open reserved blocks; some lack evidence or an actor."""
    k = F.col("event_id")
    names = F.array(*map(F.lit, STATES))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("protocol"),
        k.alias("seq"),
        F.when(k % 5 < 3, F.get(names, ((k + F.col("user_id")) % 7).cast("int"))).alias("target"),
        F.when(k % 5 >= 3, F.when(k % 2 == 0, "calibration").otherwise("final_test")).alias("block"),
        F.when(k % 11 != 0, "someone").otherwise(" ").alias("actor"),
        F.lit("test").alias("purpose"),
        *(F.when(k % 4 != 0, F.lit(c)).alias(c) for c in ("assignments", "candidate", "model", "calibration", "report")),
    )
    return protocol.judged_log(events, STATES[0], MOVES, EVIDENCE, RESERVED, ONCE).select("protocol", "seq", "state", "fault")

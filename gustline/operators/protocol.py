"""An append-only log of a protocol's events, judged as a state machine: moves that are allowed and proven, reserved blocks that are opened in their state and at most once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.operators.checks import ContractError, few, require, require_unique
from gustline.shared import shared_dir


def _longest(transitions: dict[str, list[str]], start: str, seen: tuple[str, ...] = ()) -> int:
    """The most moves that a log can make; a machine that can return to a state is refused."""
    if start in seen:
        raise ContractError(f"a protocol can't return to {start}")
    return max((1 + _longest(transitions, t, (*seen, start)) for t in transitions.get(start, [])), default=0)


def judged_log(events: DataFrame, start: str, transitions: dict[str, list[str]], evidence: dict[str, list[str]], reserved: dict[str, str], once: list[str]) -> DataFrame:
    """Events with ``state``, that of their protocol before them, and ``fault`` (null: the event counts).

    Events: protocol, seq (their order, an integer, unique within a protocol), target (a state to move to) or block (a reserved block that is opened), actor, purpose, and the columns that ``evidence`` names for a
    state. Events that don't count change nothing. Faults of a move: unknown (no such state), transition (not from this state), evidence (a column is null or blank). Of an access: unknown, closed (the block is opened in
    another state), unattributed (no actor or purpose), consumed (a block of ``once`` that was opened before). malformed: both or neither, or a null seq or protocol.

    A state is never entered twice, so a protocol's path is found in as many steps as the machine has moves in a row: each is an aggregation by protocol that takes the first valid event behind the last one. Nothing gathers a protocol's
    events; where protocols are few (10,000) their states are broadcast and a protocol of many events is spread over all tasks.
    """
    states = list(dict.fromkeys([start, *transitions, *(t for ts in transitions.values() for t in ts)]))
    require(events, ["protocol", "seq", "target", "block", "actor", "purpose", *(c for cs in evidence.values() for c in cs)])
    if unknown := (set(evidence) | set(reserved.values())) - set(states) or set(once) - set(reserved):
        raise ContractError(f"not declared: {sorted(unknown)}")
    steps = _longest(transitions, start)
    shared_dir(events.sparkSession)
    sound = events.where("protocol IS NOT NULL AND seq IS NOT NULL")
    require_unique(sound, ["protocol", "seq"])
    code = {s: k for k, s in enumerate(states)}
    number = lambda c: F.coalesce(*(F.when(c == s, k) for s, k in code.items()))
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    both = F.col("target").isNotNull() == F.col("block").isNotNull()

    def proven(target: Column) -> Column:
        lacks = [(target == s) & ~filled(c) for s, cs in evidence.items() for c in cs]
        return ~F.coalesce(F.greatest(*lacks, F.lit(False), F.lit(False)), F.lit(False))

    def allowed(state: Column, target: Column) -> Column:
        pairs = [(state == code[a]) & (target == code[b]) for a, bs in transitions.items() for b in bs]
        return F.coalesce(F.greatest(*pairs, F.lit(False), F.lit(False)), F.lit(False))

    moves = sound.select("protocol", F.col("seq").cast("long").alias("_seq"), F.when(~both & proven(F.col("target")), number(F.col("target"))).alias("_to"))
    path = moves.select("protocol").distinct().select("protocol", F.lit(code[start]).alias("_state"), F.lit(None).cast("long").alias("_at"), *(F.lit(None).cast("long").alias(f"_s{k}") for k in code.values()))
    for _ in range(steps):
        next_ = F.when(allowed(F.col("_state"), F.col("_to")) & (F.col("_at").isNull() | (F.col("_seq") > F.col("_at"))), F.col("_seq"))
        found = moves.join(few(path), "protocol").groupBy("protocol").agg(*(F.max(c).alias(c) for c in path.columns[1:]), F.min(next_).alias("_n"), F.min_by("_to", next_).alias("_t"))
        entered = {f"_s{k}": F.when(F.col("_t") == k, F.col("_n")).otherwise(F.col(f"_s{k}")) for k in code.values()}
        path = found.select("protocol", F.coalesce("_t", "_state").alias("_state"), F.coalesce("_n", "_at").alias("_at"), *(e.alias(c) for c, e in entered.items()))
        path = path.checkpoint()  # a row for each protocol
    entries = F.array(*(F.struct(F.col(f"_s{k}").alias("at"), F.lit(k).alias("state")) for k in code.values()))
    name = lambda c: F.get(F.array(*map(F.lit, states)), c)
    own = events.join(few(path.select("protocol", entries.alias("_entries"))), "protocol", "left")
    before = F.coalesce(F.array_max(F.filter("_entries", lambda x: x["at"] < F.col("seq")))["state"], F.lit(code[start]))
    own = own.withColumn("_before", before).withColumn("state", name(F.col("_before")))
    target = number(F.col("target"))
    taken = F.exists("_entries", lambda x: F.coalesce((x["at"] == F.col("seq")) & (x["state"] == target), F.lit(False)))
    opens = F.coalesce(*(F.when(F.col("block") == b, F.lit(s)) for b, s in reserved.items()), F.lit(None).cast("string"))
    broken = both | F.col("protocol").isNull() | F.col("seq").isNull()
    move = F.when(target.isNull(), "unknown").when(taken, None).when(~allowed(F.col("_before"), target), "transition").otherwise("evidence")
    access = F.when(opens.isNull(), "unknown").when(opens != F.col("state"), "closed").when(~(filled("actor") & filled("purpose")), "unattributed")
    own = own.withColumn("fault", F.when(broken, "malformed").when(F.col("target").isNotNull(), move).otherwise(access))
    first = own.where(F.col("fault").isNull() & F.col("block").isin(*once)).groupBy("protocol", "block").agg(F.min("seq").alias("_first"))
    out = own.join(few(first), ["protocol", "block"], "left").withColumn("fault", F.when(F.col("fault").isNull() & (F.col("seq") > F.col("_first")), "consumed").otherwise(F.col("fault")))
    return out.select(*events.columns, "state", "fault")

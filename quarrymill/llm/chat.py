"""Operator 4: chat formatting with a minimum-cost repair of roles.

Legal conversations are those of an automaton: an optional system turn, then user and assistant by turns, ending
with the assistant. Dynamic programming over (turns read, state) finds the cheapest way to make a conversation
legal from these edits: merge a turn into the one before it, which has the same role; give a turn another role;
insert an empty turn. The repaired sequence is then rendered with markers.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
#: Whole numbers, so that ties are exact. A role that isn't one of ROLES has to be replaced, which costs UNKNOWN.
MERGE, INSERT, RELABEL, UNKNOWN = 2, 4, 5, 1
#: State -> roles that may follow, and the state each leads to. 0: nothing yet; 1, 2, 3: the last turn's role.
NEXT = {0: {"system": 1, "user": 2}, 1: {"user": 2}, 2: {"assistant": 3}, 3: {"user": 2}}
FINAL = 3
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"


def _repair(roles: tuple[str, ...]) -> tuple[int, tuple[tuple[str, str], ...]]:
    """Cost and edits (what, role), what: keep, relabel (both begin a turn), merge (joins the last), insert.

    Of ways that cost the same, the one with fewer insertions, then relabels, then merges is taken, then the first
    found in the order of states, keep before relabel before merge.
    """
    worst = ((1 << 60, 0, 0, 0), None)
    now = {0: ((0, 0, 0, 0), None)}

    def plus(cost, what, more):
        return (cost[0] + more, cost[1] + (what == "insert"), cost[2] + (what in ("relabel", "remerge")), cost[3] + (what in ("merge", "remerge")))

    def insert(best):
        for _ in range(3):  # more than two insertions in a row never help
            for q in sorted(best):
                for role, to in NEXT[q].items():
                    new = plus(best[q][0], "insert", INSERT)
                    if new < best.get(to, worst)[0]:
                        best[to] = (new, (best[q][1], "insert", role))
        return best

    now = insert(now)
    for r in roles:
        after: dict = {}
        for q in sorted(now):
            cost, path = now[q]
            for role, to in NEXT[q].items():
                what, more = ("keep", 0) if role == r else ("relabel", RELABEL if r in ROLES else UNKNOWN)
                new = plus(cost, what, more)
                if new < after.get(to, worst)[0]:
                    after[to] = (new, (path, what, role))
            if q:
                role = ROLES[q - 1]
                what, more = ("merge", MERGE) if role == r else ("remerge", MERGE + (RELABEL if r in ROLES else UNKNOWN))
                new = plus(cost, what, more)
                if new < after.get(q, worst)[0]:
                    after[q] = (new, (path, what, role))
        now = insert(after)
    cost, path = now[FINAL] if roles else ((0, 0, 0, 0), None)
    edits = []
    while path:
        path, what, role = path
        edits.append((what, role))
    return cost[0], tuple(reversed(edits))


_short = lru_cache(1 << 16)(_repair)


def repair(roles: tuple[str, ...]) -> tuple[int, tuple[tuple[str, str], ...]]:
    return _short(roles) if len(roles) <= 64 else _repair(roles)


def clean(text: str | None) -> str:
    """Content can't forge markers: a space breaks what looks like one."""
    return (text or "").replace("<|", "< |")


def render(turns: list[tuple[str, str | None]]) -> dict:
    cost, edits = repair(tuple((r or "").strip().lower() for r, _ in turns))
    out: list[list[str]] = []
    texts = iter(turns)
    for what, role in edits:
        text = "" if what == "insert" else clean(next(texts)[1])
        if what in ("merge", "remerge"):
            out[-1][1] = f"{out[-1][1]}\n{text}" if out[-1][1] and text else out[-1][1] + text
        else:
            out.append([role, text])
    kinds = [w for w, _ in edits]
    return {"chat": "".join(OPEN.format(role=r) + t + CLOSE for r, t in out), "turns_in": len(turns), "turns_out": len(out), "cost": cost,
            "merges": kinds.count("merge") + kinds.count("remerge"), "relabels": kinds.count("relabel") + kinds.count("remerge"), "inserts": kinds.count("insert")}


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, chat STRING, turns_in, turns_out, cost, merges, relabels, inserts BIGINT): one row a conversation.

    Turns come in the order of turn_col, nulls last; of equal numbers by role, then text, and a row that occurs twice is
    two turns. Roles are compared without case and outer white space; null and unknown ones are relabelled. Null text
    is empty. A row with a null id belongs to no other: it is a conversation of its own, with a null id. Long texts and
    long conversations are rendered whole. Other columns are not read, whatever their names; where id_col is called as one
    of the results is, that one gets an underscore. An empty table gives none.
    """
    rows = common.pick(turns, id=id_col, turn=turn_col, role=role_col, text=text_col)
    one = F.struct(F.col("turn").isNull().alias("a"), F.col("turn").alias("b"), F.col("role").alias("r"), F.col("text").alias("t"))
    whole = rows.filter("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    whole = whole.union(rows.filter("id IS NULL").select("id", F.array(one)))
    whole = whole.select("id", F.transform("turns", lambda x: x["r"]).alias("r"), F.transform("turns", lambda x: x["t"]).alias("t"))
    names = ["turns_in", "turns_out", "cost", "merges", "relabels", "inserts"]

    @common.tidied
    def run(batches):
        for batch in batches:
            done = [render(list(zip(r, t))) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d["chat"] for d in done], pa.string()), *(pa.array([d[n] for d in done], pa.int64()) for n in names)], names=["id", "chat", *names])

    done = whole.mapInArrow(run, f"id {common.kind(turns, id_col)}, chat string, " + ", ".join(f"{n} bigint" for n in names))
    return common.named(done, id_col, "chat", *names)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(common.table(spark, sf_dir, "conversations"))

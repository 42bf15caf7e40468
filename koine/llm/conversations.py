"""Repair of conversations' turn structure by Hirschberg's divide and conquer over four states.

A conversation's rows are edited (kept, given another role, deleted, or turns without text put before them) until the
roles read as an optional system turn and pairs of user and assistant. After each row the text so far is in one of four
states, so a row, and a run of rows, is a table of costs from state to state. A run's middle is crossed where the forward
costs to it and the backward costs from it are least together, of equals where the audit so far is first in ASCII order; then both halves
are done alike, in space linear in the run.

Runs are cut to RUN rows of a range sort, so no task holds a conversation. Each run's table is made on its own; a
conversation's runs, a table each, are crossed in the same way; with both ends known each run is reconstructed on its own.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koine.llm.common import cut, ship, with_totals
from koine.scratch import placed

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may come next: state -> role's initial -> state.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits; what a kept truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row's code: its role's initial (s, u, a or x), in upper case where the row is truncated; - where it has to go.
CODES = "suaxSUAX-"
#: Bits of a row's number within a run.
RUN = 12
FAR = 1 << 60
#: White space as in the conversations' contract.
SPACE = r"[\x20\x09-\x0D]"


def _inserted(state: int, times: int) -> int | None:
    """The state after so many turns put in, each the one turn that may follow and isn't the system's."""
    for _ in range(times):
        state = NEXT[state]["u" if "u" in NEXT[state] else "a"]
    return state


def _edits(code: str) -> list[list[tuple[int, str] | None]]:
    """From state to state, the cheapest edits of one row with the turns put before it, as (cost, letters)."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        for times in range(3):
            at = _inserted(start, times)
            options = [(DELETE, "D", at)]
            if code != "-":
                cut_off = TRUNCATED * code.isupper()
                options += [(cut_off, "K", NEXT[at][code.lower()])] if code.lower() in NEXT[at] else []
                options += [(REROLE + cut_off, "R", NEXT[at][r]) for r in ROLES if r in NEXT[at]]
            for cost, letter, end in options:
                found = (cost + INSERT * times, "I" * times + letter)
                if table[start][end] is None or found < table[start][end]:
                    table[start][end] = found
    return table


EDITS = {c: _edits(c) for c in CODES}
#: At the end: turns put in until the text may end there.
LAST = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: A table: costs, and for each first state the order of the audits to each last state.
Table = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]


def _table_of(code: str) -> Table:
    costs = tuple(tuple(FAR if e is None else e[0] for e in row) for row in EDITS[code])
    ranks = []
    for row in EDITS[code]:
        order = sorted((e[1], q) for q, e in enumerate(row) if e is not None)
        at = {q: i for i, (_, q) in enumerate(order)}
        ranks.append(tuple(at.get(q, 9) for q in range(4)))
    return costs, tuple(ranks)


TABLES = {c: _table_of(c) for c in CODES}


def forward(tables, lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Least costs from `start` over tables[lo:hi] to each state, and the order of the audits that reach them first.

    Audits to two states have the same number of letters other than I and end in one, so neither begins with the other:
    the order of two audits stays that of their beginnings.
    """
    cost, rank = [FAR] * 4, [9] * 4
    cost[start], rank[start] = 0, 0
    for i in range(lo, hi):
        step, order = tables[i]
        reach = [min((cost[p] + step[p][q], rank[p], order[p][q]) for p in range(4)) for q in range(4)]
        places = {r: n for n, r in enumerate(sorted({r[1:] for r in reach if r[0] < FAR}))}
        cost = [min(r[0], FAR) for r in reach]
        rank = [places[r[1:]] if r[0] < FAR else 9 for r in reach]
    return cost, rank


def backward(tables, lo: int, hi: int, end: list[int]) -> list[int]:
    """Least costs from each state over tables[lo:hi] to the end, where a state costs `end`."""
    for i in range(hi - 1, lo - 1, -1):
        step = tables[i][0]
        end = [min(min(step[p][q] + end[q] for q in range(4)), FAR) for p in range(4)]
    return end


def crossings(tables, start: int, end: list[int]) -> tuple[int, list[int]]:
    """The least cost, and the states before, between and after the tables on the cheapest way whose audit comes first."""
    states = [start] * (len(tables) + 1)
    cost, rank = forward(tables, 0, len(tables), start)
    total = min(c + e for c, e in zip(cost, end, strict=True))
    states[-1] = min((cost[q] + end[q], rank[q], q) for q in range(4))[2]
    spans = [(0, len(tables))]
    while spans:
        lo, hi = spans.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead, order = forward(tables, lo, mid, states[lo])
        back = backward(tables, mid, hi, [0 if q == states[hi] else FAR for q in range(4)])
        states[mid] = min((ahead[q] + back[q], order[q], q) for q in range(4))[2]
        spans += [(lo, mid), (mid, hi)]
    return total, states


ENDS = [INSERT * LAST[q] for q in range(4)]


@lru_cache(1 << 14)
def run_table(codes: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """A run's table: least costs and orders, 16 numbers each, by first and last state."""
    tables = [TABLES[c] for c in codes]
    found = [forward(tables, 0, len(tables), p) for p in range(4)]
    return tuple(c for f in found for c in f[0]), tuple(r for f in found for r in f[1])


@lru_cache(1 << 14)
def run_edits(codes: str, start: int, end: int | None) -> tuple[int, list[str], list[str], list[str | None], str]:
    """Cost; for each row of a run between two states the initials of the turns put in before it, its letter (K, R or D)
    and its new role if it gets one; initials of the turns put in after the run. end None: the conversation ends here."""
    cost, states = crossings([TABLES[c] for c in codes], start, ENDS if end is None else [0 if q == end else FAR for q in range(4)])
    before, letters, roles = [], [], []
    for c, p, q in zip(codes, states, states[1:], strict=False):
        audit = EDITS[c][p][q][1]
        before.append(_initials(p, len(audit) - 1))
        letters.append(audit[-1])
        roles.append({USER: "user", ASSISTANT: "assistant"}[q] if audit[-1] == "R" else None)
    return cost, before, letters, roles, _initials(states[-1], LAST[states[-1]]) if end is None else ""


def _initials(state: int, times: int) -> str:
    out = ""
    for _ in range(times):
        out += "u" if "u" in NEXT[state] else "a"
        state = _inserted(state, 1)
    return out


def audit_of(codes: str) -> tuple[int, str]:
    """Cost and audit of one conversation given by its codes."""
    cost, before, letters, _, last = run_edits(codes, START, None)
    return cost, "".join("I" * len(b) + x for b, x in zip(before, letters, strict=True)) + "I" * len(last)


def faults(text: Column) -> tuple[Column, Column]:
    """blank: nothing but white space; truncated: the last character that isn't white space ends no sentence."""
    bare = F.regexp_replace(text, f"{SPACE}+$", "")
    return bare == "", ~bare.rlike(r"(?s)[.!?]\z")


def key_of(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("n"))


def _coded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in their order with `__key` and `__id`, and for each `__key`, `__id` its turn, fault, initial, code and run."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key_of(F.col("conv_id")).alias("__key"))
    at = placed(named, [F.col("__key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]).drop("__part")
    narrow = at.select("__key", "__id", "turn", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("__same"), F.substring("role", 1, 1).alias("__initial"), *[c.alias(n) for c, n in zip(faults(F.col("text")), ("__blank", "__open"), strict=True)])
    seen = with_totals(narrow, ["__key", "__same"], "__id", {"__first": F.min("__id")}, {"__first": F.min("__first")})
    fault = F.when(F.col("__blank"), "blank").when(F.col("__id") > F.col("__first"), "duplicate").when(F.col("__open"), "truncated")
    initial = F.when(F.col("__initial").isin("s", "u", "a"), F.col("__initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    seen = seen.select("__key", "__id", "turn", fault.alias("fault"), initial.alias("initial")).withColumns({"code": code, "run": F.shiftright("__id", RUN)})
    return at, seen


CHAINED = "key string, blank long, duplicate long, truncated long, cost long, illegal long, gaps long, ends array<struct<run:long,start:int,end:int,last:boolean>>"
EDITED = "key string, run long, first long, before array<string>, letters array<string>, roles array<string>, after string"


def _runs(seen: DataFrame) -> DataFrame:
    """A row a run: codes and initials of its rows in order (at most 2^RUN), counts of faults, its turns, its table."""
    entry = F.sort_array(F.collect_list(F.struct("__id", "code", "initial")))
    count = lambda f: F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f)
    joined = lambda c: F.array_join(F.transform("entries", lambda e: e[c]), "").alias(c + "s")
    runs = seen.groupBy(F.col("__key").alias("key"), "run").agg(
        F.min("__id").alias("first"), entry.alias("entries"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"), *map(count, ("blank", "duplicate", "truncated"))
    )
    runs = runs.select("key", "run", "first", "low", "high", "turns", "blank", "duplicate", "truncated", joined("code"), joined("initial"))

    def tabled(batches):
        for b in batches:
            found = [run_table(c) for c in b.column("codes").to_pylist()]
            yield pa.record_batch([*b.columns, pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=[*b.schema.names, "cost", "rank"])

    kinds = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in runs.columns)
    return cut(runs.mapInArrow(tabled, kinds + ", cost array<long>, rank array<int>"), "runs")


LEGAL = ("su", "ua", "au")


def _chained(runs: DataFrame) -> DataFrame:
    """A row a conversation: what its runs sum to, the least cost, and each run's states, crossed over the runs' tables."""
    part = F.struct("run", "cost", "rank", "low", "high", "turns", F.substring("initials", 1, 1).alias("head"), F.substring("initials", -1, 1).alias("tail"), F.lit(0).alias("x"))
    inside = F.size(F.filter(F.sequence(F.lit(1), F.length("initials")), lambda i: (i < F.length("initials")) & ~F.substring(F.col("initials"), i, F.lit(2)).isin(*LEGAL))).cast("long")
    by = runs.groupBy("key").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum(inside).alias("inside"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    def crossed(batches):
        for b in batches:
            out = []
            for parts, inside_ in zip(b.column("parts").to_pylist(), b.column("inside").to_pylist(), strict=True):
                square = lambda x: tuple(tuple(x[i : i + 4]) for i in range(0, 16, 4))
                cost, states = crossings([(square(p["cost"]), square(p["rank"])) for p in parts], START, ENDS)
                ends = [{"run": p["run"], "start": a, "end": z, "last": i + 1 == len(parts)} for i, (p, a, z) in enumerate(zip(parts, states, states[1:], strict=False))]
                illegal = inside_ + sum(p["tail"] + q["head"] not in LEGAL for p, q in zip(parts, parts[1:], strict=False))
                told = [p for p in parts if p["turns"]]
                distinct = sum(p["turns"] for p in told) - sum(p["high"] == q["low"] for p, q in zip(told, told[1:], strict=False))
                gaps = told[-1]["high"] - told[0]["low"] + 1 - distinct if told else 0
                out.append((cost, illegal, gaps if gaps < 1 << 63 else None, ends))
            made = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
            states = pa.array([o[3] for o in out], pa.list_(pa.struct([("run", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())])))
            yield pa.record_batch([b.column("key"), *[b.column(c) for c in ("blank", "duplicate", "truncated")], *made, states], names=["key", "blank", "duplicate", "truncated", "cost", "illegal", "gaps", "ends"])

    return cut(by.mapInArrow(crossed, CHAINED), "chained")


def _edited(runs: DataFrame, chained: DataFrame) -> DataFrame:
    """A row a run: what run_edits says of its rows, in lists."""
    ends = chained.select("key", F.inline("ends"))

    def edit(batches):
        for b in batches:
            found = [run_edits(c, s, None if last else e) for c, s, e, last in zip(*[b.column(x).to_pylist() for x in ("codes", "start", "end", "last")], strict=True)]
            made = [pa.array([f[i] for f in found], pa.list_(pa.string()) if i < 4 else pa.string()) for i in range(1, 5)]
            yield pa.record_batch([*[b.column(c) for c in ("key", "run", "first")], *made], names=["key", "run", "first", "before", "letters", "roles", "after"])

    return cut(runs.select("key", "run", "first", "codes").join(ends, ["key", "run"]).mapInArrow(edit, EDITED), "edited")


def _audited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in their places with their edits, and a row a conversation with its counts, cost and audit."""
    ship(rows.sparkSession)
    at, seen = _coded(rows)
    runs = _runs(seen)
    chained = _chained(runs)
    edited = _edited(runs, chained)
    own = (F.col("__id") - F.col("first")).cast("int")
    known = at.withColumn("run", F.shiftright("__id", RUN)).join(edited.withColumnRenamed("key", "__key"), ["__key", "run"])
    after = F.when(own == F.size("letters") - 1, F.col("after")).otherwise("")
    edits = known.select("__key", "conv_id", "__id", "role", "text", *[F.get(c, own).alias(n) for c, n in (("before", "before"), ("letters", "letter"), ("roles", "new_role"))], after.alias("after"))
    letters = F.zip_with("before", "letters", lambda b, x: F.concat(F.repeat(F.lit("I"), F.length(b)), x))
    pieces = F.sort_array(F.collect_list(F.struct("run", F.concat(F.array_join(letters, ""), F.repeat(F.lit("I"), F.length("after"))).alias("audit"))))
    audits = edited.groupBy("key").agg(F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    return edits, chained.drop("ends").join(audits, "key").withColumnRenamed("key", "__key")


def _turns(edits: DataFrame) -> DataFrame:
    """__key, conv_id, place, role, text, edit of each turn of the repaired conversations."""

    def put_in(initials: str) -> Column:
        each = F.filter(F.split(initials, ""), lambda x: x != "")
        return F.transform(each, lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))

    own = F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"), F.col("letter").alias("edit"))
    all_ = F.concat(put_in("before"), F.filter(F.array(own), lambda t: t["edit"] != "D"), put_in("after"))
    turns = edits.select("__key", "conv_id", "__id", F.posexplode(all_).alias("at", "t"))
    return turns.select("__key", "conv_id", (F.col("__id") * 8 + F.col("at")).alias("place"), "t.role", "t.text", "t.edit")  # at most 5 turns a row


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit: the turns of the repaired conversations; place grows within a conversation.

    rows(conv_id, turn, role, text) are read by turn, nulls first, of equal turns by role and text. A null role or text is
    one space; rows with a null conv_id are one conversation. Blank rows and repeats (role and text seen earlier in the
    conversation) go. edit: K for kept turns, R for ones with another role, I for ones put in, without text. Other columns are
    ignored, whatever their names. Empty table: no rows.
    """
    return _turns(_audited(rows)[0]).drop("__key")


def conversation_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of rows, as
    repair_conversations reads them. gaps: turn numbers missing between the first and the last; null beyond a long."""
    edits, report = _audited(rows)
    ids = edits.select("__key", "conv_id").distinct()
    return ids.join(report, "__key").select("conv_id", *COUNTS, "audit")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(turns: DataFrame) -> DataFrame:
    """__key, sha256 of a conversation's `role:text` joined by newlines, in the order of place. SHA-256 can't be put
    together from parts: a conversation streams through one task, of which that holds an Arrow batch at a time."""
    import hashlib

    lines = turns.select("__key", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("__key").sortWithinPartitions("__key", "place")

    def stream(batches):
        key, running = None, None
        for b in batches:
            done = []
            for k, line in zip(b.column("__key"), b.column("line"), strict=True):
                k, line = k.as_py(), line.as_py().encode()
                if k == key:
                    running.update(b"\n" + line)
                    continue
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(line)
            if done:
                yield pa.record_batch([pa.array(list(c), pa.string()) for c in zip(*done, strict=True)], names=["__key", "sha256"])
        if running is not None:
            yield pa.record_batch([pa.array([x], pa.string()) for x in (key, running.hexdigest())], names=["__key", "sha256"])

    return lines.mapInArrow(stream, "__key string, sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2
    takes its [.!?] away, 3 repeats it, 4 makes it the user's. Nulls are one space, in the text that is hashed, too."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "utf-8")) % 20
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), by.alias("__by")).filter("__by <> 0")
    text = F.when(F.col("__by") == 1, "").when(F.col("__by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__by") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__by") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("__n")).drop("__n")


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: conversation_report of damage(),
    a row for each conv_id of conversations(conv_id, turn, role, text), with a digest of what the repair leaves.

    Where damage leaves no rows: zeros, an empty audit, the digest of nothing. Nulls, repeats, ties, other columns and the
    empty table as in repair_conversations.
    """
    edits, report = _audited(damage(conversations))
    ids = conversations.select("conv_id").distinct().withColumn("__key", key_of(F.col("conv_id")))
    told = ids.join(report, "__key", "left").join(digests(_turns(edits)), "__key", "left")
    none = F.col("audit").isNull()
    return told.select(
        "conv_id", *[F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )

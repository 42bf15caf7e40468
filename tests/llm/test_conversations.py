import hashlib
import heapq
import random
import re
import zlib
from itertools import pairwise, product

import pytest

from koine.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(codes):
    """Cost and audit by Dijkstra's search over (cost, audit), with no use of tables or halves."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        state = (at, roles[-1:] if roles else "", bool(roles))
        if (state, audit) in seen or len(roles) > 2 * len(codes) + 4:
            continue
        seen.add((state, audit))
        ok = lambda r: re.fullmatch("s?(ua)*u?", r)
        for r in "ua":
            if ok(roles + r):
                heapq.heappush(heap, (cost + 2, audit + "I", at, roles + r))
        if at == len(codes):
            continue
        c = codes[at]
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles))
        if c != "-":
            more = c.isupper()
            if c.lower() != "x" and ok(roles + c.lower()):
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + c.lower()))
            for r in "ua":
                if ok(roles + r):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, roles + r))


def test_audits_against_a_plain_search():
    for n in range(5):
        for codes in product("suaxU-", repeat=n):
            codes = "".join(codes)
            assert cv.audit_of(codes) == cheapest(codes), codes
    rng = random.Random(4)
    for _ in range(60):
        codes = "".join(rng.choice("suuaaxSUAX-") for _ in range(rng.randrange(5, 9)))
        assert cv.audit_of(codes) == cheapest(codes), codes


def whole_dp(codes):
    """Cost and audit with each state's best audit carried as text."""
    best = {cv.START: (0, "")}
    for c in codes:
        reached = {}
        for p, (cost, audit) in best.items():
            for q, e in enumerate(cv.EDITS[c][p]):
                if e and ((cost + e[0], audit + e[1]) < reached.get(q, (1 << 60, ""))):
                    reached[q] = (cost + e[0], audit + e[1])
        best = reached
    return min((cost + 2 * cv.LAST[q], audit + "I" * cv.LAST[q]) for q, (cost, audit) in best.items())


def plain(rows):
    """A conversation's report after damage, by the definition; audit by whole_dp."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    told, codes, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        if fault:
            told[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    cost, audit = whole_dp(codes)
    out, at, state = [], 0, ""
    for x in audit:
        role = "a" if state == "u" else "u"
        if x == "I":
            out.append(f"{cv.ROLES[role]}:")
            state = role
            continue
        _, own, text = rows[at]
        at += 1
        if x == "R":
            out.append(f"{cv.ROLES[role]}:{text}")
            state = role
        elif x == "K":
            out.append(f"{own}:{text}")
            state = own[:1]
    return (gaps, told["blank"], told["duplicate"], told["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def plain_report(rows):
    """The query by the definition: {conv_id: report}, {conv_id: lines}."""
    groups = {}
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = shown(role), shown(text)
        by = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if by == 0:
            continue
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        own += [(turn, "user" if by == 4 else role, text)] * (1 + (by == 3))
    return {c: plain(g)[0] for c, g in groups.items()}


def some_rows(seed, talks, longest):
    rng, rows = random.Random(seed), []
    for c in range(talks):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"][t % 2 :] + ["system", "user", "assistant", "tool", "", None, "umpire"])
            text = rng.choice(["One. Two!", "no end", " ", "", None, "Same?", "Long. " * 40 + "\n", f"text {t}.", "é ", "Ends. "])
            rows.append((rng.choice([c, c, c, None]) if c < 2 else c, rng.choice([t, t, t, None, t + 2]), role, text))
    return rows


@pytest.mark.parametrize("bits", [12, 1])
def test_report_against_the_definition(spark, monkeypatch, bits):
    monkeypatch.setattr(cv, "RUN", bits)  # runs of two rows: conversations are crossed run by run
    rows = some_rows(bits, 40, 14)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as run", "2 as first", "3 as key", "4 as audit", "5 as __id").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair_report(df).collect()}
    want = plain_report(rows)
    assert got.keys() == want.keys() and None in got
    for c in want:
        assert got[c] == want[c], c


def test_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"turn {t}.", f"turn {t}", "again."])) for t in range(9000)]
    got = cv.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert [tuple(r)[1:] for r in got] == [plain_report(rows)[7]]


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes"), (2, 0, "tool", "x."), (3, 0, None, None), (4, None, "assistant", "A."), (4, None, "assistant", "A.")]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = cv.repair_conversations(df).orderBy("conv_id", "place").collect()
    told = {}
    for r in turns:
        told.setdefault(r.conv_id, []).append((r.role, r.text, r.edit))
    assert told[1] == [("user", "Hi.", "K"), ("assistant", "", "I"), ("user", "There.", "K"), ("assistant", "Yes", "K")]
    assert told[4] == [("user", "", "I"), ("assistant", "A.", "K")] and told.keys() == {1, 4}
    report = {r.conv_id: tuple(r)[1:] for r in cv.conversation_report(df).collect()}
    assert report == {1: (0, 0, 0, 1, 1, 3, "KIKK"), 2: (0, 0, 0, 0, 0, 3, "D"), 3: (0, 1, 0, 0, 0, 3, "D"), 4: (0, 0, 1, 0, 1, 5, "IKD")}


def test_degenerate_tables(spark):
    assert cv.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = cv.repair_report(spark.createDataFrame([(gone, 0, "user", "x" * 3_000_000)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    wide = cv.conversation_report(spark.createDataFrame([(1, -(2**63), "user", "long. " * 400_000), (1, 2**63 - 1, "assistant", "b.")], SCHEMA)).collect()
    assert [tuple(r) for r in wide] == [(1, None, 0, 0, 0, 0, 0, "KK")]

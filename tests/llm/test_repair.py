"""Conversation repair against a plain dynamic program over all repairs; faults and digests in plain Python; odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from lodestar.llm import repair

AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def plain(rows):
    """rows: (role, text, fault) -> least (cost, audit, repaired lines), by trying every edit at every row."""
    def inserts(best):
        for _ in range(2):
            for state, (cost, audit, lines) in list(best.items()):
                to = AFTER[state]
                new = (cost + 2, audit + "I", lines + [f"{NAME[to]}:"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = inserts({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}

        def put(state, new):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, lines) in best.items():
            put(state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra, to = int(fault == "truncated"), AFTER[state]
            put(to, (cost + 2 + extra, audit + "R", lines + [f"{NAME[to]}:{text}"]))
            if role[:1] == to or (state == "" and role[:1] == "s"):
                put(role[:1], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
        best = inserts(after)
    return min(best[s] for s in ("", "a") if s in best)


def from_code(c):
    role = {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool")
    return role, "t", "blank" if c == "x" else "truncated" if c.isupper() else None


def test_search_matches_all_repairs():
    for n in range(5):
        for codes in itertools.product("suaUA-x", repeat=n):
            codes = "".join(codes)
            cost, audit, lines = plain([from_code(c) for c in codes])
            assert repair.search(codes) == (cost, audit), codes
            rows, roles = repair.written(codes, audit)
            assert [f"{r or from_code(codes[i - 1])[0]}:{'t' if i else ''}" for i, r in zip(rows, roles)] == lines
    r = random.Random(2)
    for _ in range(1500):
        codes = "".join(r.choices("suaSUA-Tx", weights=[1, 6, 6, 1, 2, 2, 1, 1, 2], k=r.randint(5, 40)))
        assert repair.search(codes) == plain([from_code(c) for c in codes])[:2], codes


def test_very_long_conversations():
    r = random.Random(3)
    codes = "".join(r.choices("uaUAx", weights=[5, 5, 1, 1, 1], k=6000))
    cost, audit = repair.search(codes)
    best = {0: 0, 2: 2, 3: 4}                                   # costs alone, without audits
    for c in codes:
        after = {}
        for state, spent in best.items():
            for letter, price, (_, to) in repair.steps(c, (0, state)):
                if letter != "I":
                    after[to] = min(after.get(to, 10 ** 9), spent + price)
        for _ in range(2):
            for state, spent in list(after.items()):
                after[repair.NEXT[state]] = min(after.get(repair.NEXT[state], 10 ** 9), spent + 2)
        best = after
    assert cost == min(best[s] for s in (0, 3) if s in best)
    assert len(audit.replace("I", "")) == 6000


def expected(source):
    """Contract columns by conversation from (conv_id, turn, role, text) rows, in plain Python."""
    convs, out = defaultdict(list), {}
    for conv, turn, role, text in source:
        convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        new = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        convs[conv] += [((turn is not None, turn or 0, role, text), turn, *new)] * (2 if kind == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda x: x[0])
        seen, faults = set(), []
        for _, _, role, text in rows:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [x[1] for x in rows if x[1] is not None]
        cost, audit, lines = plain([(x[2], x[3], f) for x, f in zip(rows, faults)])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answers(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int, cost string").write.parquet(f"{tmp_path}/conversations.parquet")
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.op13(spark, str(tmp_path)).collect()}


def test_query_on_odd_conversations(spark, tmp_path):
    r = random.Random(5)
    texts = [None, "", " \n\t", "Yes.", "no", "Wait!  \n", "Why?\x0b", "a ", "…", "Done.\x85", "x" * 40_000 + "."]
    rows = [(None, None, None, None), (None, 0, "user", "a."), (1, None, "user", "a."), (1, None, "user", "a."), (2, 5, "", "b"), (3, 1, "tool", "c.")]
    for conv in range(10, 70):
        for _ in range(r.randint(1, 14)):
            rows.append((conv, r.choice([None, *range(8)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]), r.choice(texts)))
    rows += [(99, t, ("user", "assistant")[t % 2], f"turn {t}" + "."[: t % 5]) for t in range(900)]
    got = answers(spark, tmp_path, [(*x, 7, "k") for x in rows])
    want = expected(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_no_rows(spark, tmp_path):
    assert answers(spark, tmp_path, []) == {}


def test_query_matches_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.op13(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == expected(rows)


def test_repaired_turns_are_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (1, 2, "assistant", ""), (1, 3, "assistant", "Yes.")],
                               "conv_id long, turn long, role string, text string")
    rows = repair.faulty(df)
    out = repair.repaired(rows, repair.plans(rows)).orderBy("place").collect()
    cost, audit, lines = plain([("user", "Hello.", None), ("user", "Again.", None), ("assistant", "", "blank"), ("assistant", "Yes.", None)])
    assert [f"{r.role}:{r.text}" for r in out] == lines
    assert "".join(r.edit for r in out) == audit.replace("D", "")
    assert rows.where(F.col("fault") == "blank").count() == 1

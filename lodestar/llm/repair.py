"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A conversation is repaired when its role initials read ``(s?(ua)+)?``: an optional system turn, then user and assistant in
turn. The nodes of the lattice are (rows consumed, state of what is written: nothing, s, u, a); the edges are the edits

* Keep (K): cost 0, if the row's initial may follow;
* Rerole (R) to user or assistant: 2;
* Delete (D): 3, the only edit for blank and duplicate rows;
* Insert (I) an empty user or assistant turn anywhere: 2;

and a truncated row that isn't deleted costs 1 more. Two searches run, forward from the start and in reverse from the ends, each
from its own heap; when their heaps can no longer beat the best meeting, and all crossings of that cost are settled, the
ASCII-least audit (the edits' initials in order) of the cheapest repairs is taken. After a letter the next node is certain, so an
audit names one repair.

Rows go by turn, nulls first, then role and text. A row's first fault counts: blank (no character besides
``\\x20\\x09-\\x0D``), duplicate (role and text seen earlier in the conversation), truncated (last such character not ``.``,
``!`` or ``?``). A null role or text is one space. A null conv_id is a conversation of its own. Roles other than system, user
and assistant go by their initial; an empty role has none and can't be kept unless reroled. An empty table gives no rows.
Columns of other names are ignored.

Texts never meet in a task: faults are found by sorted windows, which spill; a search reads two characters per row; the repaired
text is hashed as a sorted stream. So a very long conversation costs a task memory for its codes alone.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.llm import sql
from lodestar.llm.text import map_arrow
from lodestar.session import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of what is written so far: nothing, system, user, assistant. By state: the role that may follow, and its state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
SPACES = "\x20\x09\x0A\x0B\x0C\x0D"
#: Row codes: the initial (s, u, a or - for any other), in upper case (T for -) if the row is truncated, or x: it must go.
GONE = "x"


def steps(codes: str, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """Edits at a node: letter, cost, next node."""
    i, state = node
    yield "I", INSERT, (i, NEXT[state])
    if i == len(codes):
        return
    yield "D", DELETE, (i + 1, state)
    code = codes[i]
    if code == GONE:
        return
    extra, follow = (TRUNCATED if code.isupper() else 0), NEXT[state]
    if code.lower() == ("", "s", "u", "a")[follow]:
        yield "K", KEEP + extra, (i + 1, follow)
    else:
        yield "R", REROLE + extra, (i + 1, follow)
    if code.lower() == "s" and state == START:
        yield "K", KEEP + extra, (i + 1, SYSTEM)


def steps_back(codes: str, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """The same edges by the node they lead to: letter, cost, node they come from."""
    i, state = node
    for before in range(4):
        for k in (i, i - 1):
            if k >= 0:
                for letter, cost, reached in steps(codes, (k, before)):
                    if reached == node:
                        yield letter, cost, (k, before)


class _Trail:
    """An audit from the start to a node, shared with the trails it extends."""

    __slots__ = ("before", "letter", "length")

    def __init__(self, before: _Trail | None, letter: str):
        self.before, self.letter, self.length = before, letter, before.length + 1 if before else 0

    def letters(self) -> str:
        out, at = [], self
        while at.before is not None:
            out.append(at.letter)
            at = at.before
        return "".join(reversed(out))

    def below(self, other: _Trail) -> bool:
        """Comes first; the two lead to one node at one cost, so neither begins with the other."""
        a, b, least = self, other, False
        while a is not b:
            if a.length > b.length:
                a = a.before
            elif b.length > a.length:
                b = b.before
            else:
                if a.letter != b.letter:
                    least = a.letter < b.letter
                a, b = a.before, b.before
        return least


def search(codes: str) -> tuple[int, str]:
    """Cost and least audit of the cheapest repairs of rows with these codes."""
    n = len(codes)
    start, ends = (0, START), [(n, START), (n, ASSISTANT)]
    cost = {start: 0}, dict.fromkeys(ends, 0)
    done: tuple[set, set] = set(), set()
    trail = {start: _Trail(None, "")}                                        # least audit from the start to a node
    onward: dict[tuple[int, int], tuple[str, tuple[int, int]]] = {}          # least first letter from a node to an end
    # free edges only consume rows: by (cost, rows consumed) a node is settled after all that lead to it at its cost
    heaps = [(0, 0, start)], [(0, 0, e) for e in ends]
    best = None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break                                                            # every repair of cost ``best`` crosses between settled nodes
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        spent, _, node = heapq.heappop(heaps[side])
        if node in done[side]:
            continue
        done[side].add(node)
        if node in cost[1 - side]:
            best = min(spent + cost[1 - side][node], best if best is not None else spent + cost[1 - side][node])
        for letter, price, other in (steps_back if side else steps)(codes, node):
            total = spent + price
            known = cost[side].get(other)
            if known is not None and known < total:
                continue
            fresh = known is None or total < known
            cost[side][other] = total
            if side:
                if fresh or letter < onward[other][0]:
                    onward[other] = (letter, node)
            else:
                path = _Trail(trail[node], letter)
                if fresh or path.below(trail[other]):
                    trail[other] = path
            if fresh:
                heapq.heappush(heaps[side], (total, n - other[0] if side else other[0], other))
    # crossings: the last node that the forward search has settled, and the next, settled in reverse
    audits = [trail[e].letters() for e in ends if e in done[0] and cost[0][e] == best]
    for node in done[0]:
        for letter, price, other in steps(codes, node):
            if other not in done[0] and other in done[1] and cost[0][node] + price + cost[1][other] == best:
                rest = []
                while other not in ends:
                    rest.append(onward[other][0])
                    other = onward[other][1]
                audits.append(trail[node].letters() + letter + "".join(rest))
    return best, min(audits)


_frequent = lru_cache(1 << 14)(search)


def cheapest(codes: str) -> tuple[int, str]:
    """``search``, remembered for short conversations: most of them look alike."""
    return _frequent(codes) if len(codes) <= 32 else search(codes)


def written(codes: str, audit: str) -> tuple[list[int], list[str]]:
    """The repaired turns: number of the row each comes from (0: inserted) and its role (empty: the row's own)."""
    rows, roles, i, state = [], [], 0, START
    for letter in audit:
        if letter != "I":
            i += 1
        if letter == "D":
            continue
        state = SYSTEM if letter == "K" and state == START and codes[i - 1].lower() == "s" else NEXT[state]
        rows.append(0 if letter == "I" else i)
        roles.append("" if letter == "K" else ROLE[state])
    return rows, roles


def faulty(rows: DataFrame, order: list[Column] | None = None, conv: str = "conv_id") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with ``seq`` (from 1), ``fault`` (blank, duplicate, truncated or null) and
    ``illegal``: the row's initial must not follow that of the row before. ``order`` tells rows of one turn apart."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    extra = order or []
    base = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"),
                       *[o.alias(f"_o{k}") for k, o in enumerate(extra)])
    w = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), *([f"_o{k}" for k in range(len(extra))] or ["role", "text"]))
    initial = F.substring("role", 1, 1)
    base = base.withColumn("seq", F.row_number().over(w)).withColumn("_last", F.lag(initial).over(w))
    base = base.withColumn("_copy", F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy("seq")))
    solid = F.rtrim("text", F.lit(SPACES))
    fault = F.when(F.length(solid) == 0, "blank").when(F.col("_copy") > 1, "duplicate").when(~solid.rlike(r"[.!?]\z"), "truncated")
    return base.select("conv_id", "turn", "role", "text", "seq", fault.alias("fault"),
                       (F.col("_last").isNotNull() & ~F.concat("_last", initial).isin("su", "ua", "au")).alias("illegal"))


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``faulty`` rows: counts, ``cost``, ``audit`` and the repaired ``turns`` as struct(seq, role)."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("-")
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.translate(initial, "sua-", "SUAT")).otherwise(initial)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct(F.col("turn"))
    spans = rows.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
    by = rows.groupBy("conv_id").agg(
        *[count(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")], count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", code.alias("c")))), lambda x: x["c"]), "").alias("codes"))
    by = by.join(spans.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index("codes")).to_pylist()
            found = [cheapest(c) for c in codes]
            turns = [written(c, a) for c, (_, a) in zip(codes, found, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(r) for r, _ in turns])]).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array([x for r, _ in turns for x in r], pa.int32()), pa.array([x for _, r in turns for x in r], pa.string())], ["seq", "role"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string()),
                                              pa.ListArray.from_arrays(pa.array(ends), inner)], names=[*batch.schema.names, "cost", "audit", "turns"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_arrow(by, run, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, codes string, gaps long, cost long, audit string, "
                              "turns array<struct<seq:int,role:string>>").drop("codes")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id``, ``place`` (from 0), ``role``, ``text`` and ``edit`` (K, R or I)."""
    lines = plan.select("conv_id", F.posexplode("turns").alias("place", "t")).select("conv_id", "place", F.col("t.seq").alias("_seq"), F.col("t.role").alias("_role"))
    own = rows.select(F.col("conv_id").alias("_c"), F.col("seq").alias("_s"), F.col("role").alias("_was"), "text")
    both = lines.join(own, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_seq") == F.col("_s")), "left")
    edit = F.when(F.col("_seq") == 0, "I").when(F.col("_role") == "", "K").otherwise("R")
    return both.select("conv_id", "place", F.when(F.col("_role") == "", F.col("_was")).otherwise(F.col("_role")).alias("role"),
                       F.when(F.col("_seq") == 0, F.lit("")).otherwise(F.col("text")).alias("text"), edit.alias("edit"))


def digests(turns: DataFrame) -> DataFrame:
    """``repaired_sha256`` of each conversation's ``role:text`` lines, from a stream sorted by conversation and place."""
    lines = turns.select("conv_id", "place", F.concat(F.when(F.col("place") > 0, "\n").otherwise(""), "role", F.lit(":"), "text").alias("line"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, keys = None, None, None
        for batch in batches:
            keys = batch.schema.field("conv_id").type
            done = []
            for k, place, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if place == 0:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(line.encode("utf-8", "replace"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], keys), pa.array([s for _, s in done])], names=["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], keys), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return map_arrow(lines.repartition("conv_id").sortWithinPartitions("conv_id", "place"), run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the row, 1 empties
    its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user. ``_role`` and ``_text`` are as before."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    out = rows.select("conv_id", "turn", space("role").alias("_role"), space("text").alias("_text"), kind.alias("_kind")).where(F.col("_kind") != 0)
    out = out.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("role"), text.alias("text"), "_role", "_text",
                     F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
    return out.drop("_copy")


def op13(spark, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    broken = damaged(source)
    rows = stored(faulty(broken, [F.col("_role"), F.col("_text")]))
    plan = stored(plans(rows))
    hashes = digests(repaired(rows, plan)).withColumnRenamed("conv_id", "_h")
    out = source.select("conv_id").distinct()
    out = out.join(plan.drop("turns").withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_NEXT = "CASE s WHEN 'u' THEN 'a' ELSE 'u' END"
_NAME = "CASE s WHEN 'u' THEN 'assistant' ELSE 'user' END"
#: A dynamic program: cheapest repair and its least audit by rows consumed and state, with up to two insertions after each row.
ORACLE = f"""
WITH RECURSIVE {sql.BITS},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, {sql.crc32('key')} % 20 AS kind FROM src, bits),
dam AS (SELECT conv_id, turn, role0, text0, CASE WHEN kind = 4 THEN 'user' ELSE role0 END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text,
               unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM kinds WHERE kind <> 0),
seqs AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, copy) AS seq,
                rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM dam),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seq) AS again,
                  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY seq) AS before FROM seqs),
flt AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id),
best AS (
  SELECT conv_id, 0::BIGINT AS i, s, (c, a, l) AS w FROM sums, (VALUES ('', 0::BIGINT, '', []::VARCHAR[]), ('u', 2, 'I', ['user:']), ('a', 4, 'II', ['user:', 'assistant:'])) v(s, c, a, l)
  UNION ALL
  SELECT conv_id, i, s, min(w) AS w FROM (
    WITH edge AS (
      SELECT b.conv_id, b.i + 1 AS i, b.w, b.s, e.letter, f.role, f.text,
             CASE letter WHEN 'D' THEN s WHEN 'R' THEN {_NEXT} ELSE left(f.role, 1) END AS t,
             CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS price
      FROM best b JOIN flt f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.seq = b.i + 1, (VALUES ('D'), ('K'), ('R')) e(letter)
      WHERE letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR left(f.role, 1) = {_NEXT} OR (s = '' AND left(f.role, 1) = 's')))),
    done AS (SELECT conv_id, i, t AS s, w[1] + price AS c, w[2] || letter AS a,
                    w[3] || CASE letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [{_NAME} || ':' || text] END AS l FROM edge),
    one AS (SELECT conv_id, i, {_NEXT} AS s, c + 2 AS c, a || 'I' AS a, l || [{_NAME} || ':'] AS l FROM done),
    two AS (SELECT conv_id, i, {_NEXT} AS s, c + 2 AS c, a || 'I' AS a, l || [{_NAME} || ':'] AS l FROM one)
    SELECT conv_id, i, s, (c, a, l) AS w FROM (FROM done UNION ALL FROM one UNION ALL FROM two)
  ) GROUP BY conv_id, i, s),
won AS (SELECT b.conv_id, min(b.w) AS w FROM best b JOIN sums s ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND b.i = s.n WHERE b.s IN ('', 'a') GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(w[1], 0)::BIGINT AS cost, coalesce(w[2], '') AS audit, sha256(coalesce(array_to_string(w[3], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON o.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM o.conv_id
"""

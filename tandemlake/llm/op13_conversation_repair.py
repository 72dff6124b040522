"""Conversation structure repair: the cheapest edits that leave `(system? (user assistant)+)?`.

A dynamic programme over retained turns (kept, or given another role) finds the edits. From the last turn to the first,
the deletion sum of what lies between two retained turns and, for each role, a running minimum over the later turn
price every gap at once; the two roles tell how many turns must be inserted in between. Of equally cheap audits the least
in ASCII order is read off forwards: at each place the least letter that still leads to the least cost.

Faults are found in SQL expressions: rows of equal (conversation, turn, role, text) are one run with a count, the first run of a
(role, text) is no duplicate. Runs without texts go before the texts of their conversation in one sorted stream, so
a task keeps some forty bytes for each turn of the conversation at hand, and its texts pass by one at a time.
A conversation's repaired text and its hash are a sequence, so one task makes them, at any number of turns, in that
memory.

Order and defined results: turns come by `turn`, null first; equal turns by role and then by the MD5 of their text; a null role
or text is one space; a null conv_id is a conversation; repeated rows are duplicates; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemlake.llm.common import small_batches, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Roles by number; 0 is the place before any turn, as a role any that none of the three begins like.
ROLES = ("", "system", "user", "assistant")
SYSTEM, USER, ASSISTANT = 1, 2, 3
#: The role that must follow each, and the inserts that a gap between two retained roles takes: none where it is missing.
NEXT = (USER, USER, ASSISTANT, USER)
INSERTS = {
    (0, SYSTEM): 0, (0, USER): 0, (0, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1,
    (USER, ASSISTANT): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1,
}
AT_END = (0, 2, 1, 0)
#: Codes of a turn: its role, and flags.
ROLE_BITS, BLANK, DUPLICATE, CUT = 3, 4, 8, 16
NEVER = 1 << 60
#: The price of a turn that stands with each role, by its code; and what may follow each role with the cost of its inserts.
RETAINED = [
    [NEVER if c & (BLANK | DUPLICATE) else min(KEEP if c & ROLE_BITS == q else NEVER, REROLE if q != SYSTEM else NEVER) + (TRUNCATED if c & CUT else 0) for q in range(4)]
    for c in range(32)
]
WAYS = [[(q, INSERT * k) for (p, q), k in INSERTS.items() if p == own] for own in range(4)]

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) for turns of these codes."""
    n = len(codes)
    left = array("q", bytes(32 * (n + 1)))  # least cost of all turns from a place on, by the last retained role before it
    least = [NEVER] * 4  # by role: deletions up to a retained turn, its price and all that follows
    for i in range(n, -1, -1):
        if i < n:
            price = RETAINED[codes[i]]
            for q in (SYSTEM, USER, ASSISTANT):
                least[q] = min(least[q], DELETE * i + price[q] + left[4 * (i + 1) + q])
        for p in range(4):
            found = DELETE * n + INSERT * AT_END[p]
            for q, inserts in WAYS[p]:
                found = min(found, least[q] + inserts)
            left[4 * i + p] = found - DELETE * i
    i, role, audit = 0, 0, bytearray()
    while True:
        rest = left[4 * i + role]
        if i < n and DELETE + left[4 * (i + 1) + role] == rest:
            audit += b"D"
            i += 1
        elif INSERT + left[4 * i + NEXT[role]] == rest:
            audit += b"I"
            role = NEXT[role]
        elif i == n:
            break
        else:
            own = codes[i] & ROLE_BITS
            extra = TRUNCATED if codes[i] & CUT else 0
            keeps = own and (role, own) in INSERTS and not INSERTS[role, own] and KEEP + extra + left[4 * (i + 1) + own] == rest
            audit += b"K" if keeps else b"R"
            role = own if keeps else NEXT[role]
            i += 1
    return left[0], audit.decode()


@dataclass
class Conversation:
    """One conversation as its runs and then its texts pass by."""

    conv_id: int | None
    codes: bytearray = field(default_factory=bytearray)
    firsts: array = field(default_factory=lambda: array("q"))  # of runs that have a text: the number of their first turn
    turns: list = field(default_factory=lambda: [None, None, 0])  # least, largest, distinct
    counts: list = field(default_factory=lambda: [0, 0, 0, 0])  # blank, duplicate, truncated, illegal
    audit: str | None = None

    def add(self, turn: int | None, code: int, n: int) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        role, again = code & ROLE_BITS, code if code & BLANK else code | DUPLICATE
        before = self.codes[-1] & ROLE_BITS if self.codes else None
        legal = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        self.counts[3] += (before is not None and (before, role) not in legal) + n - 1
        if not code & BLANK:
            self.firsts.append(len(self.codes))
        self.codes.append(code)
        self.codes += bytes([again]) * (n - 1)
        for c, k in ((code, 1), (again, n - 1)):
            fault = 0 if c & BLANK else 1 if c & DUPLICATE else 2 if c & CUT else None
            if fault is not None:
                self.counts[fault] += k

    def settle(self) -> None:
        self.cost, self.audit = cheapest(bytes(self.codes))
        self.at = self.turn = self.run = self.role = self.place = 0
        self.hash = hashlib.sha256()

    def put(self, edit: str, role: str, text: str) -> tuple:
        self.hash.update(f"{'' if not self.place else chr(10)}{role}:{text}".encode())
        self.place += 1
        return self.conv_id, self.place - 1, edit, role, text

    def step(self) -> tuple[str, int]:
        """The next edit, and the role of what it leaves."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.role = self.codes[self.turn] & ROLE_BITS
        elif edit != "D":
            self.role = NEXT[self.role]
        self.turn += edit != "I"
        return edit, self.role

    def text(self, role: str, text: str) -> Iterator[tuple]:
        """What stands up to the turn that is the first of the next run with a text."""
        goal = self.firsts[self.run]
        self.run += 1
        while self.turn <= goal:
            edit, now = self.step()
            if edit == "I":
                yield self.put(edit, ROLES[now], "")
            elif edit != "D":
                yield self.put(edit, role if edit == "K" else ROLES[now], text)

    def rest(self) -> Iterator[tuple]:
        while self.at < len(self.audit):
            edit, now = self.step()
            if edit == "I":
                yield self.put(edit, ROLES[now], "")

    def summary(self) -> tuple:
        gaps = 0 if self.turns[0] is None else self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return self.conv_id, gaps, *self.counts, self.cost, self.audit, self.hash.hexdigest()


def _streamed(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation follow each other: its runs (n is not null), then the texts of runs that have one."""
    names = [x.split()[0] for x in (TURNS if turns else SUMMARY).split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in (TURNS if turns else SUMMARY).split(", ")]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    one: Conversation | None = None
    last: tuple | None = None

    def ended() -> Iterator[tuple]:
        if one is not None:
            if one.audit is None:
                one.settle()
            found = list(one.rest())
            yield from found if turns else [one.summary()]

    for batch in batches:
        out: list[tuple] = []
        for conv_id, turn, role, digest, n, code, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "n", "code", "text")), strict=True):
            if one is None or conv_id != one.conv_id:
                out += ended()
                one, last = Conversation(conv_id), None
            if n is not None:
                one.add(turn, code, n)
                continue
            if one.audit is None:
                one.settle()
            if (turn, role, digest) != last:  # repeats of a turn are deleted
                last = (turn, role, digest)
                found = list(one.text(role, text))
                out += found if turns else []
        if out:
            yield packed(out)
    if out := list(ended()):
        yield packed(out)


def _stream(rows: DataFrame) -> DataFrame:
    """Runs and texts of rows, sorted by conversation; see _streamed."""
    blank = lambda c: F.coalesce(c, F.lit(" "))
    text, role = blank("text"), blank("role")
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))
    first = F.substring("role", 1, 1)
    by_role = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)
    wordy = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    code = by_role + F.when(~wordy, BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0)
    runs = own.select("conv_id", "turn", "role", "digest", code.alias("code")).groupBy("conv_id", "turn", "role", "digest", "code").agg(F.count(F.lit(1)).alias("n"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    runs = runs.withColumn("code", F.when(again & (F.col("code").bitwiseAND(BLANK) == 0), F.col("code").bitwiseOR(DUPLICATE)).otherwise(F.col("code")))
    stream = runs.unionByName(own.filter(wordy), allowMissingColumns=True)
    order = ["conv_id", F.col("n").isNull(), F.col("turn").asc_nulls_first(), "role", "digest"]
    return small_batches(stream).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "digest", "n", "code", "text")


def repair_summary(rows: DataFrame) -> DataFrame:
    """SUMMARY of each conversation: counts of its faults, the least cost, the audit and a hash of the repaired turns."""
    return _stream(rows).mapInArrow(lambda x: _streamed(x, False), SUMMARY)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """TURNS: the turns that stand after repair, numbered from 0 in each conversation, with the edit that left each."""
    return _stream(rows).mapInArrow(lambda x: _streamed(x, True), TURNS)


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults planted by crc32 of `conv_id:turn`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text: Column = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role: Column = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair_summary(damaged(rows)).withColumnRenamed("conv_id", "own")
    every = rows.select("conv_id").distinct()
    met = every.join(found, every["conv_id"].eqNullSafe(found["own"]), "left").drop("own")
    return met.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


def _sql() -> str:
    """The same by other means: a row at a time from the first, with the best (cost, audit) by role as one sortable text."""
    cost = lambda k: f"lpad(cast(cast(left({k}, 9) as bigint) + {{}} as varchar), 9, '0') || substr({k}, 10) || '{{}}'"
    step = lambda k, more, letter: cost(k).format(more, letter)
    least = lambda xs: f"list_min([{', '.join(xs)}])"
    stay = lambda k: step(k, DELETE, "D")
    ok, extra = "not must", f"case when cut then {TRUNCATED} else 0 end"
    kept = lambda k, r: f"case when {ok} and r = '{r}' then {step(k, extra, 'K')} end"
    rerole = lambda k: f"case when {ok} then {step(k, f'{REROLE} + {extra}', 'R')} end"
    # inserts before the row: a role that must follow, from the best of the states so far
    return rf"""
with recursive bytes as (select i, i::bigint c from range(256) t(i)),
crc_table as materialized (select list(list_reduce(list_prepend(c, range(8)::bigint[]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) t from bytes),
k as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 as kind
  from conversations, crc_table),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) copy from k where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) again, not regexp_matches(text, '[^\x20\x09-\x0D]') blank from d),
f as materialized (select *, left(role, 1) r, not blank and again > 1 dup, not blank and again = 1 and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') cut, blank or again > 1 must, coalesce(lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) not in ('su', 'ua', 'au'), false) odd from o),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (dup) duplicate, count(*) filter (cut) truncated, count(*) filter (odd) illegal, max(i) n from f group by 1),
walk(conv_id, i, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, '000000000', null::varchar, '000000003I', '000000006II' from g
  union all
  select w.conv_id, w.i + 1, x0, x1, {least(['x2', step('x0', INSERT, 'I'), step('x1', INSERT, 'I'), step('x3', INSERT, 'I')])},
    {least(['x3', step('x2', INSERT, 'I'), step('x0', 2 * INSERT, 'II'), step('x1', 2 * INSERT, 'II')])}
  from (select w.conv_id, w.i, {stay('s0')} x0, {least([stay('s1'), kept('s0', 's')])} x1,
      {least([stay('s2'), *(kept(s, 'u') for s in ('s0', 's1', 's3')), *(rerole(s) for s in ('s0', 's1', 's3'))])} x2, {least([stay('s3'), kept('s2', 'a'), rerole('s2')])} x3
    from walk w join f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1) w),
best as materialized (select conv_id, least_end, left(least_end, 9)::bigint as cost, substr(least_end, 10) audit from (select w.conv_id, list_min([s0, s3]) least_end from walk w join g on w.conv_id is not distinct from g.conv_id and w.i = g.n)),
l as (select conv_id, audit, unnest(range(1, length(audit) + 1)) pos from best),
e as (select conv_id, pos, audit[pos] edit, length(regexp_replace(left(audit, pos), 'I', '', 'g')) i, case when length(regexp_replace(left(audit, pos), 'D', '', 'g')) % 2 = 1 then 1 else 0 end odd from l),
first_kept as (select e.conv_id, arg_min(case when edit = 'K' and r = 's' then 1 else 0 end, pos) system from e left join f on e.conv_id is not distinct from f.conv_id and e.i = f.i where edit <> 'D' group by 1),
t as (select e.conv_id, string_agg(case when edit = 'K' then role when xor(e.odd, system) = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by pos) t
  from e join first_kept s on e.conv_id is not distinct from s.conv_id left join f on e.conv_id is not distinct from f.conv_id and e.i = f.i where edit <> 'D' group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') audit, sha256(coalesce(t, '')) repaired_sha256
from (select distinct conv_id from conversations) c left join g on c.conv_id is not distinct from g.conv_id left join best b on c.conv_id is not distinct from b.conv_id left join t on c.conv_id is not distinct from t.conv_id
"""


SQL = _sql()

"""Runs, line dedup and conversation repair against brute-force versions, with nulls, empty and long texts, ties, repeated
rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pytest

from tandemlake.llm import op7_sharding as op7
from tandemlake.llm import op11_periodic_runs as op11
from tandemlake.llm import op12_line_dedup as op12
from tandemlake.llm import op13_conversation_repair as op13
from tandemlake.llm.common import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
rows_of = lambda df: Counter(map(tuple, df.collect()))


# Runs ----------------------------------------------------------------------------------------------------------------

def brute_runs(w: list, least: int = 12) -> list[tuple]:
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.append((s, i - s + q, q))
            i += i == s
    return sorted((s, n, q) for s, n, q in found if not any(p < q and q % p == 0 and a <= s and a + m >= s + n for a, m, p in found))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 6)):
            n, k = r.randint(0, 60), r.choice([1, 2, 2, 3, 5, 50])
            w = [r.randrange(k) for _ in range(n)]
            if n > 4 and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // (3 + r.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        found = op11.runs_of(np.array(sum(texts, []), np.int64), np.array([len(x) for x in texts]), least)
        assert [tuple(x) for x in found.tolist()] == [(k, *x) for k, w in enumerate(texts) for x in brute_runs(w, least)]


def test_long_runs():
    assert op11.runs_of(np.zeros(200_000, np.int64), np.array([200_000])).tolist() == [[0, 0, 200_000, 1]]
    fibonacci, before = [0], [0, 1]
    while len(before) < 3000:
        fibonacci, before = before, before + fibonacci
    assert [tuple(x[1:]) for x in op11.runs_of(np.array(before[:1200]), np.array([1200])).tolist()] == brute_runs(before[:1200])


def brute_collapsed(doc_id: int | None, text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(runs), *shown, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def documents(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: r.choice("the Of and to in THE é 日本 x ...".split())
    line = lambda: r.choice(["", " ", "\t"]) + " ".join(word() for _ in range(r.randint(0, 6))) + r.choice(["", " ", "\r"])
    rows = [(k, "\n".join(line() for _ in range(r.randint(1, 12)))) for k in range(60)]
    common = ["Shared  line\n", "  shared  LINE \r\n", "\x0bshared  line\n"]
    rows += [(100 + k, f"own {k}\n{common[k % 3]}tail {k // 2}\n\nİ line\nown {k}") for k in range(12)]
    rows += [(200 + k, "nine only\nelse") for k in range(9)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "\n\n"), (None, "a b " * 20), (None, None), (304, "a b c " * 5000), (305, "\n".join(f"l{k % 700}" for k in range(5000)))]
    return rows + [(306, "twice the same\nrow")] * 12 + [(306, "twice the same\nbut not this"), (0, "x " * 30), (307, "\x00 a\n" * 15)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("structure")
    rows = [(*x, "clash", 7) for x in documents()]
    spark.createDataFrame(rows, "doc_id long, text string, lines string, n_lines int").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_periodic_runs_equal_brute_force(spark, folder):
    assert rows_of(op11.op11_periodic_runs(spark, folder)) == Counter(brute_collapsed(*x) for x in documents())


def test_collapsed_passes_columns_through(spark):
    docs = spark.createDataFrame([(1, "a b " * 7, "mine", 5)], "n_words int, body string, runs string, text int")
    assert [tuple(x) for x in op11.collapsed(docs, "body").collect()] == [("a b " * 7, 5, 14, [(0, 14, 2)], "a b")]
    assert op11.collapsed(docs.limit(0), "body").collect() == []


# Lines ---------------------------------------------------------------------------------------------------------------

def key(line: str) -> str:
    return line.strip(WHITE).translate(LOWER)


def brute_lines(rows: list[tuple], least_docs: int = 10, least_chars: int = 1) -> Counter:
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least_chars)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least_docs]
        out[i, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
    return out


def test_line_dedup_equals_brute_force(spark, folder):
    found = rows_of(op12.op12_line_dedup(spark, folder))
    assert found == brute_lines(documents())
    assert sum(x[2] * n for x, n in found.items()) > 40


def test_line_dedup_of_other_limits_with_many_shards(spark, folder, monkeypatch):
    monkeypatch.setattr(op12, "SHARD_KEYS", 16)
    monkeypatch.setattr(op12, "SHARD_VISITORS", 20)
    monkeypatch.setattr(op12, "fair_share", lambda n: 10)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = op12.without_shared_lines(docs, least_docs=3, least_chars=4)
    assert found.columns == ["doc_id", "text", "lines", "n_lines", "n_dropped", "kept"]
    rows = found.collect()
    assert {x.lines for x in rows} == {"clash"}
    assert Counter((x.doc_id, x.n_lines, x.n_dropped, sha(x.kept)) for x in rows) == brute_lines(documents(), 3, 4)
    assert op12.without_shared_lines(docs.limit(0)).collect() == []


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        a[: n // 2] = a[n // 2 : n // 2 * 2]  # halves of digests may agree
        counts = r.integers(1, 70_000, n)
        index = op12.LineIndex.unpacked(op12.LineIndex.of(a, b, counts).packed())
        assert sorted(index.hashed.places(a, b).tolist()) == list(range(n))
        assert index.lookup(a, b).tolist() == counts.tolist()
        assert not index.lookup(r.integers(0, 1 << 63, 500, dtype=np.uint64), r.integers(0, 1 << 63, 500, dtype=np.uint64)).any()


# Conversations -------------------------------------------------------------------------------------------------------

def brute_repair(codes: list[tuple]) -> tuple[int, str, tuple]:
    """Least (cost, audit) by search; codes: (role, must be deleted, truncated)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, role, left = heappop(heap)
        if i == len(codes) and role in ("", "a"):
            return cost, audit, left
        if (i, role) in done:
            continue
        done.add((i, role))
        for new in set(after[role]) - {"s"}:
            heappush(heap, (cost + 3, audit + "I", i, new, (*left, (None, new))))
        if i < len(codes):
            own, must, cut = codes[i]
            heappush(heap, (cost + 4, audit + "D", i + 1, role, left))
            if not must:
                if own in after[role] and own:
                    heappush(heap, (cost + 3 * cut, audit + "K", i + 1, own, (*left, (i, own))))
                for new in set(after[role]) - {"s"}:
                    heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, new, (*left, (i, new))))
    raise AssertionError


def test_cheapest_edits_equal_search():
    r = random.Random(9)
    number = {"": 0, "s": 1, "u": 2, "a": 3, "x": 0}
    for _ in range(600):
        rows = [(r.choice("suuuaaax"), r.random() < 0.15, r.random() < 0.25) for _ in range(r.randint(0, 9))]
        codes = bytes(number[a] + (op13.DUPLICATE if m else 0) + (op13.CUT if c and not m else 0) for a, m, c in rows)
        assert op13.cheapest(codes) == brute_repair([(a, m, c and not m) for a, m, c in rows])[:2]


def test_long_conversation():
    cost, audit = op13.cheapest(bytes([2, 3]) * 100_000 + bytes([2]) + bytes([2 + op13.DUPLICATE]) * 50_000)
    assert (cost, len(audit)) == (200_003, 250_002)
    assert audit == "K" * 200_001 + "D" * 50_000 + "I"


def conversations(seed: int = 4) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in range(150):
        roles = r.choice([["system", "user", "assistant"] * 2, ["user", "assistant"] * 4, ["assistant", "user"], ["user"] * 3, ["tool", "user", "assistant", ""]])
        for t, role in enumerate(roles):
            rows.append((c, t * r.choice([1, 1, 2]), role, r.choice(["Good.", "So it is?", "cut off", " \t", "", "Yes! ", "dots . . .", "ends\n"]) + r.choice(["", str(t) + "."])))
    rows += [(900, None, "user", "a."), (900, None, None, None), (901, None, None, "x."), (None, 1, "user", "q."), (None, 2, "assistant", "z."), (None, None, "system", "s!"), (902, 5, "user", "é.\x00!")]
    rows += [(903, 7, "user", "again.")] * 5 + [(904, 1, "user", "b."), (904, 1, "user", "a."), (904, 1, "assistant", "c.")]
    return rows + [(905, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(3000)]


def brute_conversations(rows: list[tuple]) -> Counter:
    damaged: dict = {}
    for c, t, role, text in rows:
        own = damaged.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out: Counter = Counter()
    for c, own in damaged.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        counts, seen, codes = Counter(), set(), []
        for _, role, text in own:
            end = text.rstrip(WHITE)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in pairwise(codes))
        cost, audit, left = brute_repair(codes)
        full = {"s": "system", "u": "user", "a": "assistant"}
        kept = iter([k for k in audit if k != "D"])
        shown = [(full[new] if k != "K" else own[i][1]) + ":" + ("" if i is None else own[i][2]) for (i, new), k in zip(left, kept, strict=True)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(shown))] += 1
    return out


def test_repair_equals_brute_force(spark, tmp_path):
    rows = conversations()
    schema = "conv_id long, turn long, role string, text string, audit string, n int"
    spark.createDataFrame([(*x, "clash", 1) for x in rows], schema).repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(op13.op13_conversation_repair(spark, str(tmp_path))) == brute_conversations(rows)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert op13.op13_conversation_repair(spark, f"{tmp_path}/empty").collect() == []


def test_repaired_turns_are_legal(spark):
    rows = spark.createDataFrame(conversations(8), "conv_id long, turn long, role string, text string")
    by: dict = {}
    for x in op13.repaired_turns(rows).collect():
        by.setdefault(x.conv_id, []).append(x)
    digest = {x.conv_id: x.repaired_sha256 for x in op13.repair_summary(rows).collect()}
    for c, turns in by.items():
        turns.sort(key=lambda x: x.place)
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in turns))
        assert sha("\n".join(f"{x.role}:{x.text}" for x in turns)) == digest[c]


# Shards --------------------------------------------------------------------------------------------------------------

def test_slots_depend_on_nothing_but_the_row(spark, folder, monkeypatch):
    """Adding other rows, hundreds of copies of one among them, or parting the table otherwise moves no row."""
    monkeypatch.setattr(op7, "COPIES", 100)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    before = rows_of(op7.records(docs))
    assert rows_of(op7.records(docs.repartition(11, "text"))) == before and sum(before.values()) == docs.count()
    more = docs.unionByName(spark.createDataFrame([(77, "one row of many copies")] * 700 + [(5000 + k, "new") for k in range(50)], "doc_id long, text string"))
    after = rows_of(op7.records(more))
    assert before <= after and sum(after.values()) == docs.count() + 750
    copies = Counter(slot for (i, _, _, slot), n in after.items() for _ in range(n) if i == 77)
    assert len(copies) > 600  # spread over the slots


def test_maps_of_the_operators_own_rows(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, "x" * r.randint(1, 400)) for k in range(3000)] + [(3000, "a repeated row")] * 500
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(x["version"], x["shard"]): x for x in op7.slot_map_history(spark, str(tmp_path)).collect()}
    total = {v: sum(x["rows"] for (w, _), x in found.items() if w == v) for v in (1, 2, 3)}
    assert total == {1: 3500, 2: 3500, 3: 3500 + 1500 + 500}
    sizes = {v: [x["bytes"] for (w, _), x in found.items() if w == v] for v in (1, 2, 3)}
    assert len(sizes[1]) == 16 and len(sizes[2]) == len(sizes[3]) == 17
    assert max(sizes[1]) - min(sizes[1]) <= 2 * 401 * 4
    assert all(x["moved"] == (x["rows"] if shard == 16 else 0) for (v, shard), x in found.items() if v == 2)  # only into the new shard
    assert all(x["moved"] == 0 for (v, _), x in found.items() if v == 1)
    assert max(sizes[3]) < 1.03 * sum(sizes[3]) / 17 and 0 < sum(x["moved"] for (v, _), x in found.items() if v == 3) < 0.35 * total[3]


def test_small_links_take_few_tasks(spark):
    """Each task of each round leaves files: rounds over a few links must not have as many tasks as shuffles may have."""
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {x: spark.conf.get(x) for x in names}
    try:
        for x, value in names.items():
            spark.conf.set(x, value)
        found = components(spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(40)], "u string, v string"))
        assert found.rdd.getNumPartitions() <= 4
        assert {tuple(x) for x in found.collect()} == {(f"{k:03}", "000") for k in range(41)}
    finally:
        for x, value in before.items():
            spark.conf.set(x, value)

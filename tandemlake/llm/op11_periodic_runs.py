"""Periodic runs: stretches of words that repeat with a period, and texts without the repeats.

By the runs theorem, every run has a root that is the longest Lyndon word at its place under the order of words or under the
reverse order. Such a word reaches to the next suffix that is smaller (in the reverse order: larger), so next-smaller values of the
inverse suffix array, and of its negative, give all roots. A root is extended to the right by the longest common
prefix of two suffixes and to the left by that of the reversed text: range minima over the LCP array, from a sparse table.
What is then long enough is a run; no other places are tried.

Texts are handled in slices of about a megabyte, all of a slice at once: words are numbered for each text apart, so that one
suffix array by prefix doubling (only suffixes that are still tied are sorted again) holds those of all its texts. A
run of `least` words or more holds two equal stretches of half as many, so texts without such stretches have
none and are left out first. A text is one task's work, in some hundred bytes a word.

Defined results: words are told apart by their bytes; a null or empty text has no words, no runs and collapses to the empty text;
equal rows get equal results; a null doc_id is damaged by no rule; an empty table gives an empty result; other
columns pass through unless they bear the names of the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tandemlake.llm.common import SPACED_WORD, find_words, numbered, pieces_of, small_batches, table, text_slices

#: Words of the shortest run; a run also has two periods at least.
LEAST = 12
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


class Suffixes:
    """Suffix order of texts in one array, and common prefixes of their suffixes. `ends` holds for each place where its text
    ends; equal words of different texts must have different numbers, ascending by text."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        n = len(words)
        self.ends = ends
        order = np.argsort(words, kind="stable")
        levels = [self._ranked(words[order], order, np.zeros(n, np.int64))]
        tied, step = self._tied(levels[0]), 1
        while len(tied):
            rank = levels[-1].copy()
            beyond = tied + step
            follows = np.where(beyond < ends[tied], rank[np.minimum(beyond, n - 1)] + 1, 0).astype(np.int64)
            keys = rank[tied].astype(np.int64) * (n + 1) + follows
            by = np.argsort(keys, kind="stable")
            own = tied[by]
            rank[own] = self._ranked(keys[by], np.arange(len(own)), rank[own].astype(np.int64), rank[own])
            levels.append(rank)
            tied, step = tied[self._tied_of(rank, tied)], step * 2
        self.rank = levels[-1]
        self.order = np.empty(n, np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)
        self.minima = _sparse(self._neighbours(levels), np.minimum)

    @staticmethod
    def _ranked(keys: np.ndarray, at: np.ndarray, base: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
        """For sorted keys: base + the number of keys before, in the same group, that are smaller."""
        n = len(keys)
        places = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.maximum.accumulate(np.where(new, places, 0))
        if groups is not None:
            opens = np.ones(n, bool)
            opens[1:] = groups[1:] != groups[:-1]
            first = first - np.maximum.accumulate(np.where(opens, places, 0))
        out = np.empty(n, np.int32)
        out[at] = first + base
        return out

    @staticmethod
    def _tied(rank: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)

    @staticmethod
    def _tied_of(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
        return np.bincount(rank[among], minlength=len(rank))[rank[among]] > 1

    def _neighbours(self, levels: list[np.ndarray]) -> np.ndarray:
        """The LCP array: by rank, what a suffix has in common with the one before it. Ranks after k doublings are equal
        where 2^k words are."""
        n = len(self.order)
        common = np.zeros(n, np.int32)
        x, y = self.order[:-1].astype(np.int64), self.order[1:].astype(np.int64)
        open_ = np.flatnonzero(levels[0][x] == levels[0][y])
        x, y = x[open_], y[open_]
        got = np.zeros(len(open_), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(x, y) + got < self.ends[x]  # both are of one text
            i, j = np.minimum(x + got, n - 1), np.minimum(y + got, n - 1)
            got += np.where(inside & (levels[k][i] == levels[k][j]), 1 << k, 0)
        common[open_ + 1] = got
        return common

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words the suffixes at x and at y, of one text and not the same, have in common."""
        a, b = self.rank[x], self.rank[y]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.minima[k, low], self.minima[k, high - (1 << k) + 1])


def _sparse(values: np.ndarray, least: np.ufunc) -> np.ndarray:
    """Row k holds the least of the 2^k values from each place on, as far as there are that many."""
    n = len(values)
    out = np.empty((max(1, n.bit_length()), n), np.int32)
    out[0] = values
    for k in range(1, len(out)):
        half = 1 << (k - 1)
        out[k] = out[k - 1]
        least(out[k - 1][: n - half], out[k - 1][half:], out=out[k][: n - half])
    return out


def next_beyond(rank: np.ndarray, ends: np.ndarray, smaller: bool) -> np.ndarray:
    """For each place the next one of its text whose rank is smaller (or larger), else the end of its text."""
    n = len(rank)
    longest = int((ends - np.arange(n)).max(initial=1))
    tables = _sparse(rank, np.minimum if smaller else np.maximum)
    at = np.arange(1, n + 1)
    for k in range(longest.bit_length() - 1, -1, -1):
        fits = at + (1 << k) <= ends
        block = tables[min(k, len(tables) - 1)][np.minimum(at, n - 1)]
        at = np.where(fits & ((block > rank) if smaller else (block < rank)), at + (1 << k), at)
    return at


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period), in that order, of all runs of `least` words or more. words: numbers of the words of
    several texts, one after another; sizes: how many words each text has."""
    texts = np.repeat(np.arange(len(sizes)), sizes)
    half = max(1, least // 2)
    own = _with_repeats(words, texts, half)[texts] if len(words) else np.zeros(0, bool)
    words, texts = words[own], texts[own]
    if not len(words):
        return np.zeros((0, 4), np.int64)
    n = len(words)
    words = words + texts * (int(words.max()) + 1)
    last = np.ones(n, bool)
    last[:-1] = texts[1:] != texts[:-1]
    stops = np.flatnonzero(last) + 1
    ends = stops[np.searchsorted(stops, np.arange(n), "right")]
    begins = np.concatenate(([0], stops))[np.searchsorted(stops, np.arange(n), "right")]
    ahead = Suffixes(words, ends)
    behind = Suffixes(words[::-1], n - begins[::-1])

    places = np.arange(n)
    x = np.concatenate((places, places))
    y = np.concatenate((next_beyond(ahead.rank, ends, True), next_beyond(ahead.rank, ends, False)))
    # of a run's roots, one at least has its next root in the text; a root that no neighbouring word extends is alone
    x, y = x[y < ends[x]], y[y < ends[x]]
    on = words[x] == words[y]
    back = (x > begins[x]) & (words[x - 1] == words[y - 1])
    x, y, on, back = (v[on | back] for v in (x, y, on, back))
    start, end = x.copy(), y.copy()
    end[on] += ahead.common(x[on], y[on])
    start[back] -= behind.common(n - x[back], n - y[back])
    period, length = y - x, end - start
    long = length >= np.maximum(least, 2 * period)
    found = np.stack([texts[start[long]], start[long] - begins[start[long]], length[long], period[long]], 1)
    found = found[np.lexsort(found.T[[2, 3, 1, 0]])]
    return found[np.append(True, (found[1:] != found[:-1]).any(1))] if len(found) else found


def _with_repeats(words: np.ndarray, texts: np.ndarray, size: int) -> np.ndarray:
    """A flag for each text: it holds a stretch of `size` words twice."""
    out = np.zeros(int(texts[-1]) + 1, bool)
    if len(words) < size:
        return out
    span, stretches = 1, words
    while span < size:
        more = min(span, size - span)
        stretches = pd.factorize(stretches[:-more] * (int(stretches.max()) + 1) + stretches[more:])[0]
        span += more
    own = np.flatnonzero(texts[: len(stretches)] == texts[size - 1 :])
    keys = stretches[own] * len(out) + texts[own]
    twice = pd.Series(keys).duplicated().to_numpy()
    out[texts[own[twice]]] = True
    return out


def _collapsed(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], least: int) -> Iterator[pa.RecordBatch]:
    names = [*keep, "n_words", "runs", "collapsed"]
    for batch in batches:
        for part, data, offsets in text_slices(batch, text):
            starts, stops, first = find_words(data, offsets, SPACED_WORD)
            numbers, distinct = numbered(pieces_of(data, starts, stops))
            found = runs_of(numbers, np.diff(first), least)
            steps = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(steps, first[found[:, 0]] + found[:, 1] + found[:, 3], 1)
            np.add.at(steps, first[found[:, 0]] + found[:, 1] + found[:, 2], -1)
            stays = np.cumsum(steps)[:-1] == 0
            spelled = distinct.to_pylist()
            texts = []
            for k in range(len(first) - 1):
                own = numbers[first[k] : first[k + 1]][stays[first[k] : first[k + 1]]]
                texts.append(b" ".join([spelled[w] for w in own.tolist()]))
            each = np.searchsorted(found[:, 0], np.arange(len(first))).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(found[:, k + 1]) for k in range(3)], ["start", "length", "period"])
            columns = [pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(each), runs), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names)


def collapsed(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with n_words, `runs` (start, length, period; by start, then period) of each whole text, and `collapsed`: its words
    without those that lie in a run beyond the run's first period, joined by one space."""
    keep = [c for c in docs.columns if c.lower() not in {"n_words", "runs", "collapsed"}]
    source = small_batches(docs).select(*keep) if text in keep else small_batches(docs).select(*keep, text)
    fields = [*(source.schema[c] for c in keep), StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
    return source.mapInArrow(lambda x: _collapsed(x, text, keep, least), StructType(fields))


def damaged(docs: DataFrame) -> DataFrame:
    """doc_id and text, with periodic tails planted in a tenth of the documents by crc32 of doc_id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # the words are bound by an outer lambda, so that they are found once
    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapsed(damaged(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "runs", "collapsed")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    own = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("best.s"), F.col("best.length"), -F.col("best.p"))
    return own.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: By other means: a run of period q and 12 words or more begins with a row of places whose six words recur q later.
SQL = r"""
with bytes as (select i, i::bigint c from range(256) t(i)),
crc_table as materialized (select list(list_reduce(list_prepend(c, range(8)::bigint[]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) t from bytes),
h as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) h
  from documents, crc_table),
a as (select *, len(w) n, (h // 10) % greatest(len(w), 1) a, (h // 10) % 8 k from h),
p as (select *, 1 + (n - a) // (3 + k) p from a),
d as materialized (select rid, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) else w end w from p),
six as materialized (select rid, i, hash(array_to_string(w[i + 1:i + 6], ' ')) g from (select rid, w, unnest(range(n - 5)) i from d)),
pairs as (select x.rid, x.i, y.i - x.i as q from six x join six y on x.rid = y.rid and x.g = y.g and x.i < y.i),
rows as (select rid, q, i, i - row_number() over (partition by rid, q order by i) island from pairs),
found as materialized (select rid, q, min(i) s, count(*) + 5 + q as len from rows group by rid, q, island having count(*) + 5 + q >= greatest(12, 2 * q)),
runs as materialized (select * from found f where not exists (select 1 from found o where o.rid = f.rid and o.q < f.q and f.q % o.q = 0 and o.s <= f.s and o.s + o.len >= f.s + f.len)),
gone as (select distinct rid, unnest(range(s + q, s + len)) i from runs),
word as (select rid, w, unnest(range(n)) i from d),
kept as (select word.rid, string_agg(w[i + 1], ' ' order by i) t from word left join gone using (rid, i) where gone.i is null group by 1),
best as (select rid, count(*) n, max({len: len, s: -s, q: -q}) b, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) t from runs group by 1)
select doc_id, coalesce(b.n, 0)::bigint n_runs, cast(-b.b.s as bigint) as start, cast(b.b.len as bigint) as length, cast(-b.b.q as bigint) as period, cast(1000 * b.b.len // (-b.b.q) as bigint) exponent_milli,
  sha256(coalesce(b.t, '')) runs_sha256, sha256(coalesce(k.t, '')) collapsed_sha256
from d left join best b using (rid) left join kept k using (rid)
"""

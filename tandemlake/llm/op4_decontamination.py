"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a bounded run of whole texts. Its words become symbols (words that no benchmark item has fold into
one separator, runs of it into one), its suffixes are sorted by prefix doubling, and the Burrows-Wheeler
transform goes into a wavelet matrix. All benchmark windows are searched backward at once, the rows that are
left walk to sampled suffix positions, and the words they cover merge into removal spans.

The benchmark is read in blocks of bounded size, one broadcast each. A shard's index serves all blocks of a round, which
has BLOCKS_AT_ONCE at most: a worker holds no more of the benchmark at a time, however large it is. For a larger one, each
further round reads the documents again with what was hit so far. Documents never move: there is no shuffle.

Defined results: a null or empty text has no words and is clean; a benchmark row with null or wordless text or
null id takes no part; items with equal windows all count; repeated item ids count once; equal documents get
equal results; with an empty benchmark everything is clean; other columns are not read (`cleaned` passes them
through).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.llm.common import ALNUM_WORD, LOWER, find_words, free_name, numbered, pieces_of, small_batches, table, text_slices, written

WINDOW = 10
#: Text bytes of a shard.
SHARD_BYTES = 1 << 20
#: Text bytes of a block of the benchmark, which bounds what is broadcast at once.
BLOCK_BYTES = 8 << 20
#: Blocks that are broadcast, and that a worker holds, at once.
BLOCKS_AT_ONCE = 8
#: Every so many places of the text the index keeps a suffix position.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start places of the suffixes in order. Each 0 is a separator of its own, ordered by place; the last symbol is 0."""
    n = len(symbols)
    separator = symbols == 0
    count = int(separator.sum())
    rank = np.where(separator, np.cumsum(separator) - 1, symbols.astype(np.int64) + count - 1)
    width = int(rank.max()) + 1
    after = np.where(separator, 0, np.append(rank[1:], 0))
    key = rank * width + after
    order = np.argsort(key)
    ranked = key[order]
    places = np.arange(n)
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, places, 0))
    slots = np.flatnonzero(~(first & np.append(first[1:], True)))
    open_ = order[slots]
    length = 2
    while len(open_):
        key = rank[open_] * (n + 1) + rank[open_ + length]
        sorting = np.argsort(key)
        ranked, open_ = key[sorting], open_[sorting]
        order[slots] = open_
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        rank[open_] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        keep = ~(first & np.append(first[1:], True))
        slots, open_ = slots[keep], open_[keep]
        length *= 2
    return order


class WaveletMatrix:
    """How often a symbol occurs before a place: one bit vector, as prefix counts, for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            set_ = bit.astype(bool)
            now = np.concatenate((now[~set_], now[set_]))

    def before(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places in the last level's order; the difference of two is a count of the symbol between them."""
        at = places
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            counted = ones[at]
            at = np.where((symbols >> (self.bits - 1 - level)) & 1, zeros + counted, at - counted)
        return at


class FMIndex:
    """Of a text of symbols above 0 with separators 0, the last of which ends it."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        self.bwt = symbols[order - 1]  # the symbol before the text's begin is its last, a separator
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet))))
        self.tree = WaveletMatrix(self.bwt, max(1, int(alphabet - 1).bit_length()))
        self.base = self.tree.before(np.arange(alphabet), np.zeros(alphabet, np.int64))
        # walks lead backward, never over a separator: the first place after one is sampled too
        kept = (order % sample == 0) | (self.bwt == 0)
        self.sampled = kept
        self.sample_rank = np.concatenate(([0], np.cumsum(kept)))
        self.positions = order[kept]

    def step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.starts[symbols] + self.tree.before(symbols, rows) - self.base[symbols]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pattern, first and last row (exclusive) of each pattern that occurs. Rows of patterns end at the right edge."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        width = patterns.shape[1]
        for k in range(width):
            own = np.flatnonzero(lengths[which] > k)
            symbols = patterns[which[own], width - 1 - k]
            low[own], high[own] = self.step(symbols, low[own]), self.step(symbols, high[own])
            live = low < high
            which, low, high = which[live], low[live], high[live]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of the suffixes in these rows."""
        out = np.empty(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        at = rows.copy()
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.positions[self.sample_rank[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            at = self.step(self.bwt[at], at)
            steps += 1
        return out


@dataclass
class Block:
    """Windows of some benchmark items: distinct ones as rows of symbols, and which items have each. Symbol k + 1 is word
    k of the vocabulary."""

    vocabulary: pa.LargeBinaryArray
    patterns: np.ndarray
    lengths: np.ndarray
    owner_ends: np.ndarray
    owners: np.ndarray
    items: list[str]


def build_block(items: list[tuple[str, str]], window: int = WINDOW) -> Block | None:
    data = np.frombuffer("".join(t for _, t in items).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for _, t in items]))).astype(np.int64)
    data = LOWER[data]
    starts, stops, first = find_words(data, offsets, ALNUM_WORD)
    if not len(starts):
        return None
    symbols, vocabulary = numbered(pieces_of(data, starts, stops))
    owners: dict[tuple[int, ...], set[int]] = {}
    for k in range(len(items)):
        own = tuple((symbols[first[k] : first[k + 1]] + 1).tolist())
        for at in range(max(1, len(own) - window + 1) if own else 0):
            owners.setdefault(own[at : at + window], set()).add(k)
    lengths = np.array([len(w) for w in owners])
    patterns = np.zeros((len(owners), window), np.int64)
    for row, w in enumerate(owners):
        patterns[row, window - len(w) :] = w
    ends = np.concatenate(([0], np.cumsum([len(x) for x in owners.values()])))
    return Block(vocabulary, patterns, lengths, ends, np.array([k for x in owners.values() for k in sorted(x)]), [i for i, _ in items])


def read_blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Block]:
    """The benchmark (item_id, text), at most BLOCK_BYTES at a time on the driver."""
    items: list[tuple[str, str]] = []
    held = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").dropna().toLocalIterator():
        if items and held + len(text) > BLOCK_BYTES:
            yield from filter(None, [build_block(items, window)])
            items, held = [], 0
        items.append((item, text))
        held += len(text)
    yield from filter(None, [build_block(items, window) if items else None])


def _shard_hits(blocks: list[Block], words: np.ndarray, distinct: pa.LargeBinaryArray, first: np.ndarray) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block the first word, word count and window of each occurrence in a shard, whose texts begin at the words
    `first`. One index, over the words that any block has, serves all of them."""
    places = [pc.fill_null(pc.index_in(distinct, value_set=b.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) for b in blocks]
    known = np.any([p >= 0 for p in places], axis=0)
    symbol = np.where(known, np.cumsum(known), 0)
    symbols = symbol[words]
    # a separator stands before each text; then runs of separators shrink to one
    with_ends = np.insert(symbols, first[:-1], 0)
    word = np.insert(np.arange(len(symbols)), first[:-1], -1)
    with_ends, word = np.append(with_ends, 0), np.append(word, -1)
    keep = np.append(True, (with_ends[1:] != 0) | (with_ends[:-1] != 0))
    text, word = with_ends[keep], word[keep]
    index = FMIndex(text, int(known.sum()) + 1)
    for block, place in zip(blocks, places, strict=True):
        here = np.zeros(len(block.vocabulary) + 1, np.int64)
        here[place[place >= 0] + 1] = symbol[place >= 0]
        patterns = here[block.patterns]
        # windows with a word that the shard lacks cannot occur
        possible = np.flatnonzero((patterns > 0).sum(axis=1) == block.lengths)
        which, low, high = index.search(patterns[possible], block.lengths[possible])
        counts = high - low
        rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        which = possible[np.repeat(which, counts)]
        yield block, word[index.locate(rows)], block.lengths[which], which


def _found(batches: Iterator[pa.RecordBatch], shared: list[Broadcast], text: str, keep: list[str], clean: bool, so_far: str | None, later: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Batches with what the blocks hit. A later round adds it to the column `so_far` (spans of words, and items); all rounds
    but the last give that column."""
    blocks = [one.value for one in shared]
    for batch in batches:
        for part, data, offsets in text_slices(batch, text, SHARD_BYTES):
            lower = LOWER[data]
            starts, stops, first = find_words(lower, offsets, ALNUM_WORD)
            words, distinct = numbered(pieces_of(lower, starts, stops))
            cover = np.zeros(len(starts) + 1, np.int64)
            items: dict[int, set[str]] = {}
            for d, x in enumerate(part.column(so_far).to_pylist() if later else ()):
                cover[[first[d] + a for a in x["begins"]]] += 1
                cover[[first[d] + b for b in x["ends"]]] -= 1
                items[d] = set(x["items"])
            for block, begin, length, which in _shard_hits(blocks, words, distinct, first) if len(starts) and blocks else ():
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + length, -1)
                doc = np.searchsorted(first, begin, "right") - 1
                for d, w in np.unique(np.stack((doc, which), 1), axis=0).tolist() if len(doc) else ():
                    items.setdefault(d, set()).update(block.items[k] for k in block.owners[block.owner_ends[w] : block.owner_ends[w + 1]])
            hit = np.cumsum(cover)[:-1] > 0
            hits_before = np.concatenate(([0], np.cumsum(hit)))
            # spans: runs of hit words within one text
            own = np.repeat(np.arange(len(first) - 1), np.diff(first))
            joined = hit[1:] & hit[:-1] & (own[1:] == own[:-1])
            begins = np.flatnonzero(hit & ~np.append(False, joined)[: len(hit)])
            ends = np.flatnonzero(hit & ~np.append(joined, False)[: len(hit)])
            span_text = own[begins]
            span_ends = np.searchsorted(span_text, np.arange(len(first))).astype(np.int32)
            if not last:
                own_first = first[span_text]
                hits = [{"begins": [], "ends": [], "items": sorted(items.get(d, ()))} for d in range(len(first) - 1)]
                for d, a, z in zip(span_text.tolist(), (begins - own_first).tolist(), (ends + 1 - own_first).tolist(), strict=True):
                    hits[d]["begins"].append(a)
                    hits[d]["ends"].append(z)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in dict.fromkeys([*keep, text])), pa.array(hits, _SO_FAR)], [*dict.fromkeys([*keep, text]), so_far])
                continue
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            base = points[offsets[span_text]]
            spans = pa.StructArray.from_arrays([pa.array(points[starts[begins]] - base), pa.array(points[stops[ends]] - base)], ["start", "stop"])
            columns = [part.column(c) for c in keep]
            if clean:
                cut = bytearray()
                sizes = []
                at = 0
                for d in range(len(offsets) - 1):
                    size = len(cut)
                    at = offsets[d]
                    for k in range(span_ends[d], span_ends[d + 1]):
                        cut += data[at : starts[begins[k]]].tobytes()
                        at = stops[ends[k]]
                    cut += data[at : offsets[d + 1]].tobytes()
                    sizes.append(len(cut) - size)
                where = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
                columns.append(pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(where.tobytes()), pa.py_buffer(bytes(cut))).cast(pa.string()))
            columns += [
                pa.array(np.diff(first), pa.int64()),
                pa.array(np.diff(hits_before[first]), pa.int64()),
                pa.array([sorted(items.get(d, ())) for d in range(len(first) - 1)], pa.list_(pa.string())),
                pa.ListArray.from_arrays(pa.array(span_ends), spans),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *(["clean_text"] if clean else []), "n_words", "n_hit", "items", "spans"])


def _runner(*options: object):
    return lambda batches: _found(batches, *options)


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, stop: long>>"


_SO_FAR = pa.struct([("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def contaminations(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", clean: bool = False) -> DataFrame:
    """`keep` columns, n_words, n_hit, items (ids with occurring windows) and spans (code points to remove, end
    exclusive), and with `clean` clean_text without these spans. A row per row of docs."""
    source, so_far = small_batches(docs).select(*dict.fromkeys([*keep, text])), None
    context = docs.sparkSession.sparkContext
    fields = lambda names: [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names]
    rounds = batched(read_blocks(benchmark), BLOCKS_AT_ONCE)
    shared = [context.broadcast(b) for b in next(rounds, ())]
    for more in rounds:
        hits = so_far or free_name(source, "so_far")
        schema = ", ".join([*fields(dict.fromkeys([*keep, text])), f"`{hits}` struct<begins: array<int>, ends: array<int>, items: array<string>>"])
        source = written(source.mapInArrow(_runner(shared, text, keep, False, hits, so_far is not None, False), schema), "benchmark-hits")
        for one in shared:
            one.destroy()
        shared, so_far = [context.broadcast(b) for b in more], hits
    schema = ", ".join([*fields(keep), *(["clean_text string"] if clean else []), FOUND])
    return source.mapInArrow(_runner(shared, text, keep, clean, so_far, so_far is not None, True), schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["stop"])), ",").alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: benchmark passages are cut out of the texts (n_chars follows); documents of which no word
    is left go, all others stay."""
    own = docs.columns
    hidden = {"clean_text", "n_words", "n_hit", "items", "spans"}
    others = [c for c in own if c not in ("text", "n_chars")]
    renamed = {c: f"own_{k}" for k, c in enumerate(others) if c.lower() in hidden}
    found = contaminations(docs.withColumnsRenamed(renamed), table(spark, sf_dir, "benchmark"), [renamed.get(c, c) for c in own if c != "text"], clean=True)
    back = {"text": F.col("clean_text"), "n_chars": F.when(F.col("n_hit") > 0, F.length("clean_text")).otherwise(F.col("n_chars"))}
    return found.filter("n_hit = 0 OR n_hit < n_words").select(*(back.get(c, F.col(renamed.get(c, c))).cast(docs.schema[c].dataType).alias(c) for c in own))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""
with d as (select row_number() over () rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select rid, doc_id, regexp_extract_all(t, '{_WORD}') w, regexp_split_to_array(t, '{_WORD}') gaps from d),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') w from benchmark where item_id is not null and text is not null),
bi as (select item, least(len(w), {WINDOW}) n, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) i from b where len(w) > 0),
win as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') g from bi),
p as (select rid, w, unnest(range(1, len(w) + 1)) i from w),
dw as (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') g from p, (select distinct n from win) s where i + n - 1 <= len(w)),
hits as (select rid, i, n, item from dw join win using (n, g)),
covered as (select distinct rid, i + k hit from (select distinct rid, i, n from hits), range({WINDOW}) r(k) where k < n),
found as (select rid, count(*) n from covered group by 1),
items as (select rid, count(*) n, string_agg(item, ',' order by item) ids from (select distinct rid, item from hits) group by 1),
places as (select rid, i, sum(length(gaps[i]) + case when i > 1 then length(w[i - 1]) else 0 end) over (partition by rid order by i) start, length(w[i]) size
  from (select w.rid, w.w, w.gaps, unnest(range(1, len(w) + 1)) i from w where rid in (select rid from found))),
runs as (select places.rid, start, start + size stop, i - row_number() over (partition by places.rid order by i) run from places join covered on places.rid = covered.rid and i = hit),
spans as (select rid, string_agg(a || ':' || z, ',' order by a) s from (select rid, min(start) a, max(stop) z from runs group by rid, run) group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(found.n, 0) as bigint) n_hit, cast(coalesce(items.n, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256, found.n is not null contaminated, coalesce(s, '') spans
from w left join found using (rid) left join items using (rid) left join spans using (rid)
"""

"""Quality rules as a bitmask ledger.

`ledger` measures every whole text once (vectorised, on Arrow buffers; lines and words are told apart by their bytes, not
by hashes) and stores the measurements with one failure bit per rule. Policies are versioned masks over these bits: applying another policy, or
asking what a policy would keep without one of its rules, reads the ledger and never a text again.

Defined results: a null or empty text has no words and zero measurements, and fails MIN_WORDS; equal rows
get equal results, one per row; an empty table gives an empty ledger; other columns pass through `ledger`
unless they bear the name of one of its own, which then wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.llm.common import SPACED_WORD, byte_class, counts_between, find_words, numbered, numbered_runs, pieces_of, small_batches, table, text_slices, written

SYMBOLS = byte_class(b"#*$%&|<>")
UPPER = byte_class(bytes(range(0x41, 0x5B)))
LOWERS = byte_class(bytes(range(0x61, 0x7B)))
EXCLAIM = byte_class(b"!")
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaim")


@dataclass(frozen=True)
class Rule:
    """Bit `bit` is set where `fails` holds. `fails` is SQL over MEASURES with integer arithmetic, so that ties are exact."""

    bit: int
    name: str
    fails: str


#: Bits are never renumbered: a stored ledger stays readable under later rule lists.
RULES = (
    Rule(0, "MIN_WORDS", "n_words < 20"),
    Rule(1, "REPEATED_WINDOWS", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "SYMBOL_RATIO", "100 * n_symbols > 6 * word_chars"),
    Rule(3, "DUPLICATE_LINES", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "MEAN_WORD_LENGTH", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(5, "UPPER_CASE", "n_upper > 50 AND n_upper > 2 * n_lower"),
    Rule(6, "EXCLAMATIONS", "100 * n_exclaim > 50 * n_words"),
    Rule(7, "LONG_WORDS", "word_chars > 12 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what leads to rejection: the rules whose bits are in `mask`."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base", ("MIN_WORDS", "REPEATED_WINDOWS"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("v1", (*BASE.rules, "SYMBOL_RATIO", "MEAN_WORD_LENGTH")),
        Policy("v2", (*BASE.rules, "SYMBOL_RATIO", "MEAN_WORD_LENGTH", "UPPER_CASE", "EXCLAMATIONS")),
    )
}
CURRENT = "v2"


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES of each text, as int64 arrays."""
    starts, stops, first = find_words(data, offsets, SPACED_WORD)
    per_text = np.diff(first)
    in_word_points = np.concatenate(([0], np.cumsum(SPACED_WORD[data] & ((data & 0xC0) != 0x80))))
    out = {"n_words": per_text, "word_chars": np.diff(in_word_points[offsets])}
    for name, flags in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_lower", LOWERS), ("n_exclaim", EXCLAIM)):
        out[name] = counts_between(np.flatnonzero(flags[data]), offsets)
    texts = np.arange(len(offsets) - 1)

    breaks = np.flatnonzero(data == 0x0A)
    line_from = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    line_text = np.searchsorted(offsets, line_from, "right") - 1
    # a break that ends a text begins a line of that text, which has no bytes and so no word
    line_to = np.append(line_from[1:], len(data))
    with_word = np.searchsorted(starts, line_from) < np.searchsorted(starts, line_to)
    line_from, line_to, line_text = line_from[with_word], line_to[with_word], line_text[with_word]
    line_to = line_to - ((line_to > line_from) & (data[np.maximum(line_to, 1) - 1] == 0x0A))
    out["n_lines"] = np.bincount(line_text, minlength=len(texts))
    keys = numbered(pieces_of(data, line_from, line_to))[0] * len(texts) + line_text
    _, once = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[once] = False
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=len(texts))

    windows = numbered_runs(numbered(pieces_of(data, starts, stops))[0], WINDOW)
    word_text = np.repeat(texts, per_text)
    own = np.flatnonzero(word_text[: len(windows)] == word_text[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    keys = windows[own] * len(texts) + word_text[own]
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, own[twice], 1)
    np.add.at(cover, own[twice] + WINDOW, -1)
    out["n_repeat_words"] = counts_between(np.flatnonzero(np.cumsum(cover)[:-1] > 0), first)
    return {k: out[k].astype(np.int64) for k in MEASURES}


def _measured(batches: Iterator[pa.RecordBatch], text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in text_slices(batch, text):
            found = measure(data, offsets)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(found[m]) for m in MEASURES)], [*keep, *MEASURES])


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One expression for all rules; each rule is evaluated once per row."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`keep` columns (default all), MEASURES and fail_bits, a row per row of docs. One narrow pass, no shuffle."""
    taken = {*MEASURES, "fail_bits"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    source = small_batches(docs).select(*dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), *(f"{m} long" for m in MEASURES)])
    return source.mapInArrow(lambda batches: _measured(batches, text, keep), schema).withColumn("fail_bits", failure_bits(rules))


def kept(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that it alone rejects, and that stay without it.

    The ledger is first folded to one row for each failure mask (at most 2 to the number of rules), so the
    shuffle is that small at any size; all counts then come from bit operations on the masks.
    """
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    ruled = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules)))
    each = masks.select("bits", "n", ruled.alias("r")).select("bits", "n", "r.*")
    count = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        F.lit(policy.version).alias("policy"),
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_only_this"),
        count(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id", *MEASURES[:5],
        (~kept(BASE)).alias("base_failed"),
        kept(POLICIES[CURRENT]).alias("kept"),
        "fail_bits", F.lit(CURRENT).alias("policy"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from one ledger that is stored and read again, as later policies would."""
    rows = written(ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]), "quality-ledger")
    each = [ablations(rows, p) for p in POLICIES.values()]
    return reduce(DataFrame.unionByName, each).select("policy", "rule", "n_failed", "n_only_this", "n_kept_without")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the current policy keeps, with their own columns."""
    names = {c: f"own_{k}_{c}" for k, c in enumerate(docs.columns)}  # so that none bears the name of a measure
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    passed = ledger(renamed, names["text"], list(names.values())).filter(kept(POLICIES[CURRENT]))
    return passed.select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))


_WHITE = r"\x20\x09-\x0D"
_LEDGER_SQL = rf"""d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^{_WHITE}]+') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WHITE}]')) l from d),
g as (select rid, len(w) n, unnest(range(1, len(w) - 6)) i, w from w),
h as (select rid, i, array_to_string(w[i:i + 7], ' ') g from g),
twice as (select rid, g from h group by 1, 2 having count(*) > 1),
again as (select rid, count(distinct i + k) n from h join twice using (rid, g), range(8) r(k) group by 1),
m as (select doc_id, cast(len(w) as bigint) n_words, cast(length(regexp_replace(t, '[{_WHITE}]+', '', 'g')) as bigint) word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, cast(coalesce(again.n, 0) as bigint) n_repeat_words,
    len(l) n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) n_lower, length(regexp_replace(t, '[^!]', '', 'g')) n_exclaim
  from w left join again using (rid)),
ledger as (select *, cast({" + ".join(f"case when {r.fails} then {1 << r.bit} else 0 end" for r in RULES)} as bigint) fail_bits from m)"""
SQL = f"""with {_LEDGER_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {BASE.mask} <> 0 base_failed, fail_bits & {POLICIES[CURRENT].mask} = 0 kept, fail_bits, '{CURRENT}' as policy from ledger"""
ABLATIONS_SQL = f"""with {_LEDGER_SQL},
p(policy, mask, rule, bit) as (values {", ".join(f"('{p.version}', {p.mask}, '{r.name}', {1 << r.bit})" for p in POLICIES.values() for r in RULES if r.name in p.rules)})
select policy, rule, count(*) filter (fail_bits & bit <> 0) n_failed, count(*) filter (fail_bits & mask = bit) n_only_this, count(*) filter ((fail_bits & mask) & ~bit = 0) n_kept_without from ledger, p group by 1, 2"""

"""Personal data by weak supervision, in SQL expressions only.

1. Patterns propose candidate spans in each whole text: the four base kinds with their checks, which always
   stand, and looser ones (telephone numbers without prefix, spelt-out mail addresses, secrets, names after a
   title, social-security and bank account numbers).
2. Labelers vote on each candidate: the strict shape, a gazetteer, the context and the variety of characters
   say yes, no or nothing.
3. Expectation-maximisation over the votes, kind by kind, estimates how reliable each labeler is and the
   probability of each vote pattern. There are at most 3^4 patterns a kind, whatever the input; one SQL fold
   does all rounds.
4. These probabilities are soft labels for a naive Bayes classifier of spans over shape features; a candidate
   becomes a span if the classifier and the votes together make it likely.

Nothing is shuffled but pattern counts. Positions are code points, ends exclusive.

Defined results: null and empty texts have no spans; equal texts get equal spans; overlaps between kinds stay,
but an added span that overlaps a base span is dropped, and of overlapping added spans the first stays; an
empty table gives an empty result; other columns are not read (the pipeline stage passes them through).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.llm.common import cut, free_name, table, written


@dataclass(frozen=True)
class Pattern:
    """A source of candidates: `probe` is a cheap necessary condition on the text, `check` one on the match x.m."""

    kind: str
    regex: str
    probe: str
    check: str
    base: bool


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(sequence(1, length({_DIGITS})), i -> cast(substring(reverse({_DIGITS}), i, 1) as int) * (2 - i % 2)),
    0, (s, d) -> int(s + d div 10 + d % 10)) % 10 = 0"""
#: The base patterns find what the plain ones find: a match starts where its run of characters starts or the match
#: before it ended, and possessive repeats never give back what the rest could not use. So no text takes quadratic time.
PATTERNS = (
    Pattern("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0", "true", True),
    Pattern(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike '[0-9]\\.[0-9]'",
        r"forall(split(x.m, '\\.'), p -> length(regexp_replace(p, '^0+(?=[0-9])', '')) <= 3 and cast(right(p, 3) as int) <= 255)", True,
    ),
    Pattern("card", r"[0-9](?:[\x20-]?[0-9])++", "text rlike '[0-9][ -]?[0-9]'", f"length({_DIGITS}) between 14 and 19 and {_LUHN}", True),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0", f"length({_DIGITS}) between 10 and 15", True),
    Pattern("phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "text rlike '[0-9]{3}[ .-][0-9]{4}'", "true", False),
    Pattern(
        "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,24}){1,4}",
        r"text rlike '[\\[(](?:at|AT)[\\])]'", "true", False,
    ),
    Pattern(
        "secret", r"""(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)[ ]?[=:][ ]?["']?[A-Za-z0-9+/_.-]{8,}+["']?""",
        "text rlike '(?i)(?:password|passwd|pwd|token|secret|api[_-]?key)[ ]?[=:]'", "true", False,
    ),
    Pattern("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?", r"text rlike '(?:Mr|Mrs|Ms|Dr|Prof)\\. [A-Z]'", "true", False),
    Pattern("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '[0-9]-[0-9]{2}-[0-9]{4}'", "true", False),
    Pattern("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "text rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'", "true", False),
)
KINDS = ("email", "ip", "card", "phone", "secret", "name", "ssn", "iban")
BASE_KINDS = KINDS[:4]

#: Words that stand before such data, and beginnings or endings that it has.
CONTEXT = {
    "email": "mail|contact|write|address|kontakt|correo|courriel",
    "ip": "ip|host|server|address|serveur|servidor",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|appelez|llame",
    "secret": "key|login|auth|credential|export",
    "name": "dear|regards|signed|author|patient",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\.|127\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^[3-6]",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
    "secret": r"(?i)^(?:password|passwd|token|secret|api)",
    "name": r"^(?:Mr|Mrs|Ms|Dr)\.",
    "ssn": r"^(?!000|666|9)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_kind(of: dict[str, str], test: str) -> str:
    return "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {test.format(_quoted(v))}" for k, v in of.items()) + " END"


#: (name, SQL on candidate x that gives true, false or null).
LABELERS = (
    ("pattern", "CASE WHEN x.base THEN true WHEN x.kind IN ('secret', 'ssn', 'iban') THEN true END"),
    ("gazetteer", _by_kind(GAZETTEER, "x.m rlike {}")),
    ("context", "CASE WHEN " + _by_kind({k: f"(?i)(?:{v})[^A-Za-z0-9]{{0,4}}(?:[a-z]{{1,3}} )?$" for k, v in CONTEXT.items()}, "x.before rlike {}") + " THEN true END"),
    ("variety", "size(array_distinct(split(lower(x.m), ''))) >= least(6, length(x.m) div 3 + 1)"),
)
#: (name, SQL on candidate x that gives a small integer): what the classifier sees.
FEATURES = (
    ("length", "cast(least(6, floor(log2(length(x.m) + 1))) as int)"),
    ("digits", "cast(floor(4D * length(regexp_replace(x.m, '[^0-9]', '')) / length(x.m)) as int)"),
    ("upper", "cast(floor(4D * length(regexp_replace(x.m, '[^A-Z]', '')) / length(x.m)) as int)"),
    ("breaks", "least(4, length(regexp_replace(x.m, '[A-Za-z0-9]', '')))"),
    ("context", "int(coalesce(" + LABELERS[2][1] + ", false))"),
    ("base", "int(x.base)"),
)
ROUNDS = 25
_CANDIDATE = "struct<kind: string, base: boolean, start: int, stop: int, m: string, before: string>"
_SPAN = "struct<start: int, rank: int, kind: string, base: boolean, stop: int>"
#: Items that a fold holds before it starts a new list, and code points in a block of a text that is cut: they keep the work
#: on a text in proportion to its length, since arrays and strings are copied when they grow and walked to a place in them.
STRETCH, BLOCK = 256, 4096


def _scanned(items: str, start: str, step: str, emit: str, of: str) -> str:
    """SQL for a fold over the array `items` that gives an array of `of`: `step` is the state after item x and `emit` the
    array of what it gives, both from x and the state before it, q.s. The fold runs stretch by stretch."""
    inner = f"""aggregate(slice(v, 1 + {STRETCH} * c, {STRETCH}), named_struct('s', o.s, 'out', cast(array() as array<{of}>)),
      (q, x) -> named_struct('s', {step}, 'out', concat(q.out, {emit})))"""
    return f"""transform(array({items}), v -> aggregate(sequence(0, cast((size(v) - 1) div {STRETCH} as int)),
      named_struct('s', {start}, 'outs', cast(array() as array<array<{of}>>)),
      (o, c) -> transform(array({inner}), z -> named_struct('s', z.s, 'outs', concat(o.outs, array(z.out))))[0],
      o -> flatten(o.outs)))[0]"""


def _placed(k: int, p: Pattern) -> str:
    """Candidates of pattern k: its matches m{k}, which lie between the parts p{k} of the text, that pass the check."""
    items = f"zip_with(slice(p{k}, 1, size(m{k})), m{k}, (a, b) -> named_struct('a', a, 'm', b))"
    one = f"""named_struct('kind', '{p.kind}', 'base', {str(p.base).lower()}, 'start', q.s + length(x.a), 'stop', q.s + length(x.a) + length(x.m),
      'm', x.m, 'before', right(x.a, 24))"""
    emit = f"CASE WHEN {p.check} THEN array({one}) ELSE cast(array() as array<{_CANDIDATE}>) END"
    none = f"cast(array() as array<{_CANDIDATE}>)"
    return f"CASE WHEN size(m{k}) > 0 THEN {_scanned(items, '0', 'q.s + length(x.a) + length(x.m)', emit, _CANDIDATE)} ELSE {none} END"


def candidates(docs: DataFrame, text: str = "text", into: str = "candidates") -> DataFrame:
    """docs with `into`: (kind, base, start, stop, m, before) of every match that passes its check, pattern by pattern."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    # patterns see the text under a name that no other column has
    source = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = source.select(
        "row",
        *(F.expr(f"CASE WHEN {p.probe} THEN regexp_extract_all(text, {_quoted(p.regex)}, 0) END").alias(f"m{k}") for k, p in enumerate(PATTERNS)),
        *(F.expr(f"CASE WHEN {p.probe} THEN split(text, {_quoted(p.regex)}, -1) END").alias(f"p{k}") for k, p in enumerate(PATTERNS)),
    )
    return found.select("row.*", F.concat(*(F.expr(_placed(k, p)) for k, p in enumerate(PATTERNS))).alias(into))


def _votes() -> str:
    return "array(" + ", ".join(f"int({sql})" for _, sql in LABELERS) + ")"


def reliabilities(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, prior, yes, no and patterns with their probability q: of votes (kind, v array<int>, n).

    yes[j] and no[j] are the chances that labeler j, if it votes, is right on a true and on a false candidate. One vote
    of each kind is added to all counts, with 0.8 of them right, which also fixes which class is which.
    """
    logit = """ln(s.prior / (1 - s.prior)) + aggregate(zip_with(p.v, zip_with(s.yes, s.no, (a, b) -> named_struct('yes', a, 'no', b)),
      (v, w) -> CASE v WHEN 1 THEN ln(w.yes / (1 - w.no)) WHEN 0 THEN ln((1 - w.yes) / w.no) ELSE 0D END), 0D, (x, y) -> x + y)"""
    q = f"1 / (1 + exp(-({logit})))"
    total = lambda what: f"aggregate(zip_with(patterns, q, (a, b) -> named_struct('p', a, 'q', b)), 0D, (x, y) -> x + ({what}))"
    j = f"sequence(0, {len(LABELERS) - 1})"
    step = f"""transform(array(transform(patterns, p -> {q})), q -> named_struct(
      'prior', ({total("y.p.n * y.q")} + 1D) / ({total("y.p.n * 1D")} + 2D),
      'yes', transform({j}, j -> ({total("CASE WHEN y.p.v[j] = 1 THEN y.p.n * y.q ELSE 0D END")} + 1.6D) / ({total("CASE WHEN y.p.v[j] IS NOT NULL THEN y.p.n * y.q ELSE 0D END")} + 2D)),
      'no', transform({j}, j -> ({total("CASE WHEN y.p.v[j] = 0 THEN y.p.n * (1 - y.q) ELSE 0D END")} + 1.6D) / ({total("CASE WHEN y.p.v[j] IS NOT NULL THEN y.p.n * (1 - y.q) ELSE 0D END")} + 2D))))[0]"""
    start = f"named_struct('prior', 0.5D, 'yes', array_repeat(0.8D, {len(LABELERS)}), 'no', array_repeat(0.8D, {len(LABELERS)}))"
    grouped = votes.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("patterns"))
    fitted = grouped.withColumn("s", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})"))
    return fitted.select("kind", "s.*", F.expr(f"transform(patterns, p -> named_struct('v', p.v, 'n', p.n, 'q', {q}))").alias("patterns"))


def train(found: DataFrame, into: str = "candidates") -> DataFrame:
    """The classifier: one row with `votes` (map from kind and votes to probability) and `weights` (map from kind,
    feature and value to log-odds). Its size depends on the patterns and features alone."""
    each = found.select(F.explode_outer(into).alias("x")).filter("x IS NOT NULL").select(
        F.col("x.kind").alias("kind"), F.expr(_votes()).alias("v"), F.expr("array(" + ", ".join(sql for _, sql in FEATURES) + ")").alias("f")
    )
    counted = cut(each.groupBy("kind", "v", "f").agg(F.count(F.lit(1)).alias("n")))  # one pass over the texts
    fitted = reliabilities(counted.groupBy("kind", "v").agg(F.sum("n").alias("n")))
    soft = fitted.select("kind", F.explode("patterns").alias("p")).select("kind", F.col("p.v").alias("v"), F.col("p.q").alias("q"))
    named = soft.select(F.col("kind").alias("of"), F.col("v").alias("voted"), "q")
    labelled = counted.join(named, (F.col("kind") == F.col("of")) & F.col("v").eqNullSafe(F.col("voted"))).select("kind", "f", "n", "q")
    flat = labelled.select("kind", "n", "q", F.posexplode("f").alias("at", "value"))
    by_value = flat.groupBy("kind", "at", "value").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no"))
    by_kind = labelled.groupBy("kind").agg(F.sum(F.col("n") * F.col("q")).alias("all_yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("all_no"))
    odds = by_value.join(by_kind, "kind").select(
        F.concat_ws(":", "kind", "at", "value").alias("key"),
        F.log(((F.col("yes") + 1) / (F.col("all_yes") + 8)) / ((F.col("no") + 1) / (F.col("all_no") + 8))).alias("w"),
    )
    weights = odds.agg(F.map_from_entries(F.collect_list(F.struct("key", "w"))).alias("weights"))
    votes = soft.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("kind"), F.col("v").cast("string")), "q"))).alias("votes"))
    return votes.crossJoin(weights)  # one row each


def spans(found: DataFrame, model: DataFrame, into: str = "candidates") -> DataFrame:
    """found with `into` as an array of the (start, rank, kind, base, stop) that are personal data, by start and kind."""
    votes, weights = free_name(found, "votes"), free_name(found, "weights")
    ready = found.crossJoin(F.broadcast(model.select(F.col("votes").alias(votes), F.col("weights").alias(weights))))  # one row
    log_odds = " + ".join(f"coalesce(element_at(`{weights}`, concat_ws(':', x.kind, {k}, {sql})), 0D)" for k, (_, sql) in enumerate(FEATURES))
    voted = f"coalesce(element_at(`{votes}`, concat(x.kind, cast({_votes()} as string))), 0.5D)"
    likely = f"(ln(greatest({voted}, 1e-9D) / greatest(1 - {voted}, 1e-9D)) + {log_odds}) > 0"
    rank = "array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind)"
    likely_ones = f"""array_sort(transform(filter(`{into}`, x -> x.base OR {likely}),
      x -> named_struct('start', x.start, 'rank', int({rank}), 'kind', x.kind, 'base', x.base, 'stop', x.stop)))"""
    stays = lambda that: f"CASE WHEN x.base OR {that} THEN array(x) ELSE cast(array() as array<{_SPAN}>) END"
    # added spans go where a base span reaches over them from before or begins within them; then the first of several stays
    behind = _scanned(likely_ones, "0", "greatest(q.s, CASE WHEN x.base THEN x.stop ELSE 0 END)", stays("x.start >= q.s"), _SPAN)
    ahead = _scanned(f"reverse({behind})", "2147483647", "CASE WHEN x.base THEN x.start ELSE q.s END", stays("x.stop <= q.s"), _SPAN)
    apart = _scanned(f"reverse({ahead})", "0", "CASE WHEN x.base OR x.start < q.s THEN q.s ELSE x.stop END", stays("x.start >= q.s"), _SPAN)
    chosen = f"CASE WHEN size(`{into}`) = 0 THEN cast(array() as array<{_SPAN}>) ELSE {apart} END"
    return ready.withColumn(into, F.expr(chosen)).drop(votes, weights)


def _digest(of: str) -> Column:
    return F.array_join(F.transform(F.col(of) if of.isidentifier() else F.expr(of), lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut(candidates(docs).drop("text"))
    rows = spans(found, train(found), "candidates")
    counts = [F.expr(f"cast(size(filter(candidates, x -> x.base AND x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS]
    return rows.select("doc_id", *counts, F.sha2(_digest("filter(candidates, x -> x.base)"), 256).alias("base_sha256"), _digest("candidates").alias("spans"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of `text` replaced by its kind in angle brackets; overlapping spans become the first one's. The
    candidates are found once and kept with their rows in the shared folder."""
    into, blocks = free_name(docs, "candidates"), free_name(docs, "blocks")
    found = written(candidates(docs, text, into), "candidates")
    rows = spans(found, train(found, into), into).withColumn(blocks, F.expr(f"CASE WHEN size(`{into}`) > 0 THEN regexp_extract_all(`{text}`, '(?s).{{1,{BLOCK}}}', 0) END"))
    number = lambda of: f"cast(({of}) div {BLOCK} as int)"
    piece = lambda a, b: f"""CASE WHEN {b} > {a} THEN substring(array_join(slice(`{blocks}`, 1 + {number(a)}, 1 + {number(f"{b} - 1")} - {number(a)}), ''),
      1 + {a} % {BLOCK}, {b} - {a}) ELSE '' END"""  # noqa: E731
    shown = f"CASE WHEN x.start >= q.s THEN array(concat({piece('q.s', 'x.start')}, '<', upper(x.kind), '>')) ELSE cast(array() as array<string>) END"
    folded = _scanned(f"`{into}`", "0", "greatest(q.s, x.stop)", shown, "string")
    rest = f"transform(array(array_max(transform(`{into}`, x -> x.stop))), e -> transform(array(length(`{text}`)), n -> {piece('e', 'n')})[0])[0]"
    whole = F.expr(f"concat(array_join({folded}, ''), {rest})")
    return rows.withColumn(text, F.when(F.size(into) > 0, whole).otherwise(F.col(f"`{text}`"))).drop(into, blocks)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, personal data masked; n_chars follows where the text has changed."""
    own, before = docs.columns, free_name(docs, "before")
    rows = masked(docs.withColumn(before, F.xxhash64("text")))
    size = F.when(F.xxhash64("text") != F.col(before), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.withColumn("n_chars", size).select(*own)

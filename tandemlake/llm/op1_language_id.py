"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of 1 to 3 characters (letters in lower case; every run of other characters is one space),
hashed into BUCKETS. Document frequencies come from all documents of the training folds. Weights are learned
by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows (about
SAMPLE_PER_LANGUAGE a language, taken by a hash of doc_id), of which every fifth is kept back to fit the
temperature. TF-IDF vectors have sum 1, so a text's logits are means over its n-grams: two table look-ups for
each, at any length.

Learned from: text and non-null lang of documents whose crc32(doc_id) mod 5 is not 0. A prediction sees the
text alone.

Defined results: null texts and texts without a letter get `und` with score 0, as does every text if there is
nothing to learn from; a null doc_id counts as the empty string in the fold; equal texts get equal
predictions; of equal scores the language first in alphabetical order wins; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.llm.common import small_batches, table, text_slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 17
#: Labelled rows that training sees, for each language.
SAMPLE_PER_LANGUAGE = 1000
EPOCHS = 3
#: Learning rate and its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-5
#: Vectors have this sum, not 1, while weights are learned.
SCALE = 20.0

_letters: np.ndarray | None = None


def _letter(c: str) -> int:
    """The letter in lower case, where that is one character; 0 for what is no letter."""
    low = c.lower()
    return 0 if not c.isalpha() else ord(low) if len(low) == 1 else ord(c)


def _letter_table() -> np.ndarray:
    """Lower-case letter of each code point of the first plane; 0 for what is no letter."""
    global _letters
    if _letters is None:
        out = np.zeros(1 << 16, np.uint32)
        out[:] = [_letter(chr(k)) for k in range(1 << 16)]
        _letters = out
    return _letters


def ngram_buckets(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the bucket and the text of each n-gram (texts ascending); and the number of letters of each text."""
    joined = "".join(f"\n{t}\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter_table()[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    letters[beyond] = [_letter(chr(p)) for p in points[beyond].tolist()]
    owner = np.repeat(np.arange(len(texts)), np.array([len(t) + 2 for t in texts], np.int64))
    counts = np.bincount(owner[letters > 0], minlength=len(texts))
    # a space stands before and after each text's letters, wherever the text lies in its batch; runs of spaces shrink to one
    keep = np.append(True, (letters[1:] > 0) | (letters[:-1] > 0) | (owner[1:] != owner[:-1])) if len(letters) else np.zeros(0, bool)
    letters, owner = letters[keep].astype(np.uint64), owner[keep]
    buckets, owners = [], []
    code = np.zeros(len(letters), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = code[: len(letters) - n + 1] * np.uint64(0x110000 | 1) + letters[n - 1 :]
        if n not in ORDERS:
            continue
        hashed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        middle = letters[n // 2 : len(letters) - n + 1 + n // 2]
        own = np.flatnonzero((owner[: len(code)] == owner[n - 1 :]) & ((middle > 0) | (n > 1)))
        buckets.append((hashed[own] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
        owners.append(owner[own])
    return buckets, owners, counts


def _per_text(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their counts."""
    buckets, owners, _ = ngram_buckets(texts)
    ends = [np.searchsorted(o, np.arange(len(texts) + 1)) for o in owners]
    for k in range(len(texts)):
        own = np.concatenate([b[e[k] : e[k + 1]] for b, e in zip(buckets, ends, strict=True)])
        yield np.unique(own, return_counts=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts_seen = np.zeros(BUCKETS, np.int64), 0
    last = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part, _, _ in text_slices(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            buckets, owners, _ = ngram_buckets(texts)
            texts_seen += len(texts)
            ends = [np.searchsorted(o, np.arange(len(texts) + 1)) for o in owners]
            for k in range(len(texts)):
                own = np.concatenate([b[e[k] : e[k + 1]] for b, e in zip(buckets, ends, strict=True)])
                at = np.arange(len(own))
                last[own] = at
                total[own[last[own] == at]] += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], texts_seen))], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in text_slices(batch):
            found = list(_per_text([t or "" for t in part.column("text").to_pylist()]))
            lists = [pa.array([x[k].tolist() for x in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("lang"), *lists], ["h", "lang", "buckets", "counts"])


@dataclass
class Model:
    """weights: BUCKETS x languages; idf: BUCKETS. Bounded by the number of languages."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (buckets, values, class) rows in the order given: FTRL-proximal with L1 and L2."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for buckets, values, label in rows:
            at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)[:, None]
            own_z, own_n = z[at], n[at]
            w = weights(own_z, own_n)
            error = _softmax((x * w).sum(axis=0))
            error[label] -= 1
            g = x * error
            z[at] = own_z + g - (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA * w
            n[at] = own_n + g * g
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log-loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    low, high, g = -1.5, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame) -> Model | None:
    """From the labelled documents of the training folds; None if there are none."""
    folds = small_batches(docs).select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(folds.groupBy("lang").count().collect())
    if not sizes:
        return None
    found = folds.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS + 1)
    frequencies = found.toPandas()
    counts[frequencies["bucket"].to_numpy()] = frequencies["n"].to_numpy()
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1

    languages = sorted(sizes)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_PER_LANGUAGE / sizes[lang]))).otherwise(share)
    hashed = folds.withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = hashed.filter(F.pmod(F.col("h"), F.lit(1_000_003)) < share * 1_000_003).select("h", "lang", "text")
    chosen = chosen.mapInArrow(_features, "h long, lang string, buckets array<long>, counts array<long>")
    rows = []
    for h, lang, buckets, n in sorted(chosen.orderBy("h").limit(2 * SAMPLE_PER_LANGUAGE * len(languages)).collect(), key=lambda r: (r[0], r[1])):
        if buckets:
            at = np.array(buckets)
            x = np.array(n) * idf[at]
            rows.append((h, at, x * (SCALE / x.sum()), languages.index(lang)))
    if not rows:
        return None
    learned = [r[1:] for r in rows if r[0] % 5] or [r[1:] for r in rows]
    weights, bias = fit_ftrl(learned, len(languages))
    kept = [r[1:] for r in rows if r[0] % 5 == 0]
    logits = np.array([(x[:, None] * weights[at]).sum(axis=0) + bias for at, x, _ in kept]).reshape(-1, len(languages))
    return Model(languages, idf, weights * SCALE, bias, fit_temperature(logits, np.array([y for *_, y in kept], int)))


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns with lang_pred and score, a row per row of docs; one narrow pass."""
    ready = None
    if model:
        stacked = np.column_stack((model.idf[:, None] * model.weights, model.idf)).astype(np.float32)
        ready = docs.sparkSession.sparkContext.broadcast((model.languages, stacked, model.bias, model.temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if ready:
                    languages, stacked, bias, temperature = ready.value
                    buckets, owners, letters = ngram_buckets(texts)
                    sums = np.zeros((len(texts), len(languages) + 1))
                    for b, o in zip(buckets, owners, strict=True):
                        if len(o):
                            first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
                            sums[o[first]] += np.add.reduceat(stacked[b], first, axis=0, dtype=np.float64)
                    own = np.flatnonzero(letters > 0)
                    chance = _softmax((sums[own, :-1] / sums[own, -1:] + bias) / temperature)
                    best = chance.argmax(axis=1) if len(own) else own
                    scores[own] = chance[np.arange(len(own)), best]
                    for k, x in zip(own.tolist(), best.tolist(), strict=True):
                        names[k] = languages[x]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names), pa.array(scores)], [*keep, "lang_pred", "score"])

    source = small_batches(docs).select(*dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])
    return source.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or makes the document's score.

Only documents have labels. A sentence's score is a logistic function of hashed words and
word beginnings, less a part for the number of sentences, so that a very long text is not
toxic for its length; a document is toxic if any of its sentences is, so its score is one
minus the product of what its sentences leave. The gradient of the document's loss trains
the sentence scorer, which afterwards tells which sentences offend. Training and scoring use
one formula.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import ascii_fold, blocks, letters_digits, pick, word_bounds, word_hashes

#: Buckets of the hashed features; word beginnings of so many bytes are features too.
BUCKETS, BEGINNINGS = 1 << 18, (4, 5, 6)
#: The classifier is fitted on at most so many labelled documents of each class (chosen by
#: a hash of their id), each of at most so many characters, all of at most so many.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS, MOST_ALL = 2_000, 4_000, 100_000, 24_000_000
#: Passes over the sample, and the least number of steps, which few rows take more passes for.
EPOCHS, STEPS, BATCH, STEP, START_BIAS, SEED = 40, 600, 200, 0.3, -7.5, 11
#: What keeps a weight at zero: this share of one document's gradient.
SHRINK = 0.3
#: How much the logarithm of the number of a document's sentences lowers each one's logit.
CROWD = 0.5
THRESHOLD = 0.7

FOLD = ascii_fold(letters_digits())
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # line feed ! . ?


@dataclass
class Sentences:
    """Some texts' sentences: the words' features (4 a word), where each sentence's words begin, its row and bytes."""

    features: np.ndarray
    first: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: int


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    folded = FOLD[data]
    starts, ends = word_bounds(folded != 0, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    stops = np.cumsum(_STOP[data])
    number = stops[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(number) > 0) | (np.diff(row) > 0)
    first = np.flatnonzero(new)
    hashes = [word_hashes(folded, starts, ends)]
    for i, n in enumerate(BEGINNINGS):
        hashes.append(word_hashes(folded, starts, ends, n) + np.uint64(0x51ED270B * (i + 1)))
    features = np.stack([(h >> np.uint64(20)).astype(np.int64) % BUCKETS for h in hashes], 1).astype(np.int32)
    past = np.append(first[1:], len(starts)).astype(np.int64)
    return Sentences(features, first, row[first], starts[first], ends[past - 1] if len(first) else ends, len(offsets) - 1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(z / 2)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def logits(self, s: Sentences) -> np.ndarray:
        if len(s.first) == 0:
            return np.zeros(0)
        crowd = CROWD * np.log(np.bincount(s.row, minlength=s.rows)[s.row])
        return np.add.reduceat(self.weights[s.features].sum(1, dtype=np.float64), s.first) + self.bias - crowd

    def documents(self, s: Sentences, logits: np.ndarray) -> np.ndarray:
        """The noisy-or of the sentences' scores; a text without words scores 0."""
        left = np.bincount(s.row, np.logaddexp(0, logits), s.rows) if len(logits) else np.zeros(s.rows)
        return -np.expm1(-left)


def _pack(texts: list[str]) -> Iterator[Sentences]:
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        yield sentences(data, offsets)


def fit(texts: list[str], labels: list[int], weights: list[float]) -> Scorer:
    """Fit by AdaGrad on the weighted log loss of the documents, with a proximal step towards zero weights."""
    scorer = Scorer(np.zeros(BUCKETS, np.float32), START_BIAS)
    if not texts:
        return scorer
    order = np.random.default_rng(SEED).permutation(len(texts))
    parts = []
    for at in range(0, len(order), BATCH):
        own = order[at : at + BATCH]
        y, c = np.array([labels[i] for i in own], float), np.array([weights[i] for i in own])
        done = 0
        for s in _pack([texts[i] for i in own]):
            parts.append((s, y[done : done + s.rows], c[done : done + s.rows]))
            done += s.rows
    shrink = SHRINK / len(texts)
    square, bias_square = np.full(BUCKETS, 1e-4, np.float32), 1e-4
    for _ in range(max(EPOCHS, -(-STEPS // len(parts)))):
        for s, y, c in parts:
            if len(s.first) == 0:
                continue
            z = scorer.logits(s)
            p = logistic(z)
            whole = np.clip(scorer.documents(s, z), 1e-6, 1 - 1e-9)
            slope = np.where(y == 1, -np.minimum((1 - whole) / whole, 1e3), 1.0) * c / s.rows
            g = p * slope[s.row]
            per_word = np.repeat(g, np.diff(np.append(s.first, len(s.features))))
            grad = np.bincount(s.features.ravel(), np.repeat(per_word, s.features.shape[1]), BUCKETS).astype(np.float32)
            hit = np.flatnonzero(grad)
            square[hit] += grad[hit] ** 2
            rate = STEP / np.sqrt(square[hit])
            moved = scorer.weights[hit] - rate * grad[hit]
            scorer.weights[hit] = np.sign(moved) * np.maximum(np.abs(moved) - rate * shrink, 0)
            total = float(g.sum())
            bias_square += total**2
            scorer.bias -= STEP * total / bias_square**0.5
    return scorer


def fold_of(key: Column) -> Column:
    """The remainder by 3 of the CRC-32 of an id as text; rows of remainder 1 are held out. Null: 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic, known): a bounded sample of labelled rows outside the held-out fold, in one partition.

    ``known`` is how many labelled ids the row's class has, sampled or not. An id labelled
    more than once is toxic if any label says so; one that many rows have gives its least
    text. Rows without a label, an id or a text, and texts that are too long, are left out.
    Empty tables give no rows; extra columns are left out.
    """
    known = pick(labels, key, "toxic").where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col(key)) != 1))
    known = known.groupBy(key).agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64(key), key).limit(most).withColumn("known", F.lit(sizes.get(y, 0))) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most MOST_TOXIC + MOST_CLEAN rows
    rows = pick(docs, key, text).where(F.col(text).isNotNull() & (F.length(text) <= MOST_CHARS)).join(sample, key)
    each = rows.groupBy(key, "toxic", "known").agg(F.min(text).alias("text")).withColumn("_h", F.xxhash64(key))
    so_far = F.sum(F.length("text")).over(Window.orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0))  # of the sample
    return each.withColumn("_total", so_far).where(F.col("_total") <= MOST_ALL).select("text", "toxic", "known")


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Scorer:
    """A scorer fitted by one task on the bounded sample of ``training_rows``; the driver gets its weights alone.

    Weights of rows make up for the classes' different rates of sampling. Without labelled
    rows all sentences score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        labels: list[int] = []
        known: list[int] = []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            known += batch.column(2).to_pylist()
        sizes = {y: labels.count(y) for y in set(labels)}
        share = [k / sizes[y] for y, k in zip(labels, known, strict=True)]
        mean = sum(share) / max(1, len(share))
        found = fit(texts, labels, [x / mean for x in share])
        yield pa.RecordBatch.from_arrays([pa.array([found.weights.tobytes()], pa.binary()), pa.array([found.bias])], names=["weights", "bias"])

    rows = training_rows(docs, labels, key, text).coalesce(1).mapInArrow(run, "weights binary, bias double").collect()
    return Scorer(np.frombuffer(rows[0]["weights"], np.float32), rows[0]["bias"]) if rows else fit([], [], [])


def score(docs: DataFrame, scorer: Scorer, text: str = "text", located: float = 0.5) -> DataFrame:
    """docs with ``_score`` and ``_offending``, the spans (code points) of sentences that score ``located`` or more.

    Null and empty texts score 0 and have no spans; repeated rows each come back, an empty
    table gives no rows. All columns are kept, but columns of these two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    docs = docs.drop("_score", "_offending")
    out = docs.withColumns({"_score": F.lit(0.0), "_offending": F.expr("cast(array() as array<struct<start:bigint,end:bigint,score:double>>)")})
    at, schema = docs.columns.index(text), out.schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, past, data, offsets in blocks(batch.column(at)):
                s = sentences(data, offsets)
                z = sent.value.logits(s)
                scores[first:past] = sent.value.documents(s, z)
                p = logistic(z)
                for i in np.flatnonzero(p >= located).tolist():
                    k = int(s.row[i])
                    own = data[offsets[k] : s.end[i]]
                    begin = int(((own[: s.start[i] - offsets[k]] & 0xC0) != 0x80).sum())
                    length = int(((own[s.start[i] - offsets[k] :] & 0xC0) != 0x80).sum())
                    spans[first + k].append({"start": begin, "end": begin + length, "score": float(p[i])})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(scores), pa.array(spans, kind)], names=schema.names)

    return out.mapInArrow(run, schema)

"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A document is the average of learned vectors: one for each word and one for each of its character n-grams (over
Unicode code points, with marks at the word's ends), and one for each pair of neighbouring words, hashed into
`buckets` rows. A softmax layer on that average gives two class probabilities. As nothing between the vectors and the
layer is nonlinear, a fitted model folds into one number for each bucket, and scoring is a weighted sum; a document's
score is the softmax probability of class 1.

The fit uses at most `max_rows` labelled rows, those with the smallest hash of the id (the documented bound), in one
task; scoring reads every whole text and needs no shuffle. The folded model has a fixed size (4 bytes a bucket).

Nulls count as empty; a text without words gets the score of the bias alone. Repeated rows get the same score.
With no labelled rows, or rows of one class only, scores are the smoothed share of class 1. Labels that are null or
neither 0 nor 1 are left out, as are labels of ids without a document. Labels, ids, languages and sources never
enter a score.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeway.llm.common import released, texts

BUCKETS, DIM, EPOCHS, RATE, MAX_ROWS, NGRAMS, SEED = 1 << 17, 8, 4, 1.5, 12000, (3, 4, 5), 17
_MIX, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x100000001B3)
#: Code points that never occur in a text stand for the ends of a word.
_OPEN, _CLOSE = 0x110000, 0x110001
#: Words whose sums a worker keeps.
_KEPT = 400_000
#: Characters of texts that are cut into words at a time.
_CHARS = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def word_features(words: list[str], buckets: int = BUCKETS, ngrams: tuple[int, ...] = NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of some words: the word itself and its character n-grams."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(words) else 0
    points = np.zeros(total, np.uint64)
    inner = np.ones(total, bool)
    starts = ends - lengths
    inner[starts], inner[ends - 1] = False, False
    points[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    points[starts], points[ends - 1] = _OPEN, _CLOSE
    owner = np.repeat(np.arange(len(words)), lengths)
    # The whole word: a sum of position-dependent terms.
    place = np.arange(total) - starts[owner]
    terms = _mixed(points * _STEP + _mixed(place.astype(np.uint64) + np.uint64(1)))
    whole = np.add.reduceat(terms, starts) if total else np.zeros(0, np.uint64)
    owners, found = [np.arange(len(words))], [_mixed(whole)]
    mixed = _mixed(points + np.uint64(0x9E3779B97F4A7C15))
    for n in ngrams:
        if total < n:
            continue
        h = np.full(total - n + 1, n, np.uint64)
        for i in range(n):
            h = h * _STEP + mixed[i : total - n + 1 + i]
        same = owner[: total - n + 1] == owner[n - 1 :]
        owners.append(owner[: total - n + 1][same])
        found.append(_mixed(h[same]))
    return np.concatenate(owners), (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash of each word, as its first feature is made of."""
    owner, bucket = word_features(words, 1 << 62, ())
    return bucket.astype(np.uint64)


def pair_buckets(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each pair of neighbouring words, from the words' hashes in their order."""
    return (_mixed(hashes[:-1] * _STEP + _mixed(hashes[1:])) % np.uint64(buckets)).astype(np.int64)


def fit(docs: list[str], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, ngrams: tuple[int, ...] = NGRAMS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The folded model: a weight for each bucket and a bias."""
    labels = np.asarray(labels, np.int64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return np.zeros(buckets, np.float32), float(np.log(share / (1 - share)))
    rows = []
    for text in docs:
        words = text.split()
        if not words:
            rows.append((np.zeros(0, np.uint8), np.zeros(0, np.uint8)))
            continue
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        order = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        owner, bucket = word_features(list(number), buckets, ngrams)
        pairs = pair_buckets(word_hashes(list(number))[order], buckets)
        times = np.concatenate([np.bincount(order)[owner], np.ones(len(pairs), np.int64)])
        at, back = np.unique(np.concatenate([bucket, pairs]), return_inverse=True)
        counts = np.bincount(back, weights=times)
        # All rows stay in memory for the epochs: mostly three bytes a feature, as steps between buckets and counts.
        rows.append(tuple(x.astype(np.min_scalar_type(int(x.max()))) for x in (np.diff(at, prepend=0), counts)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer = np.zeros((dim, 2), np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            steps_of, counts = rows[i]
            step = rate * (1 - done / steps)
            done += 1
            if not counts.size:
                continue
            at = np.cumsum(steps_of, dtype=np.int64)
            weight = counts.astype(np.float32)
            weight /= weight.sum()
            hidden = weight @ vectors[at]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # gradient of the log loss
            back = layer @ p
            layer -= step * np.outer(hidden, p)
            bias -= step * 0.1 * p
            # An averaged feature gets its share of the gradient; scaled so that long texts learn as fast as short ones.
            vectors[at] -= (step * weight / weight.max())[:, None] * back[None, :]
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def _packed(weights: np.ndarray, bias: float) -> bytes:
    return struct.pack("<d", bias) + weights.astype("<f4").tobytes()


class Scorer:
    """Scores texts by a folded model; the sums of words it has met are kept."""

    def __init__(self, packed: bytes, ngrams: tuple[int, ...] = NGRAMS):
        self.bias = struct.unpack("<d", packed[:8])[0]
        self.weights = np.frombuffer(packed[8:], "<f4").astype(np.float64)
        self.ngrams = ngrams
        self.clear()

    def clear(self) -> None:
        """Forget the words met: their numbers and, by number, sums of weights, counts of features and hashes."""
        self.known: dict[str, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def learn(self, words: list[str]) -> None:
        owner, bucket = word_features(words, len(self.weights), self.ngrams)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.sums = np.concatenate([self.sums, np.bincount(owner, weights=self.weights[bucket], minlength=len(words))])
        self.counts = np.concatenate([self.counts, np.bincount(owner, minlength=len(words))])
        self.hashes = np.concatenate([self.hashes, word_hashes(words)])

    def logits(self, docs: list[str]) -> list[float]:
        out, some, size = [], [], 0
        for doc in docs:
            some.append(doc)
            size += len(doc)
            if size > _CHARS:
                out += self._logits(some)
                some, size = [], 0
        return out + self._logits(some)

    def _logits(self, docs: list[str]) -> list[float]:
        each = [x.split() for x in docs]
        if len(self.known) > _KEPT:
            self.clear()
        new = set().union(*each).difference(self.known) if each else set()
        if new:
            self.learn(sorted(new))
        out = []
        for words in each:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            pairs = pair_buckets(self.hashes[at], len(self.weights)) if len(at) else at
            n = int(self.counts[at].sum()) + len(pairs)
            out.append(self.bias + (float(self.sums[at].sum() + self.weights[pairs].sum()) / n if n else 0.0))
        return out


_scorers: dict[int, Scorer] = {}


def _score(batches: Iterator[pa.RecordBatch], model, ngrams: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    packed = model.value
    key = hash(packed)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(packed, ngrams)
    scorer = _scorers[key]
    for batch in batches:
        z = np.asarray(scorer.logits(batch.column("text").to_pylist()), np.float64)
        score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "score"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, buckets: int = BUCKETS, ngrams: tuple[int, ...] = NGRAMS):
    """Fit on at most max_rows labelled rows, chosen by a hash of the id, in one task; returns a broadcast of the folded model."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    # Ids first, so that only the chosen rows' texts are read into the join; labels without a document don't count
    # towards the bound, which stands behind the broadcast.
    held = docs.select(F.col(id_col).alias("doc_id"))
    chosen = known.join(held, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_rows)
    sample = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *frames]).sort_values(["doc_id", "text"])
        if len(frame):
            yield pd.DataFrame({"model": [_packed(*fit(frame["text"].tolist(), frame["label"].to_numpy(), buckets, ngrams=ngrams))]})

    got = sample.select("doc_id", "text", "label").repartition(1).mapInPandas(lambda it: released(kernel(it)), "model binary").collect()
    packed = bytes(got[0]["model"]) if got else _packed(np.zeros(buckets, np.float32), 0.0)
    return spark.sparkContext.broadcast(packed)


def score(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", ngrams: tuple[int, ...] = NGRAMS) -> DataFrame:
    """(doc_id, score) for each row of df."""
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: released(_score(it, model, ngrams)), f"doc_id {kind}, score double")


def held_out(id_col="doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): fitted on labelled rows that aren't held out, applied to all documents."""
    model = train(docs, labels.filter(~held_out()), max_rows=max_rows)
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without those that the classifier rejects; the scores stay beside the rows, so nothing is joined."""
    model = train(docs, labels.filter(~held_out()), max_rows=max_rows)
    schema = docs.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    at = schema.names.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            z = np.asarray(scorer.logits([x or "" for x in batch.column(at).to_pylist()]), np.float64)
            keep = 1 / (1 + np.exp(-np.clip(z, -500, 500))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lambda it: released(kernel(it)), fields)

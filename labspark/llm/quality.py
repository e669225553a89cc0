"""A supervised quality classifier on subword embeddings.

Words, pairs of neighbouring words and character n-grams are hashed to buckets. Each bucket has a learned vector; a
document is the mean of the vectors of all its features, and a softmax layer turns it into class probabilities. Numpy's
stochastic gradient descent trains both on a bounded sample. As the layer is linear, a document's score needs one number
for each bucket, and scoring whole texts is one pass of table look-ups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark.llm.common import stored, unused

BUCKET_BITS = 16
DIMENSIONS = 16
CHARACTERS = (3, 4)
#: Labelled rows of each class to train on, at most: those with the smallest hash of their identifier.
SAMPLE_ROWS = 1500
#: Features of those documents that reach the driver, 8 bytes each; half of them of each class.
SAMPLE_ENTRIES = 16_000_000
EPOCHS = 8
RATE = 0.5
THRESHOLD = 0.7
#: The bucket that every document has so many times: empty ones have a score too, and a few odd words decide little.
ALWAYS, TIMES = 0, 20
CHUNK_BYTES = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x5851F42D4C957F2D)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``STEP`` and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64) for x in (STEP, inverse))


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind)) * ODD
    mixed ^= mixed >> np.uint64(31)
    mixed *= STEP
    return 1 + (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) % ((1 << BUCKET_BITS) - 1)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the texts in order, a few at a time: buckets of features and the text each belongs to, in rising order.

    A pair of words is hashed by the difference of its words, so a word that follows itself is one feature whichever word
    it is. An n-gram has white space at its ends only.
    """
    group: list[bytes] = []
    first, size = 0, 0
    for i, text in enumerate(texts):
        group.append(text.encode("utf-8", "replace"))
        size += len(group[-1])
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield from _chunk_features(group, first)
            group, first, size = [], i + 1, 0


def _chunk_features(group: list[bytes], first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data = np.frombuffer(b"\n" + b"\n".join(group) + b"\n\n\n\n", np.uint8)
    owner_end = 1 + np.cumsum([len(g) + 1 for g in group])  # the first byte after each text and its line end

    def owner(at: np.ndarray) -> np.ndarray:
        return first + np.searchsorted(owner_end, at, "right")

    yield np.full(len(group) * TIMES, ALWAYS), first + np.repeat(np.arange(len(group)), TIMES)
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        power, back = _powers(len(data) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        words = (sums[ends] - sums[starts]) * back[starts]
        of = owner(starts)
        yield _bucket(words, 1), of
        together = of[1:] == of[:-1]
        yield _bucket((words[1:] - words[:-1])[together], 2), of[1:][together]
    codes = data.astype(np.uint64)
    for n in CHARACTERS:
        count = len(data) - n + 1
        inside = np.zeros(count, bool)
        gram = np.zeros(count, np.uint64)
        for k in range(n):
            gram |= codes[k : k + count] << np.uint64(8 * k)
            if 0 < k < n - 1:
                inside |= blank[k : k + count]
        at = np.flatnonzero(~inside & ~(blank[:count] & blank[n - 1 : n - 1 + count]))
        # An n-gram that begins with the line end before a text belongs to that text.
        yield _bucket(gram[at], 2 + n), owner(at + 1)


@dataclass
class Model:
    """``table[b]``: how far feature ``b`` moves the log odds of class 1."""

    table: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of class 1 for each text."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, of in features(texts):
            if not len(of):
                continue
            low, n = of[0], of[-1] - of[0] + 1
            total[low : low + n] += np.bincount(of - low, self.table[buckets], n)
            count[low : low + n] += np.bincount(of - low, minlength=n)
        odds = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text and their shares of its features."""
    parts = list(features(texts))
    buckets, of = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in (0, 1))
    both, counts = np.unique(of << BUCKET_BITS | buckets, return_counts=True)
    cut = np.searchsorted(both >> BUCKET_BITS, np.arange(1, len(texts)))
    out = zip(np.split(both & (1 << BUCKET_BITS) - 1, cut), np.split(counts, cut))
    return [(b.astype(np.int32), (c / c.sum()).astype(np.float32)) for b, c in out]


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model:
    """Vectors and softmax layer by stochastic gradient descent, one document at a time, with a falling rate."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    steps, done = EPOCHS * len(documents), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(documents)):
            rate = RATE * (1 - done / steps) * weights[i]
            done += 1
            buckets, shares = documents[i]
            rows = vectors[buckets]
            mean = shares @ rows
            odds = mean @ layer
            chance = np.exp(odds - odds.max())
            error = chance / chance.sum()
            error[labels[i]] -= 1
            pull = layer @ error
            layer -= rate * np.outer(mean, error).astype(np.float32)
            # The rate is that of the mean, as every feature gets the whole gradient of the document.
            vectors[buckets] = rows - rate * np.minimum(1, shares * len(buckets))[:, None] * pull
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    sample_entries: int = SAMPLE_ENTRIES,
) -> Model:
    """A model from the labels 0 and 1 of documents; other labels, null ones included, count for nothing.

    At most ``sample_rows`` labelled documents of each class are read, whole texts, and of these the driver gets as many as
    have half of ``sample_entries`` features together, 8 bytes each; a label weighs as much as all rows of its class. Of rows
    that share an identifier one is read. Without labels, or without documents that have one, as with empty tables, the model
    says 0.5 for every text. Texts may have any length: one has 65,536 features at most.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    totals = dict(known.groupBy("label").count().collect())
    order = F.xxhash64("id", F.lit("sample"))
    of_class = [known.where(F.col("label") == c).orderBy(order, "id").limit(sample_rows) for c in (0, 1)]
    chosen = of_class[0].unionByName(of_class[1])
    narrow = docs.select(F.col(id_column).alias("doc"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    met = narrow.join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    # Of documents that share an identifier, or a label that is given twice, one counts.
    texts = met.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                some = batch.slice(first, 64)
                found = bags(some.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": some.column("id").cast(pa.string()),
                        "label": some.column("label"),
                        "buckets": pa.array([b for b, _ in found], pa.list_(pa.int32())),
                        "shares": pa.array([s for _, s in found], pa.list_(pa.float32())),
                    }
                )

    bagged = stored(texts.mapInArrow(bag, "id string, label int, buckets array<int>, shares array<float>"), "bags")
    # What the driver gets is limited in bytes too, whatever the texts' lengths: rows in the order of the sample while they fit.
    sizes = bagged.select("id", "label", F.size("buckets").cast("bigint").alias("n"))
    along = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit("sample")), "id")
    fitting = sizes.withColumn("sum", F.sum("n").over(along)).where(F.col("sum") <= sample_entries // 2).select("id", "label")
    rows = bagged.join(F.broadcast(fitting), ["id", "label"]).toArrow()
    bags_of = [
        (b.values.to_numpy(), s.values.to_numpy()) for b, s in zip(rows.column("buckets"), rows.column("shares"))
    ]
    found = rows.column("label").to_numpy()
    # The same order whatever task came first.
    names = rows.column("id").to_pylist()
    place = sorted(range(len(found)), key=lambda i: (names[i], found[i], zlib.crc32(bags_of[i][0]), zlib.crc32(bags_of[i][1])))
    found = found[place]
    all_rows = sum(totals.values())
    share = {c: totals.get(c, 0) / all_rows / max(1, (found == c).sum()) * len(found) for c in (0, 1)} if all_rows else {}
    weights = np.array([share[c] for c in found.tolist()], np.float32)
    model = train([bags_of[i] for i in place], found, weights)
    # The features are not needed any more; Arrow gives their memory back only when asked to.
    del rows, bags_of
    pa.default_memory_pool().release_unused()
    return model


def held_out(id_column: str) -> Column:
    """Whether a document is kept from training: the checksum of its identifier leaves 2 when divided by 4. Null never is."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4)) == 2, F.lit(False))


def score(model: Model, text_column: str = "text") -> Column:
    """The model's score of a text, from 0 to 1; a null text is empty."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        parts = (texts.iloc[i : i + 256].tolist() for i in range(0, len(texts), 256))
        return pd.Series(np.concatenate([model.score(p) for p in parts] or [np.empty(0)]))

    return of(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


def drop_low_quality(
    docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns. Repeated rows are judged alike."""
    name = unused("_score", docs)
    return docs.withColumn(name, score(model, text_column)).where(F.col(name) >= threshold).drop(name)

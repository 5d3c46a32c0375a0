"""Operator 5: quality classifier from supervised subword embeddings.

A document is the mean of learned vectors of its words and of the character n-grams of its words,
and of pseudo-words that mark repetition, all hashed into `buckets`; a softmax layer gives the probability of label 1. Vectors and layer are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows, taken evenly
from both labels (`sample_rows` in all, the lowest hashes of the id), and the share of the labels among
all training rows is put back into the bias. Whole texts are used, in training and in scoring.

Since layer and mean are linear, a feature adds one number to a document's score, so executors get
one float per bucket. Texts are hashed in numpy about a megabyte at a time.

Results: null, empty and wordless texts get the share of label 1 as score. Without labels of both
kinds every document gets that share (0.5 without labels). Ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import U64, ascii_words, crc_mod, forget, give_back, keep_rows, load, map_batches, mix, shared_table, word_hashes, word_pieces
from tracelode.llm.quality_rules import repeated_words

BUCKETS = 1 << 17
NGRAMS = (3, 4, 5)
SAMPLE_ROWS = 6_000
#: Features of the sample that are held at once, 8 bytes each.
SAMPLE_FEATURES = 30_000_000
#: Bucket numbers of the pseudo-words.
SAME, OTHER, AGAIN, ONCE = 11, 12, 13, 14


def subwords(texts: list[list[bytes]], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number, bucket) of every word and of every character n-gram of the given word lists.

    A word is taken with a blank before and after it, so n-grams know where words begin and end.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = [w for text in texts for w in text]
    if not words:
        return
    doc_of_word = np.repeat(np.arange(len(texts)), sizes)
    mask = U64(buckets - 1)
    hashes = word_hashes(words)
    yield doc_of_word, (hashes & mask).astype(np.int64)
    # Pseudo-words for what hashing hides: a word like the one before it, a word of a repeated passage.
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])])
    again = repeated_words(hashes, sizes)
    times = np.stack([again, sizes - again], axis=1).ravel()
    yield doc_of_word, np.where(same, SAME % buckets, OTHER % buckets)
    pair = np.tile([AGAIN % buckets, ONCE % buckets], len(texts))
    yield np.repeat(np.arange(len(texts)), 2).repeat(times), pair.repeat(times)
    # Two blanks between words: an n-gram that touches two words has a blank inside.
    buf = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    doc = np.repeat(doc_of_word, length)
    blank = np.concatenate([[0], np.cumsum(buf == 32)])
    h = buf.astype(np.uint64)
    for n in range(2, max(NGRAMS) + 1):
        if len(buf) < n:
            return
        h = h[:-1] * U64(0x100000001B3) + buf[n - 1 :]
        if n in NGRAMS:
            inner = blank[n - 1 : len(buf)] - blank[1 : len(buf) - n + 2]
            at = np.flatnonzero(inner == 0)
            yield doc[at], (mix(h[at] + U64(n)) & mask).astype(np.int64)


@dataclass
class Model:
    weight: np.ndarray
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float, buckets: int = BUCKETS, dim: int = 8,
    epochs: int = 12, rate: float = 1.0, seed: int = 7,
) -> Model:
    """SGD over (buckets, counts, label) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer = rng.uniform(-1, 1, (2, dim)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    steps, done = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, counts, label = rows[k]
            share = counts / max(1.0, counts.sum())
            hidden = share @ vectors[ids]
            out = layer @ hidden + offset
            error = np.exp(out - out.max())
            error /= error.sum()
            error[label] -= 1
            lr = np.float32(rate * (1 - done / steps))
            back = error @ layer
            layer -= lr * np.outer(error, hidden)
            offset -= lr * error
            # The mean hides how few documents have a feature; its square root evens that out.
            vectors[ids] -= lr * np.sqrt(share)[:, None] * back
            done += 1
    weight = vectors @ (layer[1] - layer[0])
    return Model(weight.astype(np.float32), float(offset[1] - offset[0]) + float(np.log(prior / (1 - prior))))


def labelled_sample(labels: DataFrame, label: str, fits: Column, rows: int) -> tuple[DataFrame, float]:
    """Ids and labels of `rows` training rows, half of either label where there are enough, and the
    share of label 1 among all training rows."""
    usable = labels.where(fits & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = [usable.where(F.col("label") == v).orderBy(*order).limit(rows // 2) for v in (0, 1)]
    return taken[0].union(taken[1]), share


BAG = pa.schema([("label", pa.int32()), ("turn", pa.int64()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])
WEIGHTS = pa.schema([("weight", pa.binary()), ("bias", pa.float64())])


def bags(docs: DataFrame, sample: DataFrame, buckets: int) -> DataFrame:
    """(label, turn, ids, counts): features of the sampled rows; `turn` is a hash of the id."""

    def start():
        def work(batch: pa.RecordBatch):
            texts = [ascii_words(t) for t in batch.column(0).to_pylist()]
            for text, label, turn in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = [b for _, b in subwords([text], buckets)]
                ids, counts = np.unique(np.concatenate(found or [np.empty(0, np.int64)]), return_counts=True)
                yield {"label": [label], "turn": [turn], "ids": [ids.astype(np.int32)], "counts": [counts.astype(np.float32)]}

        return work

    # The sample is bounded by its row count, so every task may have it.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", F.xxhash64("doc_id").alias("turn"))
    return map_batches(rows, start, BAG, "label int, turn long, ids array<int>, counts array<float>")


def fit(
    docs: DataFrame, labels: DataFrame, fits: Column, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS,
    features: int = SAMPLE_FEATURES,
) -> Model:
    """Train on a sample of at most `sample_rows` labelled rows and `features` features, taken in the order of a hash.

    Training is one executor task over the bags in the shared folder; only the weights come to the driver.
    """
    sample, share = labelled_sample(labels, "quality", fits, sample_rows)
    stored = shared_table(bags(docs, sample, buckets), "quality-bags")

    def learn(batches):
        rows, held = [], 0
        for batch in batches:
            if held > features:
                continue  # the rest is read, but not held
            for k, label in enumerate(batch.column(0).to_pylist()):
                ids, counts = (batch.column(c)[k].values.to_numpy() for c in (2, 3))  # views of the batch
                if held <= features:
                    rows.append((ids, counts, label))
                    held += len(ids)
        rows.sort(key=lambda r: (r[2], len(r[0]), float(r[1].sum()), r[0][:64].tobytes()))
        if len({y for _, _, y in rows}) < 2:
            model = Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
        else:
            model = train(rows, share, buckets)
        rows.clear()
        batch = None
        give_back()
        yield pa.RecordBatch.from_pydict({"weight": [model.weight.tobytes()], "bias": [model.bias]}, schema=WEIGHTS)

    one = stored.coalesce(1).sortWithinPartitions("turn", "label").mapInArrow(learn, "weight binary, bias double").collect()
    forget(stored)
    if not one:
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
    return Model(np.frombuffer(one[0]["weight"], np.float32), one[0]["bias"])


SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from its whole text."""

    def start():
        return lambda batch: iter([{"doc_id": batch.column(0), "score": probabilities(batch.column(1), model)}])

    return map_batches(docs.select("doc_id", "text"), start, SCORE, "doc_id long, score double")


def probabilities(column: pa.Array, model: Model) -> np.ndarray:
    """Score of every text of a column."""
    texts = [ascii_words(t) for t in column.to_pylist()]
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for a, b in word_pieces(texts):
        for doc, bucket in subwords(texts[a:b], len(model.weight)):
            total[a:b] += np.bincount(doc, weights=model.weight[bucket], minlength=b - a)
            n[a:b] += np.bincount(doc, minlength=b - a)
    return np.round(_sigmoid(total / np.maximum(n, 1) + model.bias), 9)


def good_documents(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of `docs` that score `least` or more, with all their columns.

    A null or empty text has no features and scores by the share of good documents alone; texts of any length are scored
    whole, repeated rows each for itself, rows without an id like others. An empty table gives no rows.
    """
    return keep_rows(docs, lambda: lambda batch: probabilities(batch.column("text"), model) >= least)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 3) == 1
    model = fit(docs, labels, ~held)
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

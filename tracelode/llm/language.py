"""Operator 10: language identification by prediction by partial matching.

Each language has a tree of byte contexts, from the empty one to `ORDER` bytes, with the counts of the
bytes that followed. A byte costs the code length under its longest known context; where it never
followed, an escape is paid and the context shortened (method C: a context with n bytes of t kinds
escapes with t / (n + t)), down to eight bits for a byte never seen. Statistics are frozen after training,
so the length of a text is a plain sum; the language with the shortest code wins, and the score is its
posterior with even priors over all bytes.

A word is coded with the blank before it as first context and the blank after it as last byte, contexts
do not reach beyond. So code lengths belong to words; they are computed once per distinct word in a task.

Counts come from all training documents: tasks count words, take the words apart into contexts, and
only summed contexts are shuffled. Trees keep every (context, byte) pair of every language. They are gathered on the
driver and sent to executors, so their memory grows with the number of distinct pairs.

Results: null texts and texts without a letter are `und` with score 0, as is everything without training
documents. Ties go to the first language in order. Ids may be null or repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import U64, Ids, crc_mod, forget, load, map_batches, shared_table, utf8, word_pieces

ORDER = 4
#: Words that are taken apart at a time.
WORDS = 30_000
_LETTER = regex.compile(r"\p{L}")


def context_keys(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of all bytes to code, the word each belongs to and per order 0 to ORDER a key of the context's last
    `order` bytes with the byte itself; 0 where the context would begin before the word.

    A key holds the bytes and, above them, the order plus one, so keys of all orders differ.
    """
    buf = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(length) - length
    place = np.arange(len(buf)) - np.repeat(starts, length)
    word = np.repeat(np.arange(len(words)), length)
    coded = np.flatnonzero(place > 0)
    keys, value = [], np.zeros(len(coded), np.uint64)
    for order in range(ORDER + 1):
        known = place[coded] >= order
        value = value | np.where(known, buf[np.maximum(coded - order, 0)] << U64(8 * order), U64(0))
        keys.append(np.where(known, value | (U64(order + 1) << U64(48)), U64(0)))
    return word[coded], keys


COUNT = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])


def context_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) summed over all rows of `docs`(lang, text)."""

    def start():
        def work(batch: pa.RecordBatch):
            words: dict[str, dict[bytes, int]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = words.setdefault(lang, {})
                for w in utf8(text).split():
                    counts[w] = counts.get(w, 0) + 1
            for lang, counts in words.items():
                key, n = np.empty(0, np.uint64), np.empty(0)
                known, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                for at in range(0, len(known), WORDS):
                    word, keys = context_keys(known[at : at + WORDS])
                    weight = times[at : at + WORDS][word]
                    for found in keys:
                        some = found > 0
                        key, where = np.unique(np.concatenate([key, found[some]]), return_inverse=True)
                        n = np.bincount(where, weights=np.concatenate([n, weight[some]]))
                if len(key):
                    yield {"lang": [lang] * len(key), "key": key.view(np.int64), "n": n.astype(np.int64)}

        return work

    counted = map_batches(docs.select("lang", "text"), start, COUNT, "lang string, key long, n long", 16 << 20)
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """Code lengths in bits: `cost[i]` of the pair `keys[i]` in every language with all escapes paid, and
    `escape[i]` of leaving the context `contexts[i]`, 0 in a language that never saw it."""

    langs: list[str]
    keys: np.ndarray
    cost: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Code length of every word in every language."""
        parts = [self._lengths(words[at : at + WORDS]) for at in range(0, len(words), WORDS)]
        return np.concatenate([np.zeros((0, len(self.langs))), *parts])

    def _lengths(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        word, keys = context_keys(words)
        bits = np.full((len(word), len(self.langs)), np.nan, np.float32)
        paid = np.zeros_like(bits)
        open_ = np.arange(len(word))
        for order in range(ORDER, -1, -1):
            key = keys[order][open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            bits[open_[hit]] = paid[open_[hit]] + self.cost[at[hit]]
            missed = open_[~hit]
            context = keys[order][missed] & ~U64(255)
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            known = (self.contexts[at] == context) & (context > 0)
            paid[missed[known]] += self.escape[at[known]]
            open_ = missed
        bits[open_] = paid[open_] + 8.0
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(word, weights=bits[:, k], minlength=len(words))
        return out


def grow(langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray) -> Trees:
    """Trees from counts: language number, key (uint64) and count of each pair."""
    keys = np.unique(key)
    counts = np.zeros((len(keys), len(langs)))
    np.add.at(counts, (np.searchsorted(keys, key), lang), n)
    context_of = keys & ~U64(255)
    contexts, where = np.unique(context_of, return_inverse=True)
    total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
    np.add.at(total, where, counts)
    np.add.at(kinds, where, counts > 0)
    escape = np.where(total > 0, -np.log2(np.where(total > 0, kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
    cost = np.zeros_like(counts)
    order = (keys >> U64(48)).astype(np.int64) - 1
    for o in range(ORDER + 1):
        here = np.flatnonzero(order == o)
        if o == 0:
            lower = np.full((len(here), len(langs)), 8.0)
        else:
            short = (keys[here] & ((U64(1) << U64(8 * o)) - U64(1))) | (U64(o) << U64(48))
            at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
            lower = np.where((keys[at] == short)[:, None], cost[at], 8.0)
        seen = counts[here]
        direct = -np.log2(np.maximum(seen, 1) / np.maximum(total[where[here]] + kinds[where[here]], 1))
        cost[here] = np.where(seen > 0, direct, escape[where[here]] + lower)
    return Trees(langs, keys, cost.astype(np.float32), contexts, escape.astype(np.float32))


def train(docs: DataFrame, fits: Column) -> Trees | None:
    """Trees of all languages from the rows of `docs` that `fits`; None without any."""
    usable = docs.where(fits & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = shared_table(context_counts(usable), "language-counts")
    table = counted.select("key", "lang", "n").toArrow()
    forget(counted)
    langs = sorted(set(table["lang"].to_pylist()))
    if not langs:
        return None
    number = {x: k for k, x in enumerate(langs)}
    lang = np.array([number[x] for x in table["lang"].to_pylist()])
    return grow(langs, lang, table["key"].to_numpy().view(np.uint64), table["n"].to_numpy())


GUESS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


class _Known:
    """Words of a task and their code lengths."""

    def __init__(self, trees: Trees) -> None:
        self.trees, self.ids = trees, Ids(300_000)
        self.lengths = np.zeros((0, len(trees.langs)), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words in `lengths`."""
        if self.ids.full:
            self.ids.clear()
            self.lengths = self.lengths[:0]
        numbers = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        before = len(self.lengths)
        if len(self.ids) > before:
            fresh = self.trees.lengths(self.ids.since(before)).astype(np.float32)
            self.lengths = np.concatenate([self.lengths, fresh])
        return numbers


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row of `docs`(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def start():
        trees = sent.value
        known = _Known(trees) if trees else None

        def work(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            guess, score = ["und"] * len(texts), [0.0] * len(texts)
            lists = [utf8(t).split() for t in texts] if known else []
            for a, b in word_pieces(lists):
                words = [w for t in lists[a:b] for w in t]
                numbers = known.of(words)
                ends = np.cumsum([len(t) for t in lists[a:b]])
                sums = np.zeros((len(words) + 1, len(trees.langs)))
                np.cumsum(known.lengths[numbers], axis=0, out=sums[1:], dtype=np.float64)
                bits = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
                best = bits.argmin(axis=1)
                odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                for k in range(a, b):
                    if texts[k] and _LETTER.search(texts[k]):
                        guess[k], score[k] = trees.langs[best[k - a]], float(1 / odds[k - a])
            yield {"doc_id": batch.column(0), "lang_pred": guess, "score": score}

        return work

    return map_batches(docs.select("doc_id", "text"), start, GUESS, "doc_id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    return identify(docs, train(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")

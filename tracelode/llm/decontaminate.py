"""Operator 1: benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if it contains a passage within edit distance k of the
item, k being `rate` of the item's characters, both lower-cased and with white space runs as one
blank. An item is cut into k + 1 pieces; k edits cannot touch all of them, so every such passage has
a piece unchanged. An automaton over all pieces finds these in one pass of the text. A hit is checked
upwards through a binary tree over the pieces: a range of p pieces may have p - 1 edits, and a passage
within budget has a piece all of whose ranges keep theirs. So a chance hit costs one comparison of two
pieces, and only what is left is compared as a whole. Distances are computed by Myers' bit-parallel
method, a column of the table being one Python integer.

Items are taken in blocks of `BLOCK_CHARS` characters; each block goes over all documents, so what a task
holds is bounded however many items there are.

Results: one row per document and item found in it (doc_id, item_id, distance, length of the item, start
and end of the nearest passage in the normalised text); clean documents have none. Null, empty and too short
(`LEAST` characters) items are not looked for; null and empty texts contain none. Repeated rows give
repeated results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import keep_rows, load, map_batches, shared_table

RATE = 0.1
LEAST = 24
BLOCK_CHARS = 2 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def masks(pattern: str) -> dict[str, int]:
    """Bit i of a character's mask is set where the pattern has it at place i."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def nearest(peq: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of `text` nearest to a pattern of `m` characters with masks `peq`,
    the first of equally near ones; None if none is within `k`."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, k + 1, -1
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph <<= 1
        pv = full & ((mh << 1) | ~(xv | ph))
        mv = ph & xv & full
    return (best, at) if at >= 0 else None


class Item:
    """A test item, its pieces, and the ranges of pieces that contain each one."""

    def __init__(self, item_id: int, text: str, rate: float) -> None:
        self.item_id, self.text = item_id, text
        self.k = int(len(text) * rate)
        n = self.k + 1
        self.cuts = [len(text) * i // n for i in range(n + 1)]
        self.above: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        stack = [(0, n)]
        while stack:
            low, high = stack.pop()
            if high - low > 1:
                for i in range(low, high):
                    self.above[i].insert(0, (low, high))
                middle = (low + high) // 2
                stack += [(low, middle), (middle, high)]
        self.peq: dict[tuple[int, int], dict[str, int]] = {}
        self.backward = masks(text[::-1])

    def pieces(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.cuts, self.cuts[1:])]

    def check(self, text: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the passage around `piece` found at `at`, if within budget."""
        got, first = (0, 0), at
        for low, high in self.above[piece]:
            a, b, k = self.cuts[low], self.cuts[high], high - low - 1
            if (low, high) not in self.peq:
                self.peq[low, high] = masks(self.text[a:b])
            first = max(0, at - (self.cuts[piece] - a) - k)
            got = nearest(self.peq[low, high], b - a, text[first : at + b - self.cuts[piece] + k], k)
            if got is None:
                return None
        if not self.above[piece]:
            return 0, at, at + len(self.text)
        distance, end = got[0], first + got[1]
        back = nearest(self.backward, len(self.text), text[max(0, end - len(self.text) - self.k) : end][::-1], self.k)
        return distance, end - (back[1] if back else len(self.text)), end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [Item(i, t, rate) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, item in enumerate(self.items):
            for p, piece in enumerate(item.pieces()):
                where[piece].append((n, p))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item number -> (distance, start, end) of its nearest passage in a normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        if not self.items or not text:
            return best
        for end, (size, places) in self.automaton.iter(text):
            for n, piece in places:
                at = end + 1 - size
                if n in best and (best[n][0] == 0 or best[n][1] <= at < best[n][2]):
                    continue
                got = self.items[n].check(text, piece, at)
                if got and (n not in best or got < best[n]):
                    best[n] = got
        return best


HIT = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("item_chars", pa.int64()),
    ("start", pa.int64()), ("end", pa.int64()),
])


def _hits(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def start():
        matcher = Matcher(sent.value, rate)

        def work(batch: pa.RecordBatch):
            out: dict[str, list] = {name: [] for name in HIT.names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (distance, begin, end) in matcher.find(normal(text)).items():
                    item = matcher.items[n]
                    for name, value in zip(HIT.names, (doc, item.item_id, distance, len(item.text), begin, end), strict=True):
                        out[name].append(value)
            yield out

        return work

    return map_batches(docs.select("doc_id", "text"), start, HIT, "doc_id long, item_id long, distance long, item_chars long, start long, end long")


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, a bounded number of characters at a time."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield sorted((r["item_id"], t) for r in block if len(t := normal(r["text"])) >= LEAST)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Documents that contain an item of `benchmark`(item_id, text), with the item and the passage."""
    found = None
    for items in _blocks(benchmark):
        hits = shared_table(_hits(docs, items, rate), "contaminated")
        found = hits if found is None else found.union(hits)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows of `docs` that contain no item of `benchmark`, with all their columns."""
    for items in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def start(sent=sent):
            matcher = Matcher(sent.value, rate)
            return lambda batch: [not matcher.find(normal(t)) for t in batch.column("text").to_pylist()]

        docs = keep_rows(docs, start)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))

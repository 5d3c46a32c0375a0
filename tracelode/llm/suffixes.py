"""Operator 2: long repeated byte strings by a logarithmic family of sparse suffix arrays.

A string of `MATCH` bytes is removed wherever it starts more than once. Suffixes are sampled: of the
`MATCH - GRAM + 1` grams of `GRAM` bytes inside such a string, the one with the smallest hash is its
anchor. The choice depends on the string alone, so equal strings have their anchor at the same place,
and it is enough to keep suffixes that start at anchors, about one in 170. A suffix array is a
table of pointers (gram hash, row, place) sorted by the gram hash and the pointer: its order is that of
a fingerprint of the first `GRAM` bytes, since only equality of long prefixes matters.

Documents come in batches. Each batch gets a suffix array, is merge-scanned with the arrays of all levels
for grams that also occur there (or twice in the batch), and becomes a level; two levels of equal rank
are merged into one of the next rank. Scans compare distinct grams, merges split a gram that very many
rows share by its pointers.

The suffixes whose gram occurs twice are then compared beyond the gram. Around each, the bytes of the strings that have
this anchor are its context; every string has one anchor (of equal least grams the first), so it is in one context only. Equal contexts repeat as a whole. Of different contexts
around one gram each is kept once, and the hashes of the strings at all places of the anchor are compared.
A gram with more than `LARGE` contexts is first divided: strings that begin in one of `STRIPES` ranges share
all bytes but those of the range, so only contexts that agree in these bytes need to meet.

All this holds for words as it does for bytes: `WORDS` takes a text as the sequence of its words, by their
64-bit hashes, and finds passages of over 50 of them however many bytes these are and whatever white space is
between. What is called a byte or a string above is a word or a passage there.

Results: one row per input row; rows with null or short texts remove nothing. Repeated rows are
documents of their own, so their long texts are removed everywhere. Ids may be null or repeat.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import U64, forget, give_back, load, map_batches, mix, pieces, shared_table, text_slices, utf8, word_hashes

MATCH, GRAM = 400, 64
#: Contexts of one gram that are compared together, and into how many ranges of beginnings more are divided.
LARGE, STRIPES = 12_000, 8
#: Text bytes of a batch, and the number of batches of one build at most.
BATCH_BYTES, BATCHES = 512 << 20, 16

#: Hashes of strings that are sorted in one go.
FLAT = 2 << 20

_BASE = pow(0x9E3779B97F4A7C15, 1, 2**64)
_BYTE = np.random.default_rng(400).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass(frozen=True)
class Unit:
    """What texts are taken apart into: a string of `match` of them is sought by grams of `gram`."""

    match: int
    gram: int
    words: bool = False

    @property
    def reach(self) -> int:
        return self.match - self.gram

    @property
    def least_bytes(self) -> int:
        """Bytes of the shortest text that can hold a string of `match` units."""
        return 2 * self.match - 1 if self.words else self.match

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, bytes or hashes of words, and how many each text has."""
        if not self.words:
            return np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        lists = [t.split() for t in texts]
        return word_hashes([w for t in lists for w in t]), np.fromiter(map(len, lists), np.int64, len(lists))


BYTES = Unit(MATCH, GRAM)
#: "Over 50 words"; grams of 8 words keep as many suffixes a byte as those of `BYTES` do.
WORDS = Unit(51, 8, words=True)


def _values(buf: np.ndarray) -> np.ndarray:
    """A 64-bit value per unit."""
    return _BYTE[buf] if buf.dtype == np.uint8 else buf


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums for hashes of any stretch of `buf`, and the powers that take out where it begins."""
    up, down = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_values(buf) * up[:-1], out=sums[1:])
    return sums, down


def rolling(buf: np.ndarray, n: int) -> np.ndarray:
    """Hash of the `n` units from every place on."""
    if len(buf) < n:
        return np.empty(0, np.uint64)
    sums, down = _sums(buf)
    return mix((sums[n:] - sums[:-n]) * down[: len(buf) - n + 1])


def _sliding(x: np.ndarray, n: int, best: np.ufunc, rest: int) -> np.ndarray:
    """best(x[i], ..., x[i + n - 1]) for every i; missing values are `rest`."""
    blocks = -(-(len(x) + n) // n)
    padded = np.full(blocks * n, rest, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(blocks, n)
    ahead = best.accumulate(table, axis=1).ravel()
    back = best.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: len(x)], ahead[n - 1 : n - 1 + len(x)])


def anchors(
    buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: Unit
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all anchors in `buf`, which holds documents at [start, end), their gram hashes, and how far the
    strings that have this anchor reach to the left of the gram and to the right of it."""
    grams = rolling(buf, unit.gram)
    if len(buf) < unit.match:
        none = np.empty(0, np.int64)
        return none, grams[:0], none, none
    least = _sliding(grams, unit.reach + 1, np.minimum, 2**64 - 1)[: len(buf) - unit.match + 1]
    inside = np.zeros(len(buf) + 1, np.int32)
    long = ends - starts >= unit.match
    inside[starts[long]] += 1
    np.add.at(inside, ends[long] - unit.match + 1, -1)
    least = np.where(np.cumsum(inside)[: len(least)] > 0, least, U64(0))
    # Strings of one anchor begin one after the other. Of equal least grams the first one counts; it leaves with its place.
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(least)) - 1
    low, high = low[least[low] != 0], high[least[low] != 0]
    at, f = high.copy(), least[high]
    later = np.flatnonzero(grams[high] != f)  # these ended because a lesser gram or the end of the text came
    for k in range(0, len(later), 4_096):
        some = later[k : k + 4_096]
        ahead = np.minimum(high[some, None] + np.arange(unit.reach + 1), len(grams) - 1)
        at[some] += np.argmax(grams[ahead] == f[some, None], axis=1)
    return at, f, at - low, high + unit.reach - at


def _span_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def row_key():
    """The key of a document while its repeated strings are sought; rows with equal id and text share it."""
    return F.xxhash64("doc_id", "text")


SUFFIX = pa.schema([
    ("f", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("right", pa.int32()),
    ("batch", pa.int32()),
])


def suffix_arrays(docs: DataFrame, batches: int, unit: Unit) -> DataFrame:
    """Pointers (f, row, at, left, right) to all sampled suffixes, in runs sorted by `f`, with the batch they belong to."""

    def start():
        from pyspark import TaskContext

        batch_of_task = TaskContext.get().partitionId() % batches

        def work(batch: pa.RecordBatch):
            rows = batch.column(0).to_numpy()
            texts = [utf8(t) for t in batch.column(1).to_pylist()]
            for a, b in pieces(texts):
                buf, sizes = unit.read(texts[a:b])
                ends = np.cumsum(sizes)
                starts = np.concatenate([[0], ends[:-1]])
                at, f, left, right = anchors(buf, starts, ends, unit)
                doc = np.searchsorted(ends, at, "right")
                order = np.argsort(f, kind="stable")
                yield {
                    "f": f[order].view(np.int64), "row": rows[a:b][doc[order]],
                    "at": (at - starts[doc])[order].astype(np.int32), "left": left[order].astype(np.int32),
                    "right": right[order].astype(np.int32), "batch": np.full(len(at), batch_of_task, np.int32),
                }

        return work

    rows = docs.where(F.octet_length("text") >= unit.least_bytes).select(row_key().alias("row"), "text")
    return map_batches(rows, start, SUFFIX, "f long, row long, at int, left int, right int, batch int")


class SuffixIndex:
    """The family of suffix arrays; `repeats` collects grams that were found twice."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}
        self.repeats: list[DataFrame] = []

    def insert(self, array: DataFrame) -> None:
        """Scan the levels with a batch's suffix array (f, row, at, left, right) and make it a level."""
        grams = array.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
        found = grams.where("n > 1").select("f")
        for level in self.levels.values():
            found = found.union(level.select("f").distinct().join(grams.select("f"), "f", "left_semi"))
        self.repeats.append(shared_table(found.distinct(), "suffix-repeats"))
        rank = 0
        while rank in self.levels:
            other = self.levels.pop(rank)
            array = self._merged(array, other)
            rank += 1
        self.levels[rank] = array

    def _merged(self, one: DataFrame, two: DataFrame) -> DataFrame:
        both = one.union(two)
        merged = shared_table(both.repartitionByRange("f", "row").sortWithinPartitions("f", "row", "at"), "suffix-level")
        forget(one)
        forget(two)
        return merged

    def candidates(self) -> DataFrame:
        """Pointers to suffixes whose gram occurs twice."""
        repeats = self.repeats[0]
        for more in self.repeats[1:]:
            repeats = repeats.union(more)
        pointers = None
        for level in self.levels.values():
            pointers = level if pointers is None else pointers.union(level)
        return pointers.join(repeats.distinct(), "f")


#: kind 0: a place (f, c, row, at). kind 1: a context (f, c, n, left, right, bytes), once per batch of rows.
CONTEXT = pa.schema([
    ("kind", pa.int32()), ("f", pa.int64()), ("c", pa.int64()), ("row", pa.int64()), ("at", pa.int32()),
    ("n", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("bytes", pa.binary()),
])


def contexts(docs: DataFrame, candidates: DataFrame, unit: Unit) -> DataFrame:
    """Places of candidate suffixes and the contexts around them."""
    of_row = candidates.groupBy("row").agg(F.collect_list(F.struct("at", "f", "left", "right")).alias("found"))
    rows = docs.where(F.octet_length("text") >= unit.least_bytes).select(row_key().alias("row"), "text")
    joined = rows.join(of_row, "row").select("row", "text", *[F.col(f"found.{x}").alias(x) for x in ("at", "f", "left", "right")])

    def start():
        def work(batch: pa.RecordBatch):
            rows = batch.column(0).to_numpy()
            texts = [utf8(t) for t in batch.column(1).to_pylist()]
            places = batch.column(2)
            for a, b in pieces(texts):
                buf, sizes = unit.read(texts[a:b])
                ends = np.cumsum(sizes)
                starts = np.concatenate([[0], ends[:-1]])
                raw, size_of = buf.tobytes(), buf.itemsize
                size = [len(places[k]) for k in range(a, b)]
                at, f, left, right = (batch.column(k).slice(a, b - a).flatten().to_numpy() for k in (2, 3, 4, 5))
                at = at.astype(np.int64)
                doc = np.repeat(np.arange(b - a), size)
                fits = at + starts[doc] + unit.gram <= len(buf)
                at, f, doc, left, right = (x[fits] for x in (at, f, doc, left, right))
                here = rolling(buf, unit.gram)[at + starts[doc]].view(np.int64) == f  # else another row with the same key
                at, f, doc, left, right = (x[here] for x in (at, f, doc, left, right))
                if not len(at):
                    continue
                place = at + starts[doc]
                begin, end = np.maximum(starts[doc], place - left), np.minimum(ends[doc], place + unit.gram + right)
                sums, down = _sums(buf)
                c = mix(_span_hash(sums, down, begin, end) + U64(7) * (place - begin).astype(np.uint64)).view(np.int64)
                none = np.zeros(len(at), np.int32)
                yield {
                    "kind": none, "f": f, "c": c, "row": rows[a:b][doc], "at": at.astype(np.int32), "n": none.astype(np.int64),
                    "left": none, "right": none, "bytes": pa.nulls(len(at), pa.binary()),
                }
                _, first, n = np.unique(mix(f.view(np.uint64) ^ mix(c.view(np.uint64))), return_index=True, return_counts=True)
                order = np.argsort(first)
                first, n = first[order], n[order]  # neighbours in a text compress well
                yield {
                    "kind": np.ones(len(first), np.int32), "f": f[first], "c": c[first], "row": rows[a:b][doc[first]],
                    "at": at[first].astype(np.int32), "n": n.astype(np.int64),
                    "left": (place - begin)[first].astype(np.int32), "right": (end - place)[first].astype(np.int32) - unit.gram,
                    "bytes": [raw[x:y] for x, y in zip((begin[first] * size_of).tolist(), (end[first] * size_of).tolist(), strict=True)],
                }

        return work

    ddl = "kind int, f long, c long, row long, at int, n long, left int, right int, bytes binary"
    return map_batches(joined, start, CONTEXT, ddl)


#: What of a context repeats: ranges of units relative to the gram.
RANGE = pa.schema([("f", pa.int64()), ("c", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _joined(table: pa.Table, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """The units of all contexts one after the other, and where each begins."""
    data = table["bytes"].combine_chunks()
    sizes = pc.binary_length(data).to_numpy().astype(np.int64) // (8 if unit.words else 1)
    return np.frombuffer(b"".join(data.to_pylist()), np.uint64 if unit.words else np.uint8), np.cumsum(sizes) - sizes


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Compared:
    """Contexts of whole groups of one key, kept as 8-byte hashes of their strings."""

    def __init__(self, unit: Unit) -> None:
        self.unit, self.parts, self.rows = unit, [], 0

    def add(self, table: pa.Table) -> None:
        """Contexts (key, f, c, left, right, bytes)."""
        unit = self.unit
        buf, base = _joined(table, unit)
        left, right = table["left"].to_numpy().astype(np.int64), table["right"].to_numpy().astype(np.int64)
        sizes = np.maximum(left + right - unit.reach + 1, 0)
        offset = _counted(sizes)
        hashes = rolling(buf, unit.match)[np.repeat(base, sizes) + offset]
        offset -= np.repeat(left, sizes)
        key = np.repeat(mix(table["key"].to_numpy().view(np.uint64)) * U64(3), sizes)
        value = mix(hashes + key + offset.astype(np.uint64) * U64(0x2545F4914F6CDD1D))
        self.parts.append((table["f"].to_numpy(), table["c"].to_numpy(), left, sizes, value))
        self.rows += len(left)

    def ranges(self) -> dict:
        """Ranges of the contexts that another context with the same key has too; empties this."""
        f, c, left, sizes, value = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.rows = [], 0
        hit = np.zeros(len(value), bool)
        # usual groups in one go; of a very large one, strings by their hashes, so that little is sorted at a time
        rounds = -(-len(value) // FLAT)
        turn = value % U64(rounds) if rounds > 1 else None
        for k in range(rounds):
            some = np.arange(len(value)) if turn is None else np.flatnonzero(turn == k)
            seen = value[some]
            order = np.argsort(seen)
            same = seen[order[1:]] == seen[order[:-1]]
            hit[some[order[1:][same]]] = True
            hit[some[order[:-1][same]]] = True
        ends = np.cumsum(sizes)
        new, last = np.zeros(len(value), bool), np.zeros(len(value), bool)
        new[(ends - sizes)[sizes > 0]] = last[ends[sizes > 0] - 1] = True
        first = np.flatnonzero(hit & (new | ~np.concatenate([[False], hit[:-1]])))
        final = np.flatnonzero(hit & (last | ~np.concatenate([hit[1:], [False]])))
        row = np.searchsorted(ends, first, "right")
        shift = (ends - sizes + left)[row]
        return {
            "f": f[row], "c": c[row], "start": (first - shift).astype(np.int32),
            "end": (final - shift + self.unit.match).astype(np.int32),
        }


def _compare(rows: DataFrame, unit: Unit, chunk: int = 2_000) -> DataFrame:
    """Ranges of contexts of equal `key`. Bytes are looked at `chunk` contexts at a time; of a group only hashes
    are held until its last context has come."""

    def run(batches):
        held, last = _Compared(unit), None
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                table = pa.Table.from_batches([batch.slice(at, chunk)]).combine_chunks()
                key = table["key"].to_numpy()
                if held.rows >= chunk and key[0] != last:
                    yield pa.RecordBatch.from_pydict(held.ranges(), schema=RANGE)
                cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
                to = int(cuts[-1]) if len(cuts) else 0
                if held.rows + to >= chunk and to:
                    held.add(table.slice(0, to))
                    yield pa.RecordBatch.from_pydict(held.ranges(), schema=RANGE)
                    table = table.slice(to)
                held.add(table)
                last = key[-1]
        if held.rows:
            yield pa.RecordBatch.from_pydict(held.ranges(), schema=RANGE)
        held = batch = table = None
        give_back()

    dealt = rows.repartition("key").sortWithinPartitions("key", "c", "left")
    return dealt.mapInArrow(run, "f long, c long, start int, end int")


def _stripe(unit: Unit) -> int:
    """Beginnings of strings in a stripe."""
    return -(-(unit.reach + 1) // STRIPES)


def _stripes(rows: DataFrame, unit: Unit) -> DataFrame:
    """Contexts of large groups, cut to each range of beginnings in which they have strings, keyed by the bytes
    all strings of the range have."""
    width = _stripe(unit)
    schema = pa.schema([("key", pa.int64()), *[f for f in CONTEXT if f.name in ("f", "c", "left", "right", "bytes")]])

    def start():
        def work(batch: pa.RecordBatch):
            table = pa.Table.from_batches([batch])
            for at in range(0, table.num_rows, 2_000):
                part = table.slice(at, 2_000)
                buf, base = _joined(part, unit)
                raw, size_of = buf.tobytes(), buf.itemsize
                sums, down = _sums(buf)
                f, c = part["f"].to_numpy(), part["c"].to_numpy()
                mixed = mix(f.view(np.uint64))
                left, right = part["left"].to_numpy().astype(np.int64), part["right"].to_numpy().astype(np.int64)
                for s in range(STRIPES):
                    # Offsets count from `reach` before the gram, where the first string of all could begin.
                    low, high = s * width, min(unit.reach, (s + 1) * width - 1)
                    first, last = np.maximum(low, unit.reach - left), np.minimum(high, right)
                    some = np.flatnonzero(first <= last)
                    zero = (base - unit.reach + left)[some]
                    core = _span_hash(sums, down, zero + high, zero + low + unit.match)
                    begin, end = (zero + first[some]) * size_of, (zero + last[some] + unit.match) * size_of
                    yield {
                        "key": mix(core + mixed[some] + U64(s)).view(np.int64), "f": f[some], "c": c[some],
                        "left": (unit.reach - first[some]).astype(np.int32), "right": last[some].astype(np.int32),
                        "bytes": [raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)],
                    }

        return work

    ddl = "key long, f long, c long, left int, right int, bytes binary"
    return map_batches(rows.select("f", "c", "left", "right", "bytes"), start, schema, ddl)


def repeated_ranges(found: DataFrame, unit: Unit) -> DataFrame:
    """(f, c, start, end): the ranges around a gram that repeat, from the rows of `contexts`."""
    known = found.where("kind = 1")
    classes = known.groupBy("f", "c").agg(
        F.sum("n").alias("n"), F.max("left").alias("left"), F.max("right").alias("right"), F.min("row").alias("row")
    )
    classes = shared_table(classes, "suffix-classes")
    # A context that occurs twice repeats from end to end.
    whole = classes.where(f"n > 1 and left + right + {unit.gram} >= {unit.match}").select(
        "f", "c", (-F.col("left")).alias("start"), (F.col("right") + unit.gram).alias("end")
    )
    # Written, so that the join with a gram of very many contexts can be split.
    sizes = shared_table(classes.groupBy("f").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "suffix-sizes")
    several = classes.select("f", "c", "row").join(sizes, "f")
    several = known.select("f", "c", "row", "left", "right", "bytes").join(several, ["f", "c", "row"])
    several = shared_table(several, "suffix-several")
    small = several.where(F.col("m") <= LARGE).select(
        F.col("f").alias("key"), "f", "c", "left", "right", "bytes"
    )
    large = _stripes(several.where(F.col("m") > LARGE), unit)
    compared = _compare(small, unit).union(_compare(large, unit))
    return whole.union(compared)


SPAN = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()),
])


def merged_spans(places: DataFrame, ranges: DataFrame) -> DataFrame:
    """(row, spans): the ranges of units to remove, one array per row."""
    spans = places.join(ranges, ["f", "c"]).select(
        "row", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")
    )
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def find_spans(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """(row, spans) for the rows of `docs` that have long repeated strings of `unit`; row is `row_key`."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, min(BATCHES, -(-total // BATCH_BYTES)))
    arrays = shared_table(suffix_arrays(docs, batches, unit), "suffix-arrays")
    index = SuffixIndex()
    for k in range(batches):
        batch = arrays.where(F.col("batch") == k).drop("batch")
        index.insert(batch if batches == 1 else shared_table(batch, "suffix-batch"))
    if batches > 1:
        forget(arrays)
    found = shared_table(contexts(docs, index.candidates(), unit), "suffix-contexts")
    for table in (*index.levels.values(), *index.repeats):
        forget(table)
    ranges = repeated_ranges(found, unit)
    return merged_spans(found.where("kind = 0").select("f", "c", "row", "at"), ranges)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """What remains of `text` without the sorted, possibly overlapping spans, and the number of runs."""
    kept, at, runs = [], 0, 0
    last = -1
    for start, end in spans:
        if start > last:
            runs += 1
            kept.append(text[at:start])
        last = at = max(last, end)
    kept.append(text[at:])
    return kept, runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of `docs`."""
    spans = find_spans(docs)
    rows = docs.select("doc_id", "text", row_key().alias("row")).join(spans, "row", "left").select("doc_id", "text", "spans")

    def start():
        def work(batch: pa.RecordBatch):
            out: dict[str, list] = {name: [] for name in SPAN.names}
            out["doc_id"] = batch.column(0)
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = utf8(text)
                spans = batch.column(2)[k].as_py() or []
                kept, runs = cut(data, [(s["start"], s["end"]) for s in spans])
                rest = b"".join(kept)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(rest))
                out["n_spans"].append(runs)
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            yield out

        return work

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_batches(rows, start, SPAN, ddl)


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged spans, shrunk until they begin and end between characters."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    shrunk = []
    for start, end in out:
        while start < len(data) and data[start] & 0xC0 == 0x80:
            start += 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            shrunk.append((start, end))
    return shrunk


def byte_spans(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, from the first byte of a word to the last of another."""
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    return [(at[start][0], at[end - 1][1]) for start, end in spans]


def without_repeats(docs: DataFrame, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """`docs` with all its columns, long repeated strings of each unit cut out of `text`; a character that is only
    partly in one stays. `n_chars`, where there is such a column, is that of the new text."""
    spans = None
    for unit in units:
        found = find_spans(docs, unit).select("row", F.lit(unit.words).alias("words"), "spans")
        found = found if len(units) == 1 else shared_table(found, "suffix-spans")
        spans = found if spans is None else spans.union(found)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("words", "spans")).alias("spans"))
    columns, schema = docs.columns, docs.schema
    free = "_" * (1 + max(map(len, columns)))  # longer than any name there is
    rows = docs.withColumn(free, row_key()).join(spans.withColumnsRenamed({"row": free, "spans": free + "s"}), free, "left")
    rows = rows.select(*columns, free + "s")

    def run(batches):
        for batch in text_slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for k, found in enumerate(batch.column(len(columns)).to_pylist()):
                if found:
                    data = utf8(texts[k])
                    spans = []
                    for of_unit in found:
                        own = [(s["start"], s["end"]) for s in of_unit["spans"]]
                        spans += byte_spans(data, own) if of_unit["words"] else own
                    spans = whole_characters(data, sorted(spans))
                    texts[k] = b"".join(cut(data, spans)[0]).decode("utf-8", "surrogatepass")
            new = [batch.column(k) for k in range(len(columns))]
            new[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in columns:
                k = columns.index("n_chars")
                chars = [None if t is None else len(t) for t in texts]
                new[k] = pa.array(chars, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(new, columns)

    return rows.mapInArrow(run, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))

"""Operator 12: near-duplicates by SimHash fingerprints that meet through the Golay code.

A fingerprint has 64 bits: bit i is set if over half of the text's three-word shingles, repeats included, have it set
in their XXH64. Fingerprints link at three or fewer differing bits.

The binary Golay code of length 23 is perfect: every word of 23 bits is within three bits of exactly one codeword. The
codewords nearest to a segment and to its 23 neighbours at one bit are its keys, one or six. Two segments that
differ in at most two bits have a neighbour in common, so they share a key. A fingerprint is cut into segments A, B
(23 bits) and C (18, padded). Of three errors either a segment has none or each has one. A segment without errors is
matched as it is, with a Golay key of the next one (A with B, B with C, C with A): if the next one has all three errors,
the two others have none and meet with each other. One error each: a Golay key of A with a half of B and a half of C,
one of which is free of errors. That makes at most 42 keys, on average about 37, of 30 bits or more.

Distinct fingerprints that share a key are compared. A key with more than `GROUP` of them is dealt again: of four parts
of the bits one is free of errors, so each member joins four groups by the key and one part. This is done with
three ways to choose the parts; what is still large then is compared block by block. Tasks return the links of a spanning
forest of each group, not all its pairs. Links are confirmed on the whole fingerprints; components by alternating stars.

Results: one row per row of the input. A text without words, or null, has fingerprint zero, linked like any other.
Rows that repeat an id keep a row each; rows without an id take part and get the smallest id reachable, null if none of
their component has one. Other columns are ignored; texts may be of any length; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import U64, forget, load, map_batches, shared_table, utf8
from tracelode.llm.components import components

SHINGLE = 3
SEED = 42
#: Differing bits of a link.
DISTANCE = 3
#: Fingerprints of a key that are compared at once.
GROUP = 2_048
#: Groups of up to so many are compared all at a time.
SMALL = 8

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The generator polynomial of the code (fixed value).
_GENERATOR = 0b110001110101


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper twelve bits, and the error pattern of each remainder."""

    def rest(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= _GENERATOR << (bit - 11)
        return v

    errors = np.zeros(2048, np.int64)
    bits = [1 << i for i in range(23)]
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                pattern = bits[a] | bits[b] | bits[c]
                errors[rest(pattern)] = pattern
    return np.array([rest(v << 11) for v in range(4096)], np.int64), errors


_UPPER, _ERROR = _golay()


def codeword(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit value."""
    return (v ^ _ERROR[_UPPER[v >> 11] ^ (v & 2047)]) >> 11


def golay_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct codewords of each value and of its neighbours at one bit, one or six a row."""
    near = np.sort(np.stack([codeword(v)] + [codeword(v ^ (1 << i)) for i in range(23)], axis=1), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(new)[0], near[new]


def segment_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): keys that two fingerprints at three bits or fewer have in common."""
    v = prints.view(U64)
    a, b, c = ((v >> U64(s) & U64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    rows, keys = [], []
    for kind, (exact, fuzzy) in enumerate(((a, b), (b, c), (c, a))):
        row, key = golay_keys(fuzzy)
        rows.append(row)
        keys.append(kind << 60 | exact[row] << 12 | key)
    row, key = golay_keys(a)
    for i, half_b in enumerate((b & 2047, b >> 11)):
        for j, half_c in enumerate((c & 511, c >> 9)):
            rows.append(row)
            keys.append(3 << 60 | i << 41 | j << 40 | half_b[row] << 28 | half_c[row] << 16 | key)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A fingerprint (signed) per text; zero for one without words."""
    out = np.zeros(len(texts), np.int64)
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = ~_BREAK[buf]
    turn = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(starts):
        return out
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    keep = inside.copy()
    keep[ends] = True
    words = np.where(inside, buf, np.uint8(0x20))[keep].tobytes()  # one blank after each word
    stop = np.cumsum(ends - starts + 1)
    start = stop - (ends - starts + 1)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    n_words = np.diff(np.append(first, len(doc)))
    n_shingles = np.maximum(n_words - SHINGLE + 1, 1)
    begin = np.cumsum(n_shingles) - n_shingles
    i = np.arange(n_shingles.sum()) + np.repeat(first - begin, n_shingles)
    last = i + np.repeat(np.minimum(n_words, SHINGLE), n_shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(words[a:z], SEED) for a, z in zip(start[i].tolist(), (stop[last] - 1).tolist())], U64
    )
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    marks = np.packbits(2 * counts > n_shingles[:, None], axis=1, bitorder="little")
    out[doc[first]] = marks.view("<i8")[:, 0]
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        def work(batch):
            prints = fingerprints([utf8(x) for x in batch.column("text").to_pylist()])
            yield {"doc_id": batch.column("doc_id"), "print": prints}

        return work

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return map_batches(docs, start, pa.schema([("doc_id", arrow), ("print", pa.int64())]), f"doc_id {kind}, print long")


def _keyed(batches):
    schema = pa.schema([("key", pa.int64()), ("print", pa.int64())])
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for at in range(0, len(prints), 20_000):
            part = prints[at : at + 20_000]
            row, key = segment_keys(part)
            yield pa.RecordBatch.from_pydict({"key": key, "print": part[row]}, schema=schema)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(U64)) <= DISTANCE  # of signed values the bits of the magnitude would be counted


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among some fingerprints."""
    out, left = [], prints
    while len(left) > 1:
        root, left, ahead = left[0], left[1:], [left[0]]
        while ahead and len(left):
            near = _near(left, ahead.pop())
            if near.any():
                found = left[near]
                out += [(int(root), int(x)) for x in found]
                ahead += list(found)
                left = left[~near]
    return out


def _links(batches):
    """Links of each group of equal keys; rows come sorted by key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(keys, prints):
        cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        sizes = np.diff(np.append(cuts, len(keys)))
        room = np.repeat(cuts + sizes, sizes) - np.arange(len(keys)) - 1  # members behind each one
        room[np.repeat(sizes > SMALL, sizes)] = 0
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for step in range(1, SMALL):
            i = np.flatnonzero(room >= step)
            i = i[_near(prints[i], prints[i + step])]
            a.append(prints[i])
            b.append(prints[i + step])
        for at in np.flatnonzero(sizes > SMALL):
            found = _forest(prints[cuts[at] : cuts[at] + sizes[at]])
            if found:
                x, y = np.array(found, np.int64).T
                a.append(x)
                b.append(y)
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        for at in range(0, len(both), 50_000):
            part = both[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"a": part[:, 0].copy(), "b": part[:, 1].copy()}, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, prints = np.append(keys, batch.column(0).to_numpy()), np.append(prints, batch.column(1).to_numpy())
        whole = int(np.searchsorted(keys, keys[-1], "left"))  # the last group may go on
        if whole:
            yield from links(keys[:whole], prints[:whole])
            keys, prints = keys[whole:], prints[whole:]
    if len(keys):
        yield from links(keys, prints)


def _parts(level: int) -> list[int]:
    """Four masks that share out the 64 bits; on every level other bits go together."""
    masks = [0, 0, 0, 0]
    for bit in range(64):
        masks[bit // 4**level % 4] |= 1 << bit
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_prints(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints in column `print` within three bits of each other."""
    rows = shared_table(prints.mapInArrow(_keyed, "key long, print long"), "golay-keys")
    found = []
    for level in range(5):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        several = shared_table(rows.join(sizes, "key"), "golay-groups")
        forget(rows)
        fits = several.where(F.col("n") <= GROUP) if level < 4 else several
        dealt = fits.select("key", "print").repartition("key").sortWithinPartitions("key")
        found.append(shared_table(dealt.mapInArrow(_links, "a long, b long").distinct(), "golay-links"))
        large = several.where(F.col("n") > GROUP)
        if level == 4 or large.isEmpty():
            forget(several)
            break
        if level < 3:
            new = F.array(*[F.xxhash64("key", F.lit(i), F.col("print").bitwiseAND(F.lit(m))) for i, m in enumerate(_parts(level))])
        else:
            blocks = F.ceil(F.col("n") / GROUP)
            own = F.pmod(F.xxhash64("print"), blocks)
            new = F.transform(
                F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j))
            )
        rows = shared_table(large.select(F.explode(new).alias("key"), "print"), "golay-keys")
        forget(several)
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = shared_table(with_fingerprints(docs), "prints")
    distinct = shared_table(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    reached = components(near_prints(distinct.select("print")), "simhash")
    of_print = distinct.join(reached, F.col("node") == F.col("print"), "left").select(
        "print", "least", F.coalesce("component", "print").alias("component")
    )
    least = of_print.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = of_print.join(least, "component").select("print", "component_id")
    return prints.join(ids, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of `documents`."""
    return near_duplicates(load(spark, sf_dir, "documents"))

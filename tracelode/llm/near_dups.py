"""Operator 8: near-duplicates by MinHash with banding.

A text is the set of its five-word shingles (64-bit hashes). Documents with equal sets are one
class. The minima of many universal hashes form a signature; `rows` of them at a time form a band.
Classes that share a band are candidates, confirmed first on the signatures, then on the full sets.

Within a band every class is compared with the smallest id. That links almost all there is; bands
whose members then still lie in several components are compared block by block inside tasks, pairs of
different components only, likely ones by signature on their full sets; a task returns just the
links that join components. So pairs are not emitted, no band is cut off, and what any two members
of a band would link is linked. Joins of texts ask for a merge join, whatever the size. With t the threshold, the number of bands is chosen so that two documents at t share no band
with a probability of `miss` at most.

Results: one row per id. Rows without words have an empty set and no links. Rows that repeat an id
are one document with the links of all its rows and the size of its largest set. Rows without an id
take no part and are returned as they are, one by one, with a null component and kept. The smallest
id of a component is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm.common import U64, forget, load, map_batches, mix, shared_table, utf8, word_hashes, word_pieces
from tracelode.llm.components import components

SHINGLE = 5
ROWS = 5
#: Shingles of the members of a band that are compared at a time.
BLOCK = 500_000


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return utf8(text).lower().split()


def shingle_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every word list; shorter lists are one shingle."""
    sizes = [len(t) for t in texts]
    h = word_hashes([w for t in texts for w in t])
    n = len(h) - SHINGLE + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE):
        grams = grams * U64(0x9E3779B97F4A7C15) + h[k : k + n] if n > 0 else grams
    grams = mix(grams)
    out, at = [], 0
    for size in sizes:
        if size >= SHINGLE:
            out.append(np.unique(grams[at : at + size - SHINGLE + 1]))
        elif size:
            whole = U64(size)
            for x in h[at : at + size]:
                whole = mix(np.array([whole], np.uint64) * U64(0x9E3779B97F4A7C15) + x)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


class Hashes:
    """`n` universal hashes: the upper half of (a * x + b) mod 2 ** 64, a odd."""

    def __init__(self, n: int, seed: int = 1_999) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64) * U64(2)

    def minima(self, sets: list[np.ndarray], block: int = 4096) -> np.ndarray:
        """Signatures (uint32) of non-empty sets."""
        out = np.full((len(sets), len(self.a)), 2**32 - 1, np.uint32)
        values = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets)])
        for at in range(0, len(values), block):
            end = min(at + block, len(values))
            hashed = (values[at:end, None] * self.a + self.b) >> U64(32)
            first, last = np.searchsorted(starts, [at, end - 1], "right") - 1
            cuts = np.maximum(starts[first : last + 1] - at, 0)
            least = np.minimum.reduceat(hashed, cuts, axis=0).astype(np.uint32)
            out[first : last + 1] = np.minimum(out[first : last + 1], least)
        return out


def bands_for(threshold: float, miss: float = 3e-6) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**ROWS))


SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("f", pa.int64()), ("g", pa.int64()), ("signature", pa.binary()),
    ("bands", pa.list_(pa.int64())),
])


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """Set size, fingerprint (f, g) of the set, signature and band keys per row of `docs`."""

    def start():
        hashes = Hashes(bands * ROWS)
        number = np.arange(bands, dtype=np.uint64)

        def work(batch: pa.RecordBatch):
            texts = [lower_words(t) for t in batch.column(1).to_pylist()]
            for a, b in word_pieces(texts):
                sets = shingle_sets(texts[a:b])
                some = [i for i, s in enumerate(sets) if len(s)]
                signed = hashes.minima([sets[i] for i in some]) if some else np.empty((0, bands * ROWS), np.uint32)
                key = np.zeros((len(some), bands), np.uint64) + number
                for k in range(ROWS):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + signed[:, k::ROWS].astype(np.uint64))
                signature: list = [None] * (b - a)
                keys: list = [[]] * (b - a)
                for j, i in enumerate(some):
                    signature[i], keys[i] = signed[j].tobytes(), key[j].view(np.int64)
                yield {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n": [len(s) for s in sets],
                    "f": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    "g": [int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    "signature": signature,
                    "bands": keys,
                }

        return work

    ddl = "doc_id long, n long, f long, g long, signature binary, bands array<long>"
    return map_batches(docs.select("doc_id", "text"), start, SIGNED, ddl)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _likely(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures agree in a share of at least `least`."""

    def start():
        def work(batch: pa.RecordBatch):
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            good = pa.array((left == right).mean(axis=1) >= least)
            yield {"a": batch.column(0).filter(good), "b": batch.column(1).filter(good)}

        return work

    return map_batches(pairs.select("a", "b", "sa", "sb"), start, PAIR, "a long, b long")


def _between_blocks(members: DataFrame, least: float, percent: int) -> DataFrame:
    """Links that join different components among the members (key, node, component, signature, text,
    blocks) of each band. A band's members are dealt into blocks of about `BLOCK` shingles; a task compares
    two blocks and returns no more links than it takes to join what it found linked."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
        "node", "component", "signature", "text",
    )

    def compare(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        component = np.array(table["component"].to_numpy())
        block = table["block"].to_numpy()
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(len(node), -1)
        sets = shingle_sets([lower_words(t) for t in table["text"].to_pylist()])
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links: list[tuple[int, int]] = []
        for x in left:
            ys = right[node[right] > node[x]] if i == j else right
            ys = ys[component[ys] != component[x]]
            if not len(ys):
                continue
            alike = (signature[ys] == signature[x]).mean(axis=1)
            for y in ys[np.argsort(-alike, kind="stable")][: int((alike >= least).sum())]:
                if component[y] != component[x] and similar(sets[x], sets[y], percent):
                    links.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
                    component[component == component[y]] = component[x]
        return pa.table({"a": [a for a, _ in links], "b": [b for _, b in links]}, schema=PAIR)

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least `percent` of their union."""
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(two) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")

    def start():
        last: dict[int, np.ndarray] = {}

        def work(batch: pa.RecordBatch):
            ids = [batch.column(k).to_pylist() for k in (0, 1)]
            good = []
            for k, (a, b) in enumerate(zip(*ids, strict=True)):
                if a not in last:
                    last.clear()  # pairs come sorted by a
                    last[a] = shingle_sets([lower_words(batch.column(2)[k].as_py())])[0]
                other = shingle_sets([lower_words(batch.column(3)[k].as_py())])[0]
                good.append(similar(last[a], other, percent))
            mask = pa.array(good)
            yield {"a": batch.column(0).filter(mask), "b": batch.column(1).filter(mask)}

        return work

    return map_batches(both.select("a", "b", "ta", "tb"), start, PAIR, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked at `percent` or more."""
    threshold = percent / 100
    bands = bands_for(threshold)
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / (bands * ROWS))
    signed = shared_table(signatures(docs, bands), "near-signed")
    with_id = signed.where(F.col("doc_id").isNotNull())
    classes = shared_table(
        with_id.where("n > 0").groupBy("f", "g").agg(F.min("doc_id").alias("node")), "near-classes"
    )
    nodes = shared_table(
        with_id.where("n > 0").join(classes, ["f", "g"]).where("doc_id = node")
        .dropDuplicates(["node", "f", "g"]).select("node", "n", "signature", "bands"), "near-nodes",
    )
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).where("size > 1")
    shared = shared_table(keyed.join(groups, "key"), "near-shared")

    def signed_pairs(pairs: DataFrame) -> DataFrame:
        one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
        two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
        return pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a")

    stars = shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = shared_table(_likely(signed_pairs(stars), least), "near-stars")
    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    texts = shared_table(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi"), "near-texts")
    links = shared_table(_confirmed(stars, texts, percent), "near-links")
    found = components(links, "near-components")

    placed = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("key").agg(
        F.sum("n").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low <> high")
    members = placed.select("key", "node", "component").join(
        open_.select("key", F.ceil(F.col("shingles") / BLOCK).cast("int").alias("blocks")), "key"
    )
    members = members.join(nodes.select("node", "signature"), "node").join(
        texts.withColumnRenamed("doc_id", "node").hint("merge"), "node"
    )
    more = shared_table(_between_blocks(members, least, percent), "near-more")
    # All nodes of an id with several rows are one document.
    of_id = with_id.where("n > 0").join(classes, ["f", "g"]).select("doc_id", F.col("node").alias("b")).distinct()
    repeated = of_id.join(of_id.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id")
    edges = links.union(more).union(repeated.where("a <> b").select("a", "b"))
    final = components(edges, "near-components")
    rows = with_id.join(classes, ["f", "g"], "left").withColumn("node", F.when(F.col("n") > 0, F.col("node")))
    rows = rows.join(final, "node", "left").select(
        "doc_id", "n", F.coalesce("component", "node", "doc_id").alias("component_id")
    ).groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    none = signed.where(F.col("doc_id").isNull()).select(
        "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")
    )
    out = shared_table(out.union(none), "near-out")
    for table in (classes, nodes, shared, stars, texts, links, more, signed):
        forget(table)
    return out


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of `docs`, with all their columns, that are kept: one row of each id and text.

    A row that repeats another's id and text goes, so that later stages do not take the two for copies of each other;
    rows of one id with different texts stay or go together. Null and empty texts are linked with nothing. Rows
    without an id stay, repeated ones too. Texts may be of any length; an empty table gives no rows.
    """
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id")
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there is
    nth = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.lit(1)))
    return left.withColumn(free, F.when(F.col("doc_id").isNull(), 1).otherwise(nth)).where(F.col(free) == 1).drop(free)


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
 SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
 SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
 SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n
 HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p
), r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = node
"""

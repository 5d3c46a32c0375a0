"""Operator 11: phrases whose words keep together, from a weighted de Bruijn graph.

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends and those into words at blanks and tabs.
Every word starts exactly one longest gram: itself and the up to three words after it in its piece. Four-word
grams are the edges of the graph, from the node of their first three words to the node of their last three; the
shorter ones, met where a piece ends, are the corrections. Only these grams are counted over the texts. They are dealt
by their first three words, so the flow out of a node plus its corrections, which is the count of the
three words, is a sum within the partition; summing on by two words and by one gives all shorter counts.

Edges that occur often enough are compacted: a node with one such edge in and one out, and no other flow, is inside a
path; pointer doubling labels every edge with the head of its path and its place. A node inside a path has the
count of the edge that leaves it, so it never outlives that edge as a candidate and is not looked at again.

The score of a phrase is the smallest floor(2000000 * a / (l + r)) over its cuts, as decimals, so products may pass
64 bits. Parts of a phrase are at least as frequent as it, so all counts that are needed are among the frequent grams.

Results: one row per language and rank. A null text is empty, a null language `und` (one with the language of that
name); other columns are ignored, repeated rows count again, an empty table gives no rows. Texts and words may be
of any length. Grams are merged within a task by 64-bit hashes and across tasks by their text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import U64, forget, load, mix, shared_table, text_slices, utf8, word_hashes
from tracelode.scale import top_per

#: Words of the longest gram, one more than a node has.
LONGEST = 4
#: Occurrences that a candidate needs.
LEAST = 30
#: Percent of its occurrences inside one longer candidate that drop a phrase.
INSIDE = 80
#: Phrases reported per language.
TOP = 2_000
#: Bytes of text whose grams are merged at a time.
SLICE = 4 << 20
#: Bytes of text per bucket; the grams of a bucket are summed at once.
BUCKET = 2 << 20
#: Grams that are held before they are merged.
HELD = 250_000

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_PACKS = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("grams", pa.binary()), ("counts", pa.binary())])
_FLOWS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("words", pa.int32()), ("f", pa.int64())])
_PACKS_DDL = "bucket long, lang string, grams binary, counts binary"
_FLOWS_DDL = "lang string, gram string, words int, f long"


class Lines:
    """Strings, each ended by a line feed, with their counts."""

    def __init__(self, data: np.ndarray, counts: np.ndarray, ends: np.ndarray | None = None) -> None:
        self.data, self.counts = data, counts
        self.ends = np.flatnonzero(data == 10) + 1 if ends is None else ends
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    @classmethod
    def cut(cls, data: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> Lines:
        """The stretches start .. end - 1 of `data`, which has a byte more at each end."""
        sizes = end - start + 1
        ends = np.cumsum(sizes)
        kind = np.int32 if max(len(data), len(sizes) and ends[-1]) < 2**31 else np.int64
        at = np.repeat((start - ends + sizes).astype(kind), sizes)
        at += np.arange(len(at), dtype=kind)
        out = data[at]
        out[ends - 1] = 10
        return cls(out, counts, ends)

    @classmethod
    def joined(cls, parts: list[Lines]) -> Lines:
        return cls(np.concatenate([p.data for p in parts]), np.concatenate([p.counts for p in parts]))

    def __len__(self) -> int:
        return len(self.counts)

    def summed(self) -> Lines:
        """Equal strings once, with the sum of their counts."""
        if not len(self):
            return self
        offsets = pa.py_buffer(np.concatenate([[0], self.ends]).astype(np.int64))
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, offsets, pa.py_buffer(self.data)])
        coded = strings.dictionary_encode()
        codes, once = coded.indices.to_numpy(), len(coded.dictionary)
        order = np.argsort(codes, kind="stable")
        counts = np.add.reduceat(self.counts[order], np.searchsorted(codes[order], np.arange(once)))
        _, ends, data = coded.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64)[1 : once + 1]
        return Lines(np.frombuffer(data, np.uint8)[: ends[-1]], counts, ends)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each string; ends of all words, and the place of each string's first among them."""
        stops = np.flatnonzero((self.data == 32) | (self.data == 10))
        first = np.searchsorted(stops, self.starts)
        return np.searchsorted(stops, self.ends) - first, stops, first

    def prefixes(self, n: int) -> Lines:
        """First `n` words of each string, or all of a shorter one, summed."""
        size, stops, first = self.words()
        last = stops[first + np.minimum(size, n) - 1]
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts] = 1
        edge[last + 1] -= 1
        data = self.data.copy()
        data[last] = 10
        return Lines(data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)], self.counts, np.cumsum(last + 1 - self.starts)).summed()

    def rows(self, lang: str, words: int, least: int) -> dict[str, object]:
        """Columns of the strings of so many words that occur often enough."""
        some = np.flatnonzero((self.counts >= least) & (self.words()[0] == words))
        grams = [self.data[a : z - 1].tobytes().decode() for a, z in zip(self.starts[some], self.ends[some])]
        return {"lang": [lang] * len(some), "gram": grams, "words": np.full(len(some), words, np.int32), "f": self.counts[some]}

    def packs(self, lang: str, buckets: np.ndarray):
        """One compressed row for each bucket."""
        order = np.argsort(buckets, kind="stable")
        lines = Lines.cut(self.data, self.starts[order], self.ends[order] - 1, self.counts[order])
        cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-1))
        press = zstandard.ZstdCompressor(level=1)
        for a, z in zip(cuts[:-1], cuts[1:]):
            yield {
                "bucket": int(buckets[order[a]]), "lang": lang,
                "grams": press.compress(lines.data[lines.starts[a] : lines.ends[z - 1]]),
                "counts": press.compress(lines.counts[a:z].astype(np.int64)),
            }


def _hashes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty stretch of `buf`, made of its 8-byte words."""
    many = (sizes + 7) // 8
    first = np.cumsum(many) - many
    j = np.arange(many.sum()) - np.repeat(first, many)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))[np.repeat(starts, many) + 8 * j]
    left = np.repeat(sizes, many) - 8 * j
    short = left < 8
    words[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
    return mix(np.add.reduceat(mix(words + (j + 1).astype(U64) * U64(0xA0761D6478BD642F)), first) + sizes.astype(U64))


def longest_grams(texts: list[bytes]) -> tuple[Lines, np.ndarray]:
    """The distinct longest grams of some texts with their counts, and a hash of the node each starts from."""
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    kind = _KIND[buf]
    inside = kind == 0
    turn = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    n = len(starts)
    if not n:
        return Lines(np.empty(0, np.uint8), np.empty(0, np.int64)), np.empty(0, U64)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    keep = inside.copy()
    keep[ends] = True
    words = np.where(inside, buf, np.uint8(0x20))[keep]  # one blank after each word
    sizes = ends - starts + 1
    at = np.cumsum(sizes) - sizes
    hashed = _hashes(words, at, sizes)
    key, last = hashed.copy(), np.arange(n)
    more = np.ones(n, bool)
    node = key
    for step in range(1, LONGEST):
        more[max(n - step, 0):] = False
        if step < n:
            more[: n - step] &= piece[step:] == piece[: n - step]
        if step == LONGEST - 1:
            node = key.copy()
        i = np.flatnonzero(more)
        key[i] = mix(key[i] * U64(3) ^ hashed[i + step])
        last[i] += 1
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return Lines.cut(words, at[first], (at + sizes)[last[first]] - 1, counts.astype(np.int64)), node[first]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _gram_packs(docs: DataFrame, buckets: int) -> DataFrame:
    """The longest grams of each stretch of a task, packed by language and by a hash of their node."""

    def run(batches):
        for batch in text_slices(batches, SLICE):
            langs = batch.column("lang").dictionary_encode()
            codes, texts = langs.indices.to_numpy(), batch.column("text")
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                of_lang = texts.filter(pa.array(codes == code))
                lines, nodes = longest_grams([utf8(x) for x in of_lang.to_pylist()])
                if len(lines):
                    own = word_hashes([lang.encode()])[0]
                    rows = list(lines.packs(lang, (mix(nodes + own) % U64(buckets)).astype(np.int64)))
                    for i in range(0, len(rows), 100):
                        yield _batch(rows[i : i + 100], _PACKS)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    return rows.mapInArrow(run, _PACKS_DDL)


def _buckets(batches):
    """(lang, summed lines) of each language and bucket; rows come sorted by both."""
    now, parts, held = None, [], 0
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, lang, grams, counts = (batch.column(k)[i].as_py() for k in range(4))
            if (bucket, lang) != now:
                if parts:
                    yield now[1], Lines.joined(parts).summed()
                now, parts, held = (bucket, lang), [], 0
            parts.append(Lines(np.frombuffer(press.decompress(grams), np.uint8), np.frombuffer(press.decompress(counts), np.int64)))
            held += len(parts[-1])
            if held > HELD and len(parts) > 1:
                parts = [Lines.joined(parts).summed()]
                held = len(parts[0]) // 2
    if parts:
        yield now[1], Lines.joined(parts).summed()


def _edge_flows(least: int, buckets: int):
    """Frequent edges and nodes of each bucket; sums by two words, packed for the next step."""
    schema = pa.schema([*_FLOWS, *(f for f in _PACKS if f.name != "lang")])

    def run(batches):
        held: dict[str, list[Lines]] = {}

        def packs(lang):
            pairs = Lines.joined(held.pop(lang)).summed()
            own = word_hashes([lang.encode()])[0]
            keys = _hashes(pairs.data, pairs.starts, pairs.ends - pairs.starts)
            rows = list(pairs.packs(lang, (mix(keys + own) % U64(buckets)).astype(np.int64)))
            for i in range(0, len(rows), 100):
                yield _batch(rows[i : i + 100], schema)

        for lang, edges in _buckets(batches):
            nodes = edges.prefixes(LONGEST - 1)
            for lines, words in ((edges, LONGEST), (nodes, LONGEST - 1)):
                found = lines.rows(lang, words, least)
                nothing = {k: [None] * len(found["lang"]) for k in ("bucket", "grams", "counts")}
                yield pa.RecordBatch.from_pydict(found | nothing, schema=schema)
            held.setdefault(lang, []).append(nodes.prefixes(LONGEST - 2))
            if sum(map(len, held[lang])) > HELD:
                yield from packs(lang)
        for lang in list(held):
            yield from packs(lang)

    return run


def _pair_flows(least: int):
    """Frequent grams of two words; sums by one word and over all (words 0) of each bucket."""

    def run(batches):
        for lang, pairs in _buckets(batches):
            single = pairs.prefixes(1)
            yield pa.RecordBatch.from_pydict(pairs.rows(lang, LONGEST - 2, least), schema=_FLOWS)
            yield pa.RecordBatch.from_pydict(single.rows(lang, 1, 0), schema=_FLOWS)
            yield _batch([{"lang": lang, "gram": "", "words": 0, "f": int(single.counts.sum())}], _FLOWS)

    return run


def frequent_grams(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, gram, words, f): grams of one to four words that occur `least` times; words 0: all words of a language.

    Grams move packed, a compressed row per stretch of text and bucket; the number of buckets follows the bytes
    of all texts. They are dealt by their node, so edges and flows are summed where they lie; only sums by two
    words, packed again, and by one move on.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = math.ceil((size + 1) / BUCKET)
    dealt = _gram_packs(docs, buckets).repartition("bucket").sortWithinPartitions("bucket", "lang")
    flows = shared_table(
        dealt.mapInArrow(_edge_flows(least, buckets), f"{_FLOWS_DDL}, bucket long, grams binary, counts binary"), "flows"
    )
    pairs = flows.where("bucket is not null").select("bucket", "lang", "grams", "counts").repartition("bucket")
    shorter = pairs.sortWithinPartitions("bucket", "lang").mapInArrow(_pair_flows(least), _FLOWS_DDL)
    shorter = shorter.groupBy("lang", "gram", "words").agg(F.sum("f").alias("f")).where(f"words = 0 or f >= {least}")
    grams = shared_table(flows.where("bucket is null").select("lang", "gram", "words", "f").union(shorter), "grams")
    forget(flows)
    return grams


def compact_paths(grams: DataFrame) -> DataFrame:
    """(lang, gram, f, head, place): every frequent edge with the first edge of its unary path and its place there.

    A node is inside a path if one edge enters and one leaves it, both with all its occurrences. Such a path cannot
    be a ring: each occurrence of a node would be followed by another one without end.
    """
    edges = grams.where(F.col("words") == LONGEST).select(
        "lang", "gram", "f", F.substring_index("gram", " ", LONGEST - 1).alias("src"),
        F.substring_index("gram", " ", 1 - LONGEST).alias("dst"),
    )
    one = [F.count(F.lit(1)).alias("edges"), F.max("f").alias("f")]
    nodes = grams.where(F.col("words") == LONGEST - 1).select("lang", F.col("gram").alias("node"), "f")
    into = edges.groupBy("lang", F.col("dst").alias("node")).agg(*one, F.max("gram").alias("before")).where("edges = 1")
    out = edges.groupBy("lang", F.col("src").alias("node")).agg(*one, F.max("gram").alias("gram")).where("edges = 1")
    links = (
        into.join(out.select("lang", "node", "f", "gram"), ["lang", "node", "f"])
        .join(nodes, ["lang", "node", "f"]).select("lang", "gram", "before")
    )
    now = shared_table(
        edges.join(links, ["lang", "gram"], "left").select(
            "lang", "gram", "f", F.coalesce("before", "gram").alias("head"), F.col("before").isNotNull().cast("long").alias("place")
        ),
        "paths",
    )
    moved = now.where("place > 0").count()
    while moved:
        ahead = now.select("lang", F.col("gram").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"))
        after = shared_table(
            now.join(ahead, ["lang", "head"]).select(
                "lang", "gram", "f", F.col("_head").alias("head"), (F.col("place") + F.col("_place")).alias("place"),
                (F.col("_place") > 0).alias("moved"),
            ),
            "paths",
        )
        forget(now)
        moved = after.where("moved").count()
        now = after
    return now.select("lang", "gram", "f", "head", "place")


def _cut(first: int, length: int):
    """Words first .. first + length - 1 of a gram, counted from 0."""
    return F.array_join(F.slice("_w", first + 1, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language by score; see the contract in the module's text."""
    grams = frequent_grams(docs, least)
    paths = compact_paths(grams)
    within = paths.where("place > 0").select("lang", F.substring_index("gram", " ", LONGEST - 1).alias("gram"))
    phrases = grams.where("words > 1").join(within, ["lang", "gram"], "left_anti")
    split = phrases.withColumn("_w", F.split("gram", " "))

    parts = split.select(
        "lang", "gram", F.col("f").alias("a"),
        F.explode(F.array(*[
            F.when(F.col("words") > k, F.struct(
                F.lit(k).alias("k"), _cut(0, k).alias("first"), F.array_join(F.expr(f"slice(_w, {k + 1}, 4)"), " ").alias("rest")
            ))
            for k in range(1, LONGEST)
        ])).alias("_c"),
    ).where("_c is not null").select("lang", "gram", "a", "_c.*")
    counts = grams.where("words > 0").select("lang", "gram", "f")
    scored = (
        parts.join(counts.select("lang", F.col("gram").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(counts.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .withColumn("score", F.expr("cast((2000000BD * a) div (cast(l as decimal(20,0)) + r) as bigint)"))
        .groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_s"))
        .select("lang", "gram", "a", "_s.score", "_s.l", "_s.r")
    )
    windows = [(n, first, size) for n in range(3, LONGEST + 1) for size in range(2, n) for first in range(n - size + 1)]
    longest = grams.where("words > 2").withColumn("_w", F.split("gram", " "))
    held = (
        longest.select(
            "lang", "f",
            F.explode(F.array(*[F.when(F.col("words") == n, _cut(first, size)) for n, first, size in windows])).alias("gram"),
        )
        .where("gram is not null").groupBy("lang", "gram").agg(F.max("f").alias("_longer"))
    )
    kept = scored.join(held, ["lang", "gram"], "left").where(
        F.expr(f"_longer is null or 100BD * _longer < {inside} * cast(a as decimal(20,0))")
    )
    ranked = top_per(
        kept, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("gram")], top
    )
    totals = grams.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", "n", "score"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases per language of `documents` that keep together best."""
    return collocations(load(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'
    )) as piece
  from documents
), words as (
  select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') as w from pieces
), spots as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words where len(w) > 0
), grams as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as gram, m from spots, (select unnest([1, 2, 3, 4]) as m) where i + m - 1 <= len(w)
), counts as (
  select lang, gram, m, count(*) as f from grams group by all
), totals as (
  select lang, sum(f)::bigint as n from counts where m = 1 group by lang
), candidates as (
  select lang, gram, m, f as a, string_split(gram, ' ') as w from counts where m > 1 and f >= 30
), cuts as (
  select c.lang, c.gram, c.a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
  from candidates c, (select unnest([1, 2, 3]) as k) where k < m
), scored as (
  select c.lang, c.gram, c.a, x.f as l, y.f as r, k, ((2000000::hugeint * c.a) // (x.f + y.f))::bigint as score
  from cuts c join counts x on x.lang = c.lang and x.gram = c.first join counts y on y.lang = c.lang and y.gram = c.rest
), lowest as (
  select * from scored qualify row_number() over (partition by lang, gram order by score, k) = 1
), windows as (
  select lang, a, array_to_string(w[s:s + size - 1], ' ') as gram
  from candidates, (select unnest([1, 2, 3]) as s), (select unnest([2, 3]) as size) where size < m and s + size - 1 <= m
), held as (
  select lang, gram, max(a) as longer from windows group by all
), ranked as (
  select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.gram) as rank
  from lowest s left join held h on h.lang = s.lang and h.gram = s.gram
  where h.longer is null or 100 * h.longer < 80 * s.a
)
select r.lang, rank, gram as phrase, a, l, r.r, n, score from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""

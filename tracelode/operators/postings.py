"""Search over stored posting blocks.

The visible units of a workspace are dealt into blocks by asset, so a page or an evidence location never spans two
blocks. A row of the index holds one term of one block: packed numbers of the units that have it with term
frequency, length, page and location, the positions, and what bounds the scores it can give. A search joins the asked
terms with their rows, brings each block together with blocks of questions in one task, scores with numpy, and lets only
k places per question and block leave the task. A block whose bound stays under a question's k-th score so far is skipped.

A question may be restricted to assets: its scope is a bitmap of asset numbers for each block, tested while the block is
scored. No unit is copied, and what is read does not depend on how many questions are restricted.

Fields: `bm25` (ASCII words, CJK characters and bigrams), `word` (letter and digit runs of the lower-cased text) and
`run` (ASCII and CJK runs of the case-folded text, for substrings: a term is in a text if it is in one of its runs, so
substring search looks at the vocabulary, not at the texts). The runs of a block are one row: its units, how many
different runs each has and which, the runs themselves and the case-folded texts. A search brings the questions to these
rows and moves none of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.scale import top_per

# Fixed values.
K1 = 1.2
B = 0.75
#: Weight of an occurrence, positions kept per word and the last position, as a text search vector has them.
OCCURRENCE_WEIGHT = 0.1
WORD_POSITIONS = 256
LAST_POSITION = 16_383

#: Units of a block, questions of a block, ways in which blocks are spread, and terms that are sought at once.
BLOCK_UNITS = 4_096
BLOCK_QUERIES = 256
SALTS = 16
TERM_BLOCK = 4_000
#: Marks of terms by units that are held at once, and characters of questions that are broadcast.
MARKS = 1 << 24
BROADCAST_CHARS = 16 << 20

_INDEX = pa.schema([
    ("workspace_id", pa.string()), ("block", pa.int64()), ("field", pa.string()), ("term", pa.string()), ("df", pa.int64()),
    ("total", pa.int64()), ("max_tf", pa.int32()), ("min_len", pa.int32()), ("units", pa.binary()), ("positions", pa.binary()),
    ("runs", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
_INDEX_DDL = (
    "workspace_id string, block long, field string, term string, df long, total long, max_tf int, min_len int, "
    "units binary, positions binary, runs array<string>, texts array<string>"
)
_HITS = pa.schema([
    ("query_id", pa.string()), ("workspace_id", pa.string()), ("block", pa.int64()), ("slot", pa.int32()), ("score", pa.float64()),
    ("whole", pa.bool_()),
])
_HITS_DDL = "query_id string, workspace_id string, block long, slot int, score double, whole boolean"
_ASCII = regex.compile(r"[A-Za-z0-9]+")
_CJK = regex.compile("[㐀-鿿]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_RUN = regex.compile("[a-z0-9]+|[㐀-鿿]+")


def slots(units: DataFrame) -> DataFrame:
    """The units with block and slot, and the numbers of their page, location and asset in the block.

    Slots follow unit ids, page numbers follow (asset, page), so ties are broken by them alone.
    """
    sizes = units.groupBy("workspace_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_UNITS).alias("_blocks"))
    keys = units.select("unit_id", "workspace_id", "asset_id", "page_number", "location_key").join(sizes, "workspace_id")
    space = Window.partitionBy("workspace_id", "block")
    numbers = {
        "slot": F.row_number().over(space.orderBy("unit_id")),
        "page_no": F.dense_rank().over(space.orderBy("asset_id", F.col("page_number").asc_nulls_first())),
        "place_no": F.dense_rank().over(space.orderBy("asset_id", "location_key")),
        "asset_no": F.dense_rank().over(space.orderBy("asset_id")),
    }
    placed = keys.withColumn("block", F.pmod(F.xxhash64("asset_id"), F.col("_blocks"))).select(
        "unit_id", "block", *[(n - 1).cast("int").alias(c) for c, n in numbers.items()]
    )
    return units.join(placed, "unit_id")  # texts move once, not through every sort


def _bm25_tokens(text: str) -> list[str]:
    out = [w.lower() for w in _ASCII.findall(text)]
    for run in _CJK.findall(text):
        out += run
        out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


_FIELDS: tuple[tuple[str, str, Callable[[str], list[str]]], ...] = (
    ("bm25", "text", _bm25_tokens), ("word", "lowered", _WORD.findall), ("run", "folded", _RUN.findall),
)


def _block_rows(space: str, block: int, rows: list[tuple], fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Index rows of one block; rows: (slot, page, place, asset, text, lowered, folded)."""
    numbers = np.array([r[:4] for r in rows], np.int32)
    for k, (field, _, tokens) in enumerate(_FIELDS):
        if field not in fields:
            continue
        lists = [tokens(r[4 + k] or "") for r in rows]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = pa.array([t for one in lists for t in one], pa.string()).dictionary_encode()
        codes = flat.indices.to_numpy()
        if not len(codes):
            continue
        unit = np.repeat(np.arange(len(rows)), lengths)
        if field == "run":
            once = np.unique(unit * len(flat.dictionary) + codes)
            unit, codes = np.divmod(once, len(flat.dictionary))
            held = np.bincount(unit, minlength=len(rows)).astype(np.int32)
            packed = np.column_stack([numbers[:, 0], held, lengths.astype(np.int32), numbers[:, 1:]])
            yield pa.RecordBatch.from_pydict({
                "workspace_id": [space], "block": [block], "field": [field], "term": [""], "df": [len(rows)], "total": [int(lengths.sum())],
                "max_tf": [int(held.max())], "min_len": [int(lengths.min())], "units": [packed.T.tobytes()],
                "positions": [codes.astype(np.int32).tobytes()], "runs": [flat.dictionary], "texts": [[r[4 + k] or "" for r in rows]],
            }, schema=_INDEX)
            continue
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        order = np.lexsort((unit, codes))
        codes, unit, place = codes[order], unit[order], place[order].astype(np.int32)
        first = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(unit, prepend=-1) != 0))
        tf = np.diff(np.append(first, len(codes))).astype(np.int32)
        owner = unit[first]
        packed = np.column_stack([numbers[owner, 0], tf, lengths[owner].astype(np.int32), numbers[owner, 1:]])
        term = np.flatnonzero(np.diff(codes[first], prepend=-1) != 0)
        ends = np.append(term[1:], len(first))
        spots = np.append(first, len(codes))
        columns = {
            "workspace_id": [space] * len(term), "block": [block] * len(term), "field": [field] * len(term),
            "term": flat.dictionary.take(pa.array(codes[first[term]])), "df": ends - term, "total": np.add.reduceat(tf, term, dtype=np.int64),
            "max_tf": np.maximum.reduceat(tf, term), "min_len": np.minimum.reduceat(packed[:, 2], term),
            "units": [packed[a:z].T.tobytes() for a, z in zip(term, ends)],
            "positions": [place[spots[a] : spots[z]].tobytes() if field == "word" else None for a, z in zip(term, ends)],
            "runs": pa.nulls(len(term), pa.list_(pa.string())), "texts": pa.nulls(len(term), pa.list_(pa.string())),
        }
        whole = pa.RecordBatch.from_pydict(columns, schema=_INDEX)
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)


def index(placed: DataFrame, fields: tuple[str, ...] = ("bm25", "word", "run")) -> DataFrame:
    """The index rows of units with slots; a task holds the texts of one block at a time."""
    columns = ["workspace_id", "block", "slot", "page_no", "place_no", "asset_no", "text"]
    rows = placed.select(*columns).repartition("workspace_id", "block").sortWithinPartitions("workspace_id", "block", "slot")
    forms = {"lowered": ("word", F.lower("text")), "folded": ("run", tx.casefold(F.col("text")))}  # only the text is moved
    rows = rows.select(*columns, *[(form if field in fields else F.lit(None).cast("string")).alias(c) for c, (field, form) in forms.items()])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for space, block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (space, block) != now:
                    if held:
                        yield from _block_rows(*now, held, fields)
                    now, held = (space, block), []
                held.append(tuple(row))
        if held:
            yield from _block_rows(*now, held, fields)

    return rows.mapInArrow(build, _INDEX_DDL)


def asked_terms(queries: DataFrame, terms: Column) -> DataFrame:
    """(query_id, workspace_id, restricted, n_terms, term): distinct terms of each question.

    A question that is nothing but its one term has 0 terms, as that term's place is the whole question's. The column
    `restricted` may be absent; null is false.
    """
    closed = F.coalesce("restricted", F.lit(False)) if "restricted" in queries.columns else F.lit(False)
    listed = queries.select(
        "query_id", "workspace_id", closed.alias("restricted"), F.array_distinct(terms).alias("_t"), tx.casefold(F.col("text")).alias("_f")
    )
    alone = (F.size("_t") == 1) & (F.element_at("_t", 1) == F.col("_f"))
    return listed.where(F.size("_t") > 0).select(
        "query_id", "workspace_id", "restricted", F.when(alone, 0).otherwise(F.size("_t")).alias("n_terms"), F.explode("_t").alias("term")
    ).where("term <> ''")


def _marks(terms: list[str], runs: list[str], slot: np.ndarray, held: np.ndarray, codes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Which of the slots 0 to n hold which terms in one of their runs, for some terms at a time, in their order.

    `held` has the number of runs of each slot, `codes` which ones. An automaton finds the terms of all runs in one pass.
    """
    joined, ends = "\n".join(runs), np.cumsum([len(r) + 1 for r in runs])
    owner = np.repeat(slot, held)
    step = max(1, min(TERM_BLOCK, MARKS // max(n, 1)))
    for first in range(0, len(terms), step):
        some = terms[first : first + step]
        sought = ahocorasick.Automaton()
        for k, term in enumerate(some):
            sought.add_word(term, k)
        sought.make_automaton()
        pairs, part = [np.zeros(0, np.int64)], []
        matches = sought.iter(joined)
        while part := list(islice(matches, 500_000)):  # a run may hold a term often
            at, term = np.array(part, np.int64).T
            pairs.append(np.unique(np.searchsorted(ends, at, "right") * len(some) + term))
        run, term = np.divmod(np.unique(np.concatenate(pairs)), len(some))
        begin = np.searchsorted(run, np.arange(len(runs) + 1))
        count = np.diff(begin)
        marks = np.zeros((len(some), n), bool)
        for a in range(0, len(codes), 100_000):
            code = codes[a : a + 100_000]
            times = count[code]
            pick = np.repeat(begin[code] - np.cumsum(times) + times, times) + np.arange(times.sum())
            marks[term[pick], np.repeat(owner[a : a + 100_000], times)] = True
        yield marks


class Row:
    """One term of a block, with its questions."""

    def __init__(self, row: dict) -> None:
        self.term, self.field, self.queries = row["term"], row["field"], row["queries"]
        self.idf, self.avg_len, self.max_tf, self.min_len = row["idf"], row["avg_len"], row["max_tf"], row["min_len"]
        self.units = np.frombuffer(row["units"], np.int32).reshape(6, -1)
        self.slot, self.tf, self.length, self.page, self.place, self.asset = self.units
        self.positions = row["positions"]


class Found:
    """A term of questions and the slots of the units that have it in one of their runs."""

    field = "run"

    def __init__(self, term: str, queries: list[dict], slot: np.ndarray) -> None:
        self.term, self.queries, self.slot = term, queries, slot


class Block:
    """The rows of a block of units that a block of questions asks for, and the scopes of restricted questions."""

    def __init__(self) -> None:
        self.rows: list[Row | Found] = []
        self.runs: list[tuple[np.ndarray, np.ndarray, list[str]]] = []
        self.asks: dict[str, list[dict]] = {}
        self.scopes: dict[str, np.ndarray] = {}

    def add(self, row: dict) -> None:
        if row["field"] == "scope":
            bits = np.unpackbits(np.frombuffer(row["units"], np.uint8), bitorder="little")
            self.scopes[row["term"]] = np.flatnonzero(bits) + row["df"]
        elif row["field"] == "ask":
            self.asks[row["term"]] = row["queries"]
        elif row["field"] == "run":
            self.runs.append((np.frombuffer(row["units"], np.int32).reshape(6, -1), np.frombuffer(row["positions"], np.int32), row["runs"]))
        else:
            self.rows.append(Row(row))

    def close(self) -> None:
        whole = np.concatenate([np.zeros((6, 0), np.int32), *(r.units for r in self.rows), *(u for u, *_ in self.runs)], axis=1)
        slot, numbers = whole[0], whole[3:]
        self.n = int(slot.max(initial=-1)) + 1
        for name, values in zip(("page", "place", "asset"), numbers):
            codes = np.zeros(self.n, np.int32)
            codes[slot] = values
            setattr(self, name, codes)
        terms = list(self.asks)
        for units, codes, runs in self.runs:
            found = (mark for marks in _marks(terms, runs, units[0], units[1], codes, self.n) for mark in marks)
            self.rows += [Found(term, self.asks[term], np.flatnonzero(mark)) for term, mark in zip(terms, found) if mark.any()]
        self.runs = []

    def questions(self) -> Iterator[tuple[str, int, list[Row], np.ndarray | None]]:
        """(question, number of its terms, rows of its terms, which slots it may see; None: all)."""
        of: dict[str, list[Row]] = {}
        about = {}
        for row in self.rows:
            for q in row.queries:
                of.setdefault(q["query_id"], []).append(row)
                about[q["query_id"]] = q
        for query, rows in of.items():
            seen = None
            if about[query]["restricted"]:
                seen = np.isin(self.asset, self.scopes.get(query, ()))
            yield query, about[query]["n_terms"], rows, seen


_MET = [
    "workspace_id", "part", "block", "field", "term", "df", "idf", "avg_len", "max_tf", "min_len", "units", "positions", "queries", "runs",
]


def _with_questions(
    found: DataFrame, asked: DataFrame, weights: bool, chosen: DataFrame | None, placed: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """Index rows next to the questions that ask their term, in blocks of about `BLOCK_QUERIES` questions; with `runs`
    also those, once for each block of questions, and the terms that are sought in them; with
    `chosen` (query_id, asset_id) also a bitmap of the assets of each restricted question in each block."""
    sizes = asked.groupBy("workspace_id").agg(F.ceil(F.count_distinct("query_id") / BLOCK_QUERIES).alias("_n"))
    asked = asked.join(sizes, "workspace_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("_n")))
    if not weights:
        asked = asked.withColumns({"idf": F.lit(None).cast("double"), "avg_len": F.lit(None).cast("double")})
    grouped = asked.groupBy("workspace_id", "term", "part", "idf", "avg_len").agg(
        F.collect_list(F.struct("query_id", "n_terms", "restricted")).alias("queries")
    )
    met = found.join(grouped, ["workspace_id", "term"]).select(*_MET)
    if runs is not None:
        parts = asked.select("workspace_id", "part").distinct()
        blocks = placed.select("workspace_id", "block").distinct()
        asks = grouped.join(blocks, "workspace_id").select("workspace_id", "part", "block", F.lit("ask").alias("field"), "term", "queries")
        met = met.unionByName(asks, allowMissingColumns=True).unionByName(runs.join(F.broadcast(parts), "workspace_id"), allowMissingColumns=True)
    if chosen is None:
        return met
    number = F.col("asset_no") + 1
    assets = placed.select("workspace_id", "asset_id", "block", "asset_no").distinct()
    closed = asked.where("restricted").select("query_id", "workspace_id", "part").distinct()
    scopes = chosen.select("query_id", "asset_id").distinct().join(closed, "query_id").join(assets, ["workspace_id", "asset_id"])
    scopes = scopes.groupBy("workspace_id", "part", "block", "query_id", F.bitmap_bucket_number(number).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("units")
    )
    return met.unionByName(
        scopes.select(
            "workspace_id", "part", "block", F.lit("scope").alias("field"), F.col("query_id").alias("term"),
            ((F.col("_bucket") - 1) * 32_768).alias("df"), "units",
        ),
        allowMissingColumns=True,
    )


def _scored(met: DataFrame, score: Callable[[Block, dict[str, float]], Iterator[tuple]]) -> DataFrame:
    """Hits of every (question block, block): `score` gets the block and the scores the questions already reached
    in this task, and yields (question, slots, scores, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, reached = None, Block(), {}

        def done() -> Iterator[pa.RecordBatch]:
            space, _, block = now
            held.close()
            out: list[list] = [[], [], [], []]
            for query, where, values, whole in score(held, reached):
                out[0] += [query] * len(where)
                out[1] += where.tolist()
                out[2] += values.tolist()
                out[3] += [whole] * len(where)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip([out[0], [space] * n, [block] * n, *out[1:]], _HITS)], schema=_HITS
            )

        for batch in batches:
            for row in batch.to_pylist():
                at = (row["workspace_id"], row["part"], row["block"])
                if at != now:
                    if held.rows or held.runs:
                        yield from done()
                    if now is None or at[:2] != now[:2]:
                        reached = {}
                    now, held = at, Block()
                held.add(row)
        if held.rows or held.runs:
            yield from done()

    dealt = met.repartition("workspace_id", "part", "block").sortWithinPartitions("workspace_id", "part", "block")
    return dealt.mapInArrow(run, _HITS_DDL)


def _best(slot: np.ndarray, score: np.ndarray, place: np.ndarray, order: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best places by (-score, order), each with its first slot of that score."""
    by = np.lexsort((order, -score))
    _, first = np.unique(place[by], return_index=True)
    by = by[np.sort(first)][:k]
    return slot[by], score[by]


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots with the sum of their values."""
    slot = np.concatenate([s for s, _ in parts])
    sums = np.bincount(slot, np.concatenate([v for _, v in parts]))
    once = np.unique(slot)
    return once, sums[once]


def corpus_stats(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Units and mean token count per workspace."""
    tokens = rows.where("field = 'bm25'").groupBy("workspace_id").agg(F.sum("total").alias("_tokens"))
    counts = placed.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_units"))
    return counts.join(tokens, "workspace_id", "left").select(
        "workspace_id", "n_units", (F.coalesce("_tokens", F.lit(0)) / F.col("n_units")).alias("avg_len")
    )


def _in_scope(asked: DataFrame, found: DataFrame, placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, term, _df): units with the term among the assets of a restricted question."""
    closed = asked.where("restricted")

    def score(held: Block, _: dict[str, float]) -> Iterator[tuple]:
        for query, _, terms, seen in held.questions():
            for r in terms:
                yield f"{query}\x1f{r.term}", np.zeros(1, np.int64), np.array([float(seen[r.slot].sum())]), False

    counted = _scored(_with_questions(found, closed, False, chosen, placed), score)
    both = F.split("query_id", "\x1f")
    return counted.groupBy(both[0].alias("query_id"), both[1].alias("term")).agg(F.sum("score").cast("long").alias("_df")).where("_df > 0")


def bm25_hits(queries: DataFrame, rows: DataFrame, placed: DataFrame, k: int | None, chosen: DataFrame | None = None) -> DataFrame:
    """k best pages per question and block, as hits; k None: every page with a score.

    A question restricted to assets is scored as if they were the whole corpus.
    """
    asked = asked_terms(queries, tx.bm25_tokens(F.col("text")))
    found = rows.where("field = 'bm25'").join(asked.select("workspace_id", "term").distinct(), ["workspace_id", "term"], "left_semi")
    counts = found.groupBy("workspace_id", "term").agg(F.sum("df").alias("_df"))
    idf = F.log(1.0 + (F.col("n_units") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weighed = asked.where("not restricted").join(counts, ["workspace_id", "term"]).join(corpus_stats(rows, placed), "workspace_id")
    if chosen is not None:
        counted = _in_scope(asked, found, placed, chosen)
        of_asset = placed.groupBy("workspace_id", "asset_id").agg(
            F.count(F.lit(1)).alias("_n"), F.sum(F.size(tx.bm25_tokens(F.col("text")))).alias("_tokens")
        )
        stats = (
            chosen.select("query_id", "asset_id").distinct().join(asked.select("query_id", "workspace_id").distinct(), "query_id")
            .join(of_asset, ["workspace_id", "asset_id"]).groupBy("query_id")
            .agg(F.sum("_n").alias("n_units"), (F.sum("_tokens") / F.sum("_n")).alias("avg_len"))
        )
        weighed = weighed.unionByName(asked.where("restricted").join(counted, ["query_id", "term"]).join(stats, "query_id"))
    weighed = weighed.withColumn("idf", idf)

    def score(held: Block, reached: dict[str, float]) -> Iterator[tuple]:
        for query, _, terms, seen in held.questions():
            sums, bound = [], 0.0
            for r in terms:
                bound += r.idf * r.max_tf * (K1 + 1.0) / (r.max_tf + K1 * (1.0 - B + B * r.min_len / r.avg_len))
            if bound < reached.get(query, 0.0) - 1e-6:
                continue
            for r in terms:
                sums.append((r.slot, r.idf * r.tf * (K1 + 1.0) / (r.tf + K1 * (1.0 - B + B * r.length / r.avg_len))))
            slot, value = _sum(sums)
            value = np.round(value, 9)
            some = value > 0 if seen is None else (value > 0) & seen[slot]
            slot, value = slot[some], value[some]
            slot, value = _best(slot, value, held.page[slot], held.page[slot], k)
            if k is not None and len(value) == k:
                reached[query] = max(reached.get(query, 0.0), float(value[-1]))
            yield query, slot, value, False

    return _scored(_with_questions(found, weighed, True, chosen, placed), score).drop("whole")


def page_best(hits: DataFrame, placed: DataFrame, k: int | None) -> DataFrame:
    """(query_id, asset_id, page_number, score, rank): first k pages by (-score, asset, page)."""
    found = hits.join(placed.select("workspace_id", "block", "slot", "asset_id", "page_number"), ["workspace_id", "block", "slot"])
    found = found.select("query_id", "asset_id", "page_number", "score")
    return found if k is None else top_per(found, ["query_id"], [F.desc("score"), F.col("asset_id"), F.col("page_number")], k)


def _run_rows(rows: DataFrame) -> DataFrame:
    """The row of runs of each block, without the texts."""
    return rows.where("field = 'run'").select("workspace_id", "block", "field", "term", "max_tf", "min_len", "units", "positions", "runs")


def _shares(rows: list[Row], seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots with the number of different terms they match."""
    slots_of: dict[str, list[np.ndarray]] = {}
    for row in rows:
        slots_of.setdefault(row.term, []).append(row.slot)
    parts = [np.unique(np.concatenate(s)) for s in slots_of.values()]
    slot, matched = _sum([(s, np.ones(len(s))) for s in parts])
    return (slot, matched) if seen is None else (slot[seen[slot]], matched[seen[slot]])


def _question_lists(queries: DataFrame, terms: Column) -> DataFrame:
    """(workspace_id, part, questions): up to about `BLOCK_QUERIES` questions of a workspace with their distinct terms and folded text."""
    closed = F.coalesce("restricted", F.lit(False)) if "restricted" in queries.columns else F.lit(False)
    listed = queries.select(
        "workspace_id", "query_id", closed.alias("restricted"), F.array_distinct(terms).alias("terms"), tx.casefold(F.col("text")).alias("question")
    ).where(F.size("terms") > 0)
    sizes = listed.groupBy("workspace_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("_n"))
    return listed.join(sizes, "workspace_id").groupBy("workspace_id", F.pmod(F.xxhash64("query_id"), F.col("_n")).alias("part")).agg(
        F.collect_list(F.struct("query_id", "restricted", "terms", "question")).alias("questions")
    )


def _scope_bits(queries: DataFrame, lists: DataFrame, placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(workspace_id, part, block, scopes): the asset numbers that each restricted question of a list may see, as bitmaps."""
    number = F.col("asset_no") + 1
    assets = placed.select("workspace_id", "asset_id", "block", "asset_no").distinct()
    asked = lists.select("workspace_id", "part", F.explode("questions").alias("q")).where("q.restricted").select("workspace_id", "part", "q.query_id")
    bits = (
        chosen.select("query_id", "asset_id").distinct().join(asked, "query_id").join(assets, ["workspace_id", "asset_id"])
        .groupBy("workspace_id", "part", "block", "query_id", F.bitmap_bucket_number(number).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    )
    return bits.groupBy("workspace_id", "part", "block").agg(
        F.collect_list(F.struct("query_id", ((F.col("_bucket") - 1) * 32_768).alias("base"), "bits")).alias("scopes")
    )


def simple_hits(queries: DataFrame, rows: DataFrame, placed: DataFrame, k: int, chosen: DataFrame | None = None) -> DataFrame:
    """k best locations per question and block by the share of matched terms, plus 1 where the whole question occurs.

    The question can only occur where all terms do; the texts of those units are read where they are stored, in the row
    of runs. Lists of questions are broadcast to these rows up to `BROADCAST_CHARS`, beyond that both sides are salted.
    `chosen`: (query_id, asset_id) of the questions marked `restricted`.
    """
    lists = _question_lists(queries, tx.lexical_terms(F.col("text")))
    runs = rows.where("field = 'run'").select("workspace_id", "block", "units", "positions", "runs", "texts")
    if (queries.agg(F.sum(F.length("text") + 64)).first()[0] or 0) <= BROADCAST_CHARS:
        met = runs.join(F.broadcast(lists), "workspace_id")
    else:
        salt = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("long")
        spread = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = runs.withColumn("_salt", salt).join(spread, ["workspace_id", "_salt"]).drop("_salt")
    if chosen is not None:
        met = met.join(_scope_bits(queries, lists, placed, chosen), ["workspace_id", "part", "block"], "left")

    def score(row: dict) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        units = np.frombuffer(row["units"].as_buffer(), np.int32).reshape(6, -1)
        slot, place, asset = units[0], units[4], units[5]
        questions, texts = row["questions"].as_py(), row["texts"].values
        terms = list(dict.fromkeys(t for q in questions for t in q["terms"]))
        number = {t: i for i, t in enumerate(terms)}
        asks = [np.array([number[t] for t in q["terms"]]) for q in questions]
        n = int(slot.max()) + 1
        matched = np.zeros((len(questions), n), np.int32)
        first = 0
        codes = np.frombuffer(row["positions"].as_buffer(), np.int32)
        for marks in _marks(terms, row["runs"].as_py(), slot, units[1], codes, n):
            for one, ask in zip(matched, asks):
                inside = ask[(ask >= first) & (ask < first + len(marks))] - first
                one += marks[inside].sum(0, dtype=np.int32)
            first += len(marks)
        seen: dict[str, np.ndarray] = {}
        for one in (row["scopes"].as_py() or []) if "scopes" in row else []:
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(one["bits"], np.uint8), bitorder="little")) + one["base"]
            seen[one["query_id"]] = np.isin(asset, bits) | seen.get(one["query_id"], False)
        for q, one in zip(questions, matched):
            size, some = len(q["terms"]), one[slot] > 0
            if q["restricted"]:
                some = some & seen.get(q["query_id"], np.zeros(len(slot), bool))
            at = np.flatnonzero(some)
            value = one[slot[at]] / size
            full = np.flatnonzero(value == 1.0)
            if size > 1 or q["terms"][0] != q["question"]:  # else its one term is the whole question
                full = full[[q["question"] in texts[i].as_py() for i in at[full].tolist()]] if len(full) else full
            value[full] += 1.0
            yield q["query_id"], *_best(slot[at], value, place[at], slot[at], k)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                found = list(score(row))
                n = sum(len(s) for _, s, _ in found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([q for q, s, _ in found for _ in range(len(s))], pa.string()), pa.array([row["workspace_id"].as_py()] * n, pa.string()),
                    pa.array(np.full(n, row["block"].as_py(), np.int64)), pa.array(np.concatenate([s for _, s, _ in found]).astype(np.int32)),
                    pa.array(np.concatenate([v for *_, v in found]).astype(np.float64)), pa.array([False] * n, pa.bool_()),
                ], schema=_HITS)

    return met.mapInArrow(best, _HITS_DDL).drop("whole")


def cover_density(lists: list[np.ndarray], every: bool = False) -> float:
    """Sum over the minimal covers of a unit: 0.1 for each, divided by 1 + the positions in it that hold no word asked for.

    `lists` has the positions of each word of the question that the unit holds. If one word is enough, as in a question
    of alternatives, every position is a cover of its own; if every word is needed, covers are the shortest
    stretches with all of them, found by one scan over the merged positions.
    """
    lists = [np.minimum(p[:WORD_POSITIONS], LAST_POSITION) for p in lists]
    if not every:
        return OCCURRENCE_WEIGHT * len(np.unique(np.concatenate(lists)))
    at = np.concatenate(lists)
    word = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
    order = np.lexsort((word, at))
    at, word = at[order], word[order]
    last: dict[int, int] = {}
    total, begun = 0.0, -1
    for i, (p, w) in enumerate(zip(at.tolist(), word.tolist())):
        last[w] = i
        if len(last) == len(lists):
            start = min(last.values())
            if start > begun:  # else the stretch before ended earlier with the same start
                begun = start
                noise = p - int(at[start]) - (i - start)
                total += OCCURRENCE_WEIGHT / (1 + (noise if noise >= 0 else (i - start) // 2))
    return total


def latin_hits(
    queries: DataFrame, rows: DataFrame, placed: DataFrame, k: int, every: bool = False, chosen: DataFrame | None = None
) -> DataFrame:
    """k best locations per question and block among units that hold a word of the question (or `every` word):
    share of its words found as substrings, 1 if it has one word, plus the density of covers."""
    words = asked_terms(queries, tx.latin_words(F.col("text")))
    tokens = rows.where("field = 'word'").join(words.select("workspace_id", "term").distinct(), ["workspace_id", "term"], "left_semi")
    def score(held: Block, _: dict[str, float]) -> Iterator[tuple]:
        for r in held.rows:
            if r.field == "word":
                r.spots = np.split(np.frombuffer(r.positions, np.int32), np.cumsum(r.tf)[:-1])
        for query, size, terms, seen in held.questions():
            spots: dict[int, list[np.ndarray]] = {}
            for r in terms:
                if r.field == "word":
                    for slot, where in zip(r.slot.tolist(), r.spots):
                        spots.setdefault(slot, []).append(where)
            slot = np.array([s for s in sorted(spots) if (seen is None or seen[s]) and (not every or len(spots[s]) == max(size, 1))], np.int64)
            if not len(slot):
                continue
            share = np.zeros(held.n)
            inside = [r for r in terms if r.field == "run"]
            if inside:
                at, matched = _shares(inside, None)
                share[at] = matched
            part = share[slot] / size if size > 1 else np.ones(len(slot))
            value = np.round(part + np.array([cover_density(spots[s], every) for s in slot.tolist()]), 9)
            best, value = _best(slot, value, held.place[slot], slot, k)
            yield query, best, value, False

    return _scored(_with_questions(tokens, words, False, chosen, placed, _run_rows(rows)), score).drop("whole")


def match_counts(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, n_units): units that hold any word of the question; the sets of slots are united block by block."""
    words = asked_terms(queries, tx.latin_words(F.col("text")))
    tokens = rows.where("field = 'word'").withColumn("positions", F.lit(None).cast("binary")).join(
        words.select("workspace_id", "term").distinct(), ["workspace_id", "term"], "left_semi"
    )

    def score(held: Block, _: dict[str, float]) -> Iterator[tuple]:
        for query, _, terms, _ in held.questions():
            n = len(np.unique(np.concatenate([r.slot for r in terms])))
            yield query, np.zeros(1, np.int64), np.array([float(n)]), False

    hits = _scored(_with_questions(tokens, words, False, None, rows), score)
    return hits.groupBy("query_id").agg(F.sum("score").cast("long").alias("n_units"))


def word_similarity(wanted: set[str], grams: list[str]) -> float:
    """Greatest similarity between a set of trigrams and any stretch of an ordered list of them.

    A best stretch starts and ends at a wanted trigram. For each start, running counts give the different
    trigrams, and the wanted ones among them, up to every end.
    """
    spots = np.array([i for i, g in enumerate(grams) if g in wanted], np.int64)
    if not len(spots):
        return 0.0
    before, seen = np.empty(len(grams), np.int64), {}
    for i, g in enumerate(grams):
        before[i] = seen.get(g, -1)
        seen[g] = i
    most = len({grams[i] for i in spots.tolist()})
    best = 0.0
    for n, start in enumerate(spots.tolist()):
        if min(most, len(spots) - n) / len(wanted) <= best:
            break  # fewer are left than have been found
        ends = spots[n:]
        different = np.cumsum(before[start : ends[-1] + 1] < start)[ends - start]
        shared = np.cumsum(before[ends] < start)
        best = max(best, float((shared / (len(wanted) + different - shared)).max()))
    return best


def word_grams(text: str) -> list[str]:
    """Trigrams of the words of a lower-cased text in order, each word padded by two blanks before and one after."""
    return [p[i : i + 3] for w in _WORD.findall(text) for p in [f"  {w} "] for i in range(len(w) + 1)]


def similar_hits(queries: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """k best locations per question and block by word similarity of the question to the text; all units take part.

    Questions come ahead of the units of each block in sorted partitions. What a unit can reach, the share of the
    question's trigrams that it has at all, is compared with the k-th best so far before its stretches are looked at.
    """
    lists = queries.groupBy("workspace_id").agg(
        F.collect_list("query_id").alias("ids"), F.collect_list(F.lower("text")).alias("texts")
    )
    empty = F.lit(None).cast("array<string>")
    units = placed.select(
        "workspace_id", "block", F.lit(1).alias("kind"), "slot", "place_no", F.lower("text").alias("text"), empty.alias("ids"), empty.alias("texts")
    ).join(lists.select("workspace_id"), "workspace_id", "left_semi")
    ahead = lists.join(placed.select("workspace_id", "block").distinct(), "workspace_id").select(
        "workspace_id", "block", F.lit(0).alias("kind"), F.lit(-1).alias("slot"), F.lit(-1).alias("place_no"),
        F.lit(None).cast("string").alias("text"), "ids", "texts",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, found, slots_, places = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            space, block = now
            out: list[list] = [[], [], []]
            slot, place = np.array(slots_, np.int32), np.array(places, np.int32)
            for (query, _), scores in zip(asked, found):
                best, value = _best(slot, np.round(np.array(scores), 9), place, slot, k)
                out[0] += [query] * len(best)
                out[1] += best.tolist()
                out[2] += value.tolist()
            n = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip([out[0], [space] * n, [block] * n, *out[1:], [False] * n], _HITS)], schema=_HITS
            )

        for batch in batches:
            for row in batch.to_pylist():
                at = (row["workspace_id"], row["block"])
                if at != now:
                    if slots_:
                        yield from done()
                    now, asked, slots_, places = at, [], [], []
                if row["kind"] == 0:
                    asked = [(i, set(word_grams(t or ""))) for i, t in zip(row["ids"], row["texts"])]
                    found, top = [[] for _ in asked], [{} for _ in asked]
                    continue
                slots_.append(row["slot"])
                places.append(row["place_no"])
                grams = word_grams(row["text"] or "")
                have = set(grams)
                for (_, wanted), scores, best in zip(asked, found, top):
                    reach = len(wanted & have) / len(wanted) if wanted else 0.0
                    least = min(best.values()) if len(best) == k else 0.0
                    value = word_similarity(wanted, grams) if reach > least else 0.0
                    scores.append(value)
                    if value > best.get(row["place_no"], 0.0):
                        best[row["place_no"]] = value
                        if len(best) > k:
                            del best[min(best, key=best.get)]
        if slots_:
            yield from done()

    dealt = ahead.unionByName(units).repartition("workspace_id", "block").sortWithinPartitions("workspace_id", "block", "kind", "slot")
    return dealt.mapInArrow(run, _HITS_DDL).drop("whole")


def production_hits(
    queries: DataFrame, rows: DataFrame, placed: DataFrame, k: int, chosen: DataFrame | None = None
) -> DataFrame:
    """The search of a production database: questions with an ASCII word by words and covers, others with a CJK
    term by word similarity, the rest without results."""
    latin = F.size(tx.latin_words(F.col("text"))) > 0
    other = queries.where(~latin & (F.size(tx.lexical_terms(F.col("text"))) > 0))
    return latin_hits(queries.where(latin), rows, placed, k, chosen=chosen).unionByName(similar_hits(other, placed, k))


def top_units(hits: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """Best item per location, then the first k by (-score, unit id)."""
    keyed = hits.join(
        placed.select("workspace_id", "block", "slot", "unit_id", "asset_id", "location_key"), ["workspace_id", "block", "slot"]
    )
    best = keyed.groupBy("query_id", "asset_id", "location_key").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "unit_id")).alias("b")
    ).select("query_id", "asset_id", "location_key", F.col("b.unit_id").alias("unit_id"), (-F.col("b.neg")).alias("score"))
    return top_per(best, ["query_id"], [F.desc("score"), F.col("unit_id")], k)

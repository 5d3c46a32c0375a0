"""Vector search for a table of queries: exact, sign-bit prefilter, and both combined.

The vectors of a workspace are dealt into blocks by asset, so an evidence location never spans two blocks and the
blocks do not depend on the order in which rows arrive. A block is one row: float vectors, their sign bits as 64-bit
words, and numbers of location and asset. Query blocks meet the blocks of their workspace; a task multiplies two blocks
as matrices, or counts the differing bits of two blocks of words, and keeps only k rows per query, so pairs of single
rows are never emitted. The query side is broadcast while it is small; otherwise both sides are joined on workspace and
salt, so that a workspace with most of the corpus is still worked on by many tasks. A query restricted to assets
brings a bitmap of asset numbers for each block; no vector is copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.scale import fits, top_per

BLOCK_ROWS = 2048
BROADCAST_BYTES = 64 << 20  # of query vectors
SALTS = 16
DIGITS = 9  # distances are rounded so that equal vectors tie on every machine

_BLOCK = "workspace_id string, ids array<string>, assets array<string>, places array<string>, vectors binary"


def pack(df: DataFrame, item: str, vector: str, dims: int, place: bool) -> DataFrame:
    """Blocks of up to BLOCK_ROWS vectors per workspace, items in ascending order.

    A vector of another length is stored as zeros, which puts it at distance 1.
    """
    asset = F.col("asset_id") if place else F.lit("")
    where = F.col("location_key") if place else F.lit("")
    source = df.select(
        "workspace_id", F.col(item).alias("item"), asset.alias("asset"), where.alias("place"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    schema = pa.schema(
        [("workspace_id", pa.string()), ("ids", pa.list_(pa.string())), ("assets", pa.list_(pa.string())),
         ("places", pa.list_(pa.string())), ("vectors", pa.binary())]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("workspace_id", "ascending"), ("item", "ascending")])
            if not table.num_rows:
                continue
            vectors = table["vector"].combine_chunks()
            good = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
            matrix = np.zeros((table.num_rows, dims))
            flat = pc.list_flatten(vectors.filter(good)).to_numpy(zero_copy_only=False)
            matrix[good.to_numpy(zero_copy_only=False)] = np.nan_to_num(flat).reshape(-1, dims)
            spaces = table["workspace_id"].to_pylist()
            names, assets, places = (table[c].to_pylist() for c in ("item", "asset", "place"))
            out: list[list] = [[], [], [], [], []]
            start = 0
            while start < len(spaces):
                stop = start
                while stop < len(spaces) and spaces[stop] == spaces[start] and stop - start < BLOCK_ROWS:
                    stop += 1
                row = (spaces[start], names[start:stop], assets[start:stop], places[start:stop],
                       matrix[start:stop].tobytes())
                for column, value in zip(out, row):
                    column.append(value)
                start = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(out, schema)], schema=schema
            )

    return source.mapInArrow(blocks, _BLOCK)


def _meet(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    q = queries.select(
        "workspace_id", F.col("ids").alias("q_ids"), F.col("places").alias("q_places"), F.col("vectors").alias("q_vectors")
    )
    return corpus.join(q, "workspace_id")


def _salted(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    spread = corpus.withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    q = queries.select(
        "workspace_id", F.col("ids").alias("q_ids"), F.col("places").alias("q_places"), F.col("vectors").alias("q_vectors"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"),
    )
    return spread.join(q, ["workspace_id", "_salt"]).drop("_salt")


def meet_blocks(queries: DataFrame, query_blocks: DataFrame, corpus_blocks: DataFrame, dims: int) -> DataFrame:
    """Query blocks next to the corpus blocks of their workspace; query vectors are broadcast up to
    `BROADCAST_BYTES`, a row having 8 bytes a dimension."""
    if fits(queries.select("query_id"), BROADCAST_BYTES // (8 * dims)):
        return _meet(F.broadcast(query_blocks), corpus_blocks)
    return _salted(query_blocks, corpus_blocks)


def _cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    qn = np.linalg.norm(q, axis=1)
    cn = np.linalg.norm(c, axis=1)
    scale = np.outer(qn, cn)
    similarity = np.divide(q @ c.T, scale, out=np.zeros(scale.shape), where=scale > 0)
    return np.round(1.0 - similarity, DIGITS)


BLOCK_VECTORS = 4_096
BLOCK_QUERIES = 256

_VECTORS_DDL = "workspace_id string, block long, wide boolean, places binary, assets binary, vectors binary, words binary"
_VECTORS = pa.schema([
    ("workspace_id", pa.string()), ("block", pa.int64()), ("wide", pa.bool_()), ("places", pa.binary()), ("assets", pa.binary()),
    ("vectors", pa.binary()), ("words", pa.binary()),
])
_ASKED_DDL = "workspace_id string, part long, ids array<string>, closed binary, asked binary"
_ASKED = pa.schema([
    ("workspace_id", pa.string()), ("part", pa.int64()), ("ids", pa.list_(pa.string())), ("closed", pa.binary()), ("asked", pa.binary()),
])
_FOUND_DDL = "query_id string, workspace_id string, block long, slot int, distance double"
_FOUND = pa.schema([
    ("query_id", pa.string()), ("workspace_id", pa.string()), ("block", pa.int64()), ("slot", pa.int32()), ("distance", pa.float64()),
])


def place(corpus: DataFrame, item: str = "unit_id") -> DataFrame:
    """`corpus` with the block and slot of each row; slots follow the item, so ties are broken by them."""
    sizes = corpus.groupBy("workspace_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).alias("_blocks"))
    rows = corpus.select("workspace_id", F.col(item).alias("item"), "asset_id", "location_key", "embedding").join(sizes, "workspace_id")
    space = Window.partitionBy("workspace_id", "block")
    numbers = {
        "slot": F.row_number().over(space.orderBy("item")), "place_no": F.dense_rank().over(space.orderBy("asset_id", "location_key")),
        "asset_no": F.dense_rank().over(space.orderBy("asset_id")),
    }
    return rows.withColumn("block", F.pmod(F.xxhash64("asset_id"), F.col("_blocks"))).drop("_blocks").withColumns(
        {name: (number - 1).cast("int") for name, number in numbers.items()}
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a list column as rows; one of another length, or null, is all zeros, which is at distance 1."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = pc.list_flatten(column.filter(good)).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), flat.dtype if flat.dtype == np.float32 else np.float64)
    out[good.to_numpy(zero_copy_only=False)] = np.nan_to_num(flat).reshape(-1, dims)
    return out


def _sign_words(matrix: np.ndarray) -> np.ndarray:
    bits = np.packbits(matrix > 0, axis=1, bitorder="little")
    out = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view(np.uint64)


def vector_blocks(placed: DataFrame, dims: int) -> DataFrame:
    """One row per block of placed vectors."""
    rows = placed.select("workspace_id", "block", "slot", "place_no", "asset_no", "embedding")
    rows = rows.repartition("workspace_id", "block").sortWithinPartitions("workspace_id", "block", "slot")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            matrix = _matrix(table["embedding"].combine_chunks(), dims)
            return pa.RecordBatch.from_pydict({
                "workspace_id": table["workspace_id"][:1].combine_chunks(), "block": table["block"][:1].combine_chunks(),
                "wide": [matrix.dtype == np.float64], "places": [table["place_no"].to_numpy().tobytes()],
                "assets": [table["asset_no"].to_numpy().tobytes()], "vectors": [matrix.tobytes()], "words": [_sign_words(matrix).tobytes()],
            }, schema=_VECTORS)

        for batch in batches:
            slot = batch.column("slot").to_numpy()
            cuts = [0, *np.flatnonzero(slot == 0).tolist(), len(slot)]
            for at, to in zip(cuts, cuts[1:]):
                if at < to:
                    if held and slot[at] == 0:  # every block begins with slot 0
                        yield done()
                        held.clear()
                    held.append(batch.slice(at, to - at))
        if held:
            yield done()

    return rows.mapInArrow(build, _VECTORS_DDL)


def _question_blocks(queries: DataFrame, dims: int) -> DataFrame:
    """Vectors of up to about `BLOCK_QUERIES` questions of a workspace in a row."""
    closed = F.coalesce("restricted", F.lit(False)) if "restricted" in queries.columns else F.lit(False)
    rows = _with_part(queries).groupBy("workspace_id", "part").agg(
        F.sort_array(F.collect_list(F.struct(
            "query_id", closed.alias("closed"), F.col("embedding").cast("array<double>").alias("embedding")
        ))).alias("_q")
    ).select("workspace_id", "part", "_q.query_id", "_q.closed", "_q.embedding")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                vectors = batch.column(4)[k].values
                shut = batch.column(3)[k].values.to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "workspace_id": batch.column(0).slice(k, 1), "part": batch.column(1).slice(k, 1), "ids": batch.column(2).slice(k, 1),
                    "closed": [shut.tobytes()], "asked": [_matrix(vectors, dims).tobytes()],
                }, schema=_ASKED)

    return rows.mapInArrow(build, _ASKED_DDL)


def _with_part(queries: DataFrame) -> DataFrame:
    sizes = queries.groupBy("workspace_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("_n"))
    return queries.join(sizes, "workspace_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("_n"))).drop("_n")


def _scopes(queries: DataFrame, placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per question block and block of vectors: a bitmap of the asset numbers that each restricted question may see."""
    number = F.col("asset_no") + 1
    assets = placed.select("workspace_id", "asset_id", "block", "asset_no").distinct()
    closed = _with_part(queries.where("restricted")).select("query_id")
    asked = _with_part(queries).select("query_id", "workspace_id", "part").join(closed, "query_id", "left_semi")
    bits = (
        chosen.select("query_id", "asset_id").distinct().join(asked, "query_id").join(assets, ["workspace_id", "asset_id"])
        .groupBy("workspace_id", "part", "block", "query_id", F.bitmap_bucket_number(number).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    )
    return bits.groupBy("workspace_id", "part", "block").agg(
        F.collect_list(F.struct("query_id", ((F.col("_bucket") - 1) * 32_768).alias("base"), "bits")).alias("scopes")
    )


def _hamming_words(q: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Differing sign bits of every question and vector, one word at a time."""
    asked = _sign_words(q)
    out = np.zeros((len(asked), len(words)), np.int32)
    for k in range(words.shape[1]):
        out += np.bitwise_count(asked[:, k, None] ^ words[None, :, k])
    return out


def _search(
    queries: DataFrame, placed: DataFrame, blocks: DataFrame, dims: int, k: int, metric: str, distinct: bool, chosen: DataFrame | None
) -> DataFrame:
    """k best rows (or locations) per question and block, by (distance, item)."""
    data = ["workspace_id", "block", "places", "assets", *(["words"] if metric == "hamming" else ["wide", "vectors"])]
    asked = _question_blocks(queries, dims)
    if fits(queries.select("query_id"), BROADCAST_BYTES // (8 * dims)):
        met = blocks.select(*data).join(F.broadcast(asked), "workspace_id")
    else:
        salt = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("long")
        spread = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = blocks.select(*data, salt.alias("_salt")).join(spread, ["workspace_id", "_salt"]).drop("_salt")
    if chosen is not None:
        met = met.join(_scopes(queries, placed, chosen), ["workspace_id", "part", "block"], "left")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                places = np.frombuffer(row["places"].as_buffer(), np.int32)
                q = np.frombuffer(row["asked"].as_buffer(), np.float64).reshape(-1, dims)
                if metric == "hamming":
                    table = _hamming_words(q, np.frombuffer(row["words"].as_buffer(), np.uint64).reshape(len(places), -1))
                else:
                    kind = np.float64 if row["wide"].as_py() else np.float32
                    c = np.frombuffer(row["vectors"].as_buffer(), kind).reshape(-1, dims).astype(np.float64)
                    table = _cosine(q, c)
                ids = row["ids"].as_py()
                closed = np.frombuffer(row["closed"].as_buffer(), np.uint8)
                seen: dict[str, np.ndarray] = {}
                if closed.any():
                    assets = np.frombuffer(row["assets"].as_buffer(), np.int32)
                    for one in (row["scopes"].as_py() or []) if "scopes" in row else []:
                        bits = np.flatnonzero(np.unpackbits(np.frombuffer(one["bits"], np.uint8), bitorder="little")) + one["base"]
                        seen[one["query_id"]] = np.isin(assets, bits) | seen.get(one["query_id"], False)
                slots, owners, distances = [], [], []
                for n, (query, line) in enumerate(zip(ids, table)):
                    rows = np.arange(len(line))
                    if closed[n]:
                        rows = np.flatnonzero(seen.get(query, np.zeros(len(line), bool)))
                    if not distinct and len(rows) > k:
                        least = np.partition(line[rows], k - 1)[k - 1]
                        rows = rows[line[rows] <= least]
                    order = rows[np.argsort(line[rows], kind="stable")]
                    if distinct:
                        _, first = np.unique(places[order], return_index=True)
                        order = order[np.sort(first)]
                    order = order[:k]
                    slots.append(order)
                    distances.append(line[order])
                    owners += [query] * len(order)
                n = len(owners)
                yield pa.RecordBatch.from_arrays([
                    pa.array(owners, pa.string()), pa.array([row["workspace_id"].as_py()] * n, pa.string()),
                    pa.array(np.full(n, row["block"].as_py(), np.int64)), pa.array(np.concatenate(slots).astype(np.int32)),
                    pa.array(np.concatenate(distances).astype(np.float64)),
                ], schema=_FOUND)

    found = met.mapInArrow(best, _FOUND_DDL)
    where = placed.select("workspace_id", "block", "slot", F.col("item").alias("unit_id"), "asset_id", "location_key")
    return found.join(where, ["workspace_id", "block", "slot"]).drop("workspace_id", "block", "slot")


def _hits(
    queries: DataFrame, corpus: DataFrame, item: str, dims: int, k: int, metric: str, distinct: bool, chosen: DataFrame | None = None,
    stored: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    placed, blocks = stored or (None, None)
    if placed is None:
        placed = place(corpus, item)
        blocks = vector_blocks(placed, dims)
    return _search(queries, placed, blocks, dims, k, metric, distinct, chosen)


def top_locations(
    queries: DataFrame, corpus: DataFrame, dims: int, k: int, chosen: DataFrame | None = None,
    stored: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """First k evidence locations per query by (cosine distance, unit id), one unit per location.

    queries: query_id, workspace_id, embedding; with `chosen` (query_id, asset_id) also restricted. corpus: unit_id,
    workspace_id, asset_id, location_key, embedding. `stored`: `place` and `vector_blocks` of the corpus, where kept.
    """
    hits = _hits(queries, corpus, "unit_id", dims, k, "cosine", True, chosen, stored)
    best = hits.groupBy("query_id", "asset_id", "location_key").agg(
        F.min(F.struct("distance", "unit_id")).alias("b")
    ).select("query_id", "asset_id", "location_key", "b.unit_id", "b.distance")
    return top_per(best, ["query_id"], [F.col("distance"), F.col("unit_id")], k)


def top_rows(
    queries: DataFrame, corpus: DataFrame, item: str, dims: int, k: int, metric: str, stored: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """First k rows per query by (distance, item), locations not merged."""
    hits = _hits(queries, corpus, item, dims, k, metric, False, None, stored)
    ranked = top_per(hits, ["query_id"], [F.col("distance"), F.col("unit_id")], k)
    return ranked.withColumnRenamed("unit_id", item) if item != "unit_id" else ranked


def cosine_distance(left: Column, right: Column) -> Column:
    """1 - cosine; 1 when lengths differ or a vector is all zeros. NaN counts as 0, as in blocks."""

    def dot(a: Column, b: Column) -> Column:
        product = lambda x, y: F.nanvl(x.cast("double"), F.lit(0.0)) * F.nanvl(y.cast("double"), F.lit(0.0))
        return F.aggregate(F.zip_with(a, b, product), F.lit(0.0), lambda s, v: s + v)

    similarity = F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))
    return F.when(F.size(left) == F.size(right), F.round(1.0 - F.coalesce(similarity, F.lit(0.0)), DIGITS)).otherwise(1.0)


def sign_bits(vector: Column) -> Column:
    """Sign bit of each dimension as text of zeros and ones."""
    return F.array_join(F.transform(vector, lambda v: F.when(v > 0, "1").otherwise("0")), "")


def sign_words(vector: Column) -> Column:
    """Sign bits packed into 64-bit words; distances are bit_count(xor)."""
    words = F.sequence(F.lit(0), ((F.size(vector) - 1) / 64).cast("int"))
    return F.transform(
        words,
        lambda w: F.aggregate(
            F.transform(
                F.slice(vector, w * 64 + 1, F.lit(64)),
                lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(
                    F.lit(0).cast("long")
                ),
            ),
            F.lit(0).cast("long"),
            lambda s, v: s.bitwiseOR(v),
        ),
    )


def candidate_locations(
    queries: DataFrame, corpus: DataFrame, dims: int, n: int, metric: str, stored: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(query_id, unit_id): the best unit of each of the first n locations under `metric`.

    Counting locations instead of rows means that copies of one passage cannot fill the window, so no
    window has to be widened afterwards.
    """
    hits = _hits(queries, corpus, "unit_id", dims, n, metric, True, None, stored)
    best = hits.groupBy("query_id", "asset_id", "location_key").agg(
        F.min(F.struct("distance", "unit_id")).alias("b")
    ).select("query_id", "b.unit_id", "b.distance")
    return top_per(best, ["query_id"], [F.col("distance"), F.col("unit_id")], n).select("query_id", "unit_id")


def top_approximate(
    queries: DataFrame, corpus: DataFrame, dims: int, n: int, k: int, multiplier: int = 3,
    stored: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Cosine-n and sign-bit multiplier*n candidates, distinct, re-ranked exactly, first k locations."""
    near = candidate_locations(queries, corpus, dims, n, "cosine", stored)
    bits = candidate_locations(queries, corpus, dims, multiplier * n, "hamming", stored)
    return rerank(queries, corpus, near.union(bits).distinct(), k)


def rerank(queries: DataFrame, corpus: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    scored = (
        candidates.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
        .join(corpus.select("unit_id", "asset_id", "location_key", "embedding"), "unit_id")
        .withColumn("distance", cosine_distance(F.col("_q"), F.col("embedding")))
    )
    best = scored.groupBy("query_id", "asset_id", "location_key").agg(
        F.min(F.struct("distance", "unit_id")).alias("b")
    ).select("query_id", "asset_id", "location_key", "b.unit_id", "b.distance")
    return top_per(best, ["query_id"], [F.col("distance"), F.col("unit_id")], k)


_COUNTS = pa.schema([("query_id", pa.string()), ("n_rows", pa.int64()), ("n_upto", pa.int64())])


def rows_upto(queries: DataFrame, corpus: DataFrame, limits: DataFrame, dims: int) -> DataFrame:
    """Per query: corpus rows in scope, and rows not behind the limit (distance, unit id).

    limits: query_id, limit_distance, limit_unit; the limit travels with the query block.
    """
    joined = queries.join(limits, "query_id", "left").withColumn(
        "location_key",
        F.concat_ws("\u0001", F.coalesce("limit_distance", F.lit(-1.0)).cast("string"), F.coalesce("limit_unit", F.lit(""))),
    ).withColumn("asset_id", F.lit(""))
    q = pack(joined, "query_id", "embedding", dims, place=True)
    c = pack(corpus, "unit_id", "embedding", dims, place=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"]).reshape(-1, dims)
                table = _cosine(np.frombuffer(row["q_vectors"]).reshape(-1, dims), vectors)
                ids = np.array(row["ids"], dtype=object)
                out = []
                for query, limit, line in zip(row["q_ids"], row["q_places"], table):
                    far, unit = limit.split("\u0001")
                    far = float(far)
                    inside = (line < far) | ((line == far) & (ids <= unit))
                    out.append((query, len(ids), int(inside.sum())))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(v), type=f.type) for v, f in zip(columns, _COUNTS)], schema=_COUNTS
                )

    met = meet_blocks(queries, q, c, dims)
    counted = met.mapInArrow(count, "query_id string, n_rows long, n_upto long")
    return counted.groupBy("query_id").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_upto").alias("n_upto"))


def window_rounds(top: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """Rounds a doubling candidate window would take, and the rows it would rank in total."""
    found = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_locations"))
    joined = counts.join(found, "query_id", "left").fillna(0, ["n_locations"])
    need = F.when(F.col("n_locations") >= limit, F.col("n_upto")).otherwise(F.col("n_rows") + 1)
    extra = F.greatest(F.lit(0), F.ceil(F.log2(need / limit) - 1e-12)).cast("int")
    rounds = joined.withColumn("rounds", extra + 1)
    sizes = F.transform(
        F.sequence(F.lit(0), F.col("rounds") - 1),
        lambda i: F.least(F.col("n_rows"), (F.pow(F.lit(2.0), i) * limit).cast("long")),
    )
    return rounds.withColumn("rows_ranked", F.aggregate(sizes, F.lit(0).cast("long"), lambda s, v: s + v))


def label_probes(vectors: DataFrame, dims: int) -> DataFrame:
    """One probe per workspace and label: the mean vector, as query_id, workspace_id, label, embedding."""
    mean = F.array(*[F.round(F.avg(F.col("embedding")[i].cast("double")), DIGITS) for i in range(dims)])
    return vectors.groupBy("workspace_id", "label").agg(mean.alias("embedding")).withColumn(
        "query_id", F.concat("workspace_id", F.lit("#"), F.col("label").cast("string"))
    )

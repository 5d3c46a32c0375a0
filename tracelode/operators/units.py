"""Builders: pages and pictures to units, representations, embeddings, migration of older tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.functions import records as rc
from tracelode.functions import text as tx
from tracelode.operators import ranges as rg

# Which generator writes each representation kind.
GENERATORS = {
    "pdf_page_layout": "pdf-layout-v1", "pdf_ocr": "rapidocr-region-v1", "pdf_table": "pymupdf-table-v1",
    "pdf_figure": "pymupdf-figure-v1",
}
EMBED_BATCH = 32


def merge_ranges(ranges: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Join neighbouring ranges (s, e) with nothing but white space between them.

    The ranges of one page are bounded by its text.
    """
    order = Window.partitionBy(key).orderBy("s")
    gap = F.expr("substring(text, _pe + 1, s - _pe)")
    cut = ranges.join(texts, key).withColumn("_pe", F.lag("e").over(order))
    glued = F.coalesce(F.rlike(gap, F.lit(f"^[{tx.SPACE}]+$")), F.lit(False))
    grouped = cut.withColumn("_new", F.when(glued, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order))
    return grouped.groupBy(key, "_g").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n_ranges")
    ).drop("_g")


def line_offsets(lines: DataFrame, key: str) -> DataFrame:
    """Trimmed non-blank lines joined by line breaks: range of each in the joined text."""
    kept = lines.withColumn("line", tx.strip(F.col("line"))).where(F.col("line") != "")
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("line_no"))
    return kept.withColumn("char_end", upto - 1).withColumn("char_start", F.col("char_end") - F.length("line"))


def pdf_units(pages: DataFrame, regions: DataFrame, artifacts: DataFrame, size: int = tx.CHUNK_SIZE) -> DataFrame:
    """Units of PDF pages.

    pages: page_id, source_kind (layout or ocr), text. regions: page_id, region_start, region_end.
    artifacts: page_id, artifact_order, unit_kind, text, s, e (one row per character range).
    Layout pages are chunked with artifact ranges blanked; an OCR chunk whose visible characters all
    lie in regions becomes a region unit; artifacts become units of their own without offsets.
    """
    masks = artifacts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_ranges"))
    masked = pages.join(masks, "page_id", "left").withColumn(
        "_chunked",
        F.when(
            (F.col("source_kind") == "layout") & F.col("_ranges").isNotNull(), rc.mask_ranges(F.col("text"), F.col("_ranges"))
        ).otherwise(F.col("text")),
    )
    chunks = tx.chunk(masked, "_chunked", ["page_id", "source_kind"], size)
    spans = chunks.where(F.col("source_kind") == "ocr").select("page_id", "char_start", "char_end").join(
        pages.select("page_id", F.col("text").alias("_page")), "page_id"
    ).select("page_id", "char_start", "char_end", F.expr("substring(_page, char_start + 1, char_end - char_start)").alias("_span"))
    covered = rg.char_coverage(spans, regions, "page_id", "_span").select("page_id", "char_start", "covered")
    text_units = chunks.join(covered, ["page_id", "char_start"], "left").select(
        "page_id", F.when(F.col("covered"), "pdf_ocr_region").otherwise("pdf_text_chunk").alias("unit_kind"), "unit_order",
        "text", tx.token_estimate(F.col("text")).alias("token_count"), "char_start", "char_end",
    )
    artifact_units = artifacts.select("page_id", "artifact_order", "unit_kind", "text").distinct().select(
        "page_id", "unit_kind", F.col("artifact_order").cast("int").alias("unit_order"), "text",
        tx.token_estimate(F.col("text")).alias("token_count"),
        F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"),
    )
    return text_units.unionByName(artifact_units)


def image_units(regions: DataFrame, captions: DataFrame) -> DataFrame:
    """One unit per recognised region plus one caption unit over the whole picture.

    regions: asset_id, region_order, text, x, y, width, height. captions: asset_id, caption.
    """
    read = regions.where(tx.strip(F.col("text")) != "").select(
        "asset_id", F.lit("image_ocr_region").alias("unit_kind"), F.col("region_order").alias("unit_order"),
        tx.strip(F.col("text")).alias("text"), "x", "y", "width", "height",
    )
    whole = captions.where(tx.strip(F.col("caption")) != "").select(
        "asset_id", F.lit("image_caption").alias("unit_kind"), F.lit(0).cast("long").alias("unit_order"),
        tx.strip(F.col("caption")).alias("text"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
        F.lit(1.0).alias("width"), F.lit(1.0).alias("height"),
    )
    both = read.unionByName(whole)
    return both.withColumn("token_count", tx.token_estimate(F.col("text")))


def representations(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Representation rows a generation needs: layout always, the others only when present.

    pages: asset_id, generation, source_kind. artifacts: asset_id, generation, unit_kind.
    """
    layout = pages.select("asset_id", "generation", F.lit("pdf_page_layout").alias("representation_kind"))
    ocr = pages.where(F.col("source_kind") == "ocr").select("asset_id", "generation", F.lit("pdf_ocr").alias("representation_kind"))
    found = artifacts.select("asset_id", "generation", F.col("unit_kind").alias("representation_kind"))
    version = F.create_map(*[F.lit(v) for pair in GENERATORS.items() for v in pair])
    return layout.union(ocr).union(found).distinct().withColumn(
        "generator_version", F.element_at(version, F.col("representation_kind"))
    )


Embedder = Callable[[list[str]], list[list[float]]]

#: What stands before the text of a question (fixed value).
QUERY_FORM = "Instruct: {instruction}\nQuery: "


def hashing_embedder(dimensions: int) -> Embedder:
    """Deterministic stand-in for a model: signed word hashes, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for body in texts:
            vector = np.zeros(dimensions)
            for word in body.lower().split():
                digest = hashlib.md5(word.encode()).digest()
                vector[int.from_bytes(digest[:4], "big") % dimensions] += 1.0 if digest[4] % 2 else -1.0
            size = np.linalg.norm(vector)
            out.append((vector / size if size else vector).tolist())
        return out

    return embed


def embed(units: DataFrame, embedder: Embedder, dimensions: int, batch: int = EMBED_BATCH) -> DataFrame:
    """(unit_id, embedding) through `embedder` in small batches; a wrong count or length fails."""
    schema = T.StructType([T.StructField("unit_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                piece = part.iloc[at : at + batch]
                vectors = embedder(piece["text"].tolist())
                if len(vectors) != len(piece):
                    raise ValueError("embedding_invalid_response: wrong number of vectors")
                if any(len(v) != dimensions for v in vectors):
                    raise ValueError("embedding_invalid_response: wrong vector length")
                yield pd.DataFrame({"unit_id": piece["unit_id"].to_numpy(), "embedding": vectors})

    return units.select("unit_id", "text").mapInPandas(run, schema)


def embed_queries(queries: DataFrame, embedder: Embedder, dimensions: int, instruction: str, batch: int = EMBED_BATCH) -> DataFrame:
    """(query_id, embedding): questions are embedded behind the instruction that tells the model they are such; texts of
    units have none."""
    asked = F.concat(F.lit(QUERY_FORM.format(instruction=instruction)), F.coalesce("text", F.lit("")))
    rows = queries.select(F.col("query_id").cast("string").alias("unit_id"), asked.alias("text"))
    return embed(rows, embedder, dimensions, batch).withColumnRenamed("unit_id", "query_id")


CONFIG = ["embedding_space", "provider", "model", "version"]


def publish_embeddings(existing: DataFrame, units: DataFrame, vectors: DataFrame, config: dict[str, str]) -> DataFrame:
    """Embedding table after a run.

    Rows of the same units and configuration are replaced; current rows of the affected assets with an
    older generation or index are demoted; the new rows become current together.
    units: unit_id, workspace_id, asset_id, generation, index_version.
    """
    same = units.select("unit_id", *[F.lit(config[c]).alias(c) for c in CONFIG])
    kept = existing.join(same, ["unit_id", *CONFIG], "left_anti")
    pointer = units.groupBy("asset_id").agg(F.max("generation").alias("_g"), F.max("index_version").alias("_i"))
    demoted = kept.join(pointer, "asset_id", "left").withColumn(
        "is_current",
        F.col("is_current")
        & (F.col("_g").isNull() | ((F.col("generation") == F.col("_g")) & (F.col("index_version") == F.col("_i")))),
    ).drop("_g", "_i")
    fresh = units.join(vectors, "unit_id").select(
        "unit_id", "workspace_id", "asset_id", "generation", "index_version", F.lit(True).alias("is_current"),
        *[F.lit(config[c]).alias(c) for c in CONFIG], "embedding",
    )
    return demoted.select(*fresh.columns).unionByName(fresh)


def current_backfill(embeddings: DataFrame, chained: DataFrame) -> DataFrame:
    """Scope columns and is_current from the chain; rows without a sound chain keep nulls.

    chained: units with representation_generation, locator_generation, current_generation, current_index.
    """
    sound = chained.where(F.col("locator_generation") == F.col("representation_generation")).select(
        "unit_id", "workspace_id", "asset_id", F.col("locator_generation").alias("generation"), "index_version",
        ((F.col("locator_generation") == F.col("current_generation")) & (F.col("index_version") == F.col("current_index"))).alias("is_current"),
    )
    return embeddings.join(sound, ["unit_id", "workspace_id"], "left").withColumn(
        "is_current", F.coalesce("is_current", F.lit(False))
    )


def migration_gaps(chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """Rows of the old tables that cannot be migrated, per rule."""
    with_vector = F.col("embedding").isNotNull()
    incomplete = F.col("dimensions").isNull() | F.col("provider").isNull() | F.col("version").isNull()
    a = chunks.agg(F.count_if(with_vector & incomplete).alias("n")).select(F.lit("embedding_configuration").alias("rule"), "n")
    b = citations.agg(F.count_if(F.col("document_id").isNull() | F.col("page_number").isNull()).alias("n")).select(
        F.lit("citation_snapshot").alias("rule"), "n"
    )
    return a.unionByName(b)


def migrate_chunks(documents: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Old document chunks as units with their representation and a page locator of a derived id.

    A chunk whose page is gone keeps its unit without a page number.
    """
    numbered = chunks.join(pages.select("page_id", "page_number"), "page_id", "left")
    return numbered.join(documents.select("document_id", "workspace_id", "generation"), "document_id").select(
        F.col("chunk_id").alias("unit_id"), "workspace_id", F.col("document_id").alias("asset_id"),
        F.col("document_id").alias("representation_id"),
        rc.stable_uuid("content-unit", F.col("chunk_id")).alias("locator_id"),
        F.lit("pdf_text_chunk").alias("unit_kind"), F.lit("pdf_page").alias("locator_kind"), "page_number", "generation",
        F.when(F.col("embedding").isNotNull(), rc.stable_uuid("embedding", F.col("chunk_id"))).alias("embedding_id"),
    )



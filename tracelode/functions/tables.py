"""Table functions, callable from SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult

from tracelode.functions.text import CHUNK_SIZE, MAX_CHUNK_SIZE, MIN_CHUNK_SIZE, chunk_spans


class ChunkText:
    """SELECT * FROM chunk_text(TABLE(pages) PARTITION BY asset_id ORDER BY page_number[, size => 400])

    The table has a column `text`; all others are carried along, so their names must not be those added: unit_order,
    char_start, char_end. Chunks are counted over the rows of a partition in their order; offsets are those of a row.
    Null and blank texts give no chunk.
    """

    def __init__(self) -> None:
        self.order = 0

    @staticmethod
    def analyze(pages: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(pages.dataType, T.StructType) or "text" not in pages.dataType.names:
            raise ValueError("chunk_text needs a table argument with a column text")
        added = {"unit_order", "char_start", "char_end"} & set(pages.dataType.names)
        if added:
            raise ValueError(f"chunk_text adds {sorted(added)}; the table has them already")
        if size is not None and not (isinstance(size.value, int) and MIN_CHUNK_SIZE <= size.value <= MAX_CHUNK_SIZE):
            raise ValueError(f"chunk size must be within {MIN_CHUNK_SIZE}..{MAX_CHUNK_SIZE}")
        schema = T.StructType([f for f in pages.dataType.fields if f.name != "text"])
        for name in ("unit_order", "char_start", "char_end"):
            schema = schema.add(name, T.IntegerType())
        return AnalyzeResult(schema.add("text", T.StringType()))

    def eval(self, row: Row, size: int = CHUNK_SIZE) -> Iterator[tuple]:
        body = row["text"] or ""
        carried = tuple(value for name, value in zip(row.__fields__, row) if name != "text")
        for start, end in chunk_spans(body, size):
            piece = body[start:end].strip()
            if piece:
                yield *carried, self.order, start, end, piece
                self.order += 1


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("chunk_text", udtf(ChunkText))

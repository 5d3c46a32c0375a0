"""Counting, distributions, fingerprints, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.scale import hot_percentiles

# Fixed values.
JOB_STATUSES = ["queued", "running", "succeeded", "failed", "cancelled"]
RETRIEVAL_SECONDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.15, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
RETRIEVAL_RESULTS = [0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 10.0, 20.0]


def literal_rows(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """A fixed list as a table, built on the session of `df`."""
    spark = df.sparkSession
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def counts_per(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Row counts of each child table per parent key, 0 when absent."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return out.fillna(0, list(children))


def counts_over(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Counts of the wanted values in their order, zero-filled."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return literal_rows(df, column, wanted).join(counted, column, "left").fillna(0, ["n"])


def thread_rollup(messages: DataFrame, titles: DataFrame | None = None, title_chars: int = 80) -> DataFrame:
    """Title = the stored one (thread_id, title) unless blank, else the first question cut short; last position =
    latest message."""
    question = F.when(F.col("role") == "user", F.struct("turn", "message_id"))
    rolled = messages.groupBy("thread_id").agg(
        F.substring(F.min_by("content", question), 1, title_chars).alias("title"),
        F.max("turn").alias("last_turn"),
        F.count(F.lit(1)).alias("n_messages"),
    )
    if titles is None:
        return rolled
    kept = titles.select("thread_id", F.nullif(F.trim("title"), F.lit("")).alias("_stored"))
    return rolled.join(kept, "thread_id", "left").select(
        "thread_id", F.coalesce("_stored", "title").alias("title"), "last_turn", "n_messages"
    )


def next_attempt(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("asset_id", "job_type").agg((F.max("attempt") + 1).alias("next_attempt"))


def embed_status(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """"ready" when every current unit of the asset has a current vector, else "chunked"."""
    embedded = vectors.select(
        "unit_id", "asset_id", "workspace_id", F.col("generation").alias("current_generation"),
        F.col("index_version"), F.lit(True).alias("_has"),
    ).dropDuplicates(["unit_id", "asset_id", "workspace_id", "current_generation", "index_version"])
    joined = units.join(
        embedded, ["unit_id", "asset_id", "workspace_id", "current_generation", "index_version"], "left"
    )
    return joined.groupBy("asset_id").agg(
        F.when(F.bool_and(F.col("_has").isNotNull()), "ready").otherwise("chunked").alias("available_status"),
        F.count(F.lit(1)).alias("n_units"),
    )


def distribution(df: DataFrame, value: str, fractions: dict[str, float | str], keys: Sequence[str] = ()) -> DataFrame:
    """mean/min/max plus exact order statistics, per key or over everything."""
    keyed = df if keys else df.withColumn("_all", F.lit(1))
    by = list(keys) or ["_all"]
    base = keyed.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )
    return base.join(hot_percentiles(keyed, by, value, fractions), by).drop("_all")


#: 2 to the 52nd: what is behind the point of a double, taken apart exactly.
_FINE = 4_503_599_627_370_496


def cell_text(name: str, kind: str) -> str:
    """SQL for a column as text that differs whenever the value does; kinds as in Spark's type names.

    A double is its floor and two times 52 bits behind the point, so no engine's way to print it matters.
    """
    if kind in ("double", "float"):
        x = f"CAST({name} AS DOUBLE)"
        rest = f"({x} - floor({x}))"
        parts = [f"floor({x})", f"floor({rest} * {_FINE})", f"floor(({rest} * {_FINE} - floor({rest} * {_FINE})) * {_FINE})"]
        whole = "CONCAT(" + ", '.', ".join(f"CAST(CAST({p} AS BIGINT) AS STRING)" for p in parts) + ")"
        return f"CASE WHEN isnan({x}) THEN 'nan' WHEN abs({x}) >= 9e18 THEN CAST({x} AS STRING) ELSE {whole} END"
    if kind == "string":
        return f"CONCAT(CAST(LENGTH({name}) AS STRING), ':', {name})"
    if kind.startswith("timestamp"):
        return f"CAST(unix_micros(CAST({name} AS TIMESTAMP)) AS STRING)"
    if kind.startswith("array<"):
        return f"array_join(transform({name}, x -> COALESCE({cell_text('x', kind[6:-1])}, '~')), ',')"
    return f"CAST({name} AS STRING)"


def row_halves(df: DataFrame) -> list[Column]:
    """The 128-bit digest of a row over all its columns, as two unsigned halves."""
    cells = ", ".join(f"COALESCE({cell_text(f'`{f.name}`', f.dataType.simpleString())}, '~')" for f in df.schema)
    digest = F.md5(F.expr(f"CONCAT_WS('|', {cells})"))
    return [F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Order-free content digest of all columns: row count, and the sums of both halves of the row digests.

    Sums of parts add up to that of the whole, and what is taken away can be subtracted.
    """
    high, low = row_halves(df)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(high), F.lit(0)).cast("decimal(38,0)").alias("high"),
        F.coalesce(F.sum(low), F.lit(0)).cast("decimal(38,0)").alias("low"),
    ).select(F.lit(name).alias("table_name"), "n_rows", "high", "low")


def updated_fingerprint(known: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The fingerprint after some rows of a table were replaced, from its old one and those rows alone."""
    name = known.first()["table_name"]
    parts = known.unionByName(fingerprint(added, name)).unionByName(
        fingerprint(removed, name).select("table_name", *[(-F.col(c)).alias(c) for c in ("n_rows", "high", "low")])
    )
    return parts.groupBy("table_name").agg(*[F.sum(c).alias(c) for c in ("n_rows", "high", "low")]).select(
        "table_name", "n_rows", *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("high", "low")]
    )


def histogram(df: DataFrame, labels: Sequence[str], value: Column, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per upper bound.

    Rows are counted by their own bucket first; only those few counts are spread over the bounds.
    """
    index = F.lit(0)
    for bound in bounds:
        index = index + (value > bound).cast("int")
    own = df.groupBy(*labels, index.alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    limits = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(b)).alias("le")) for i, b in enumerate(bounds)])
    spread = own.select(*labels, "_i", "_n", F.explode(limits).alias("_b"))
    return spread.groupBy(*labels, F.col("_b.le").alias("le")).agg(
        F.sum(F.when(F.col("_b.i") >= F.col("_i"), F.col("_n")).otherwise(0)).alias("n")
    )


def run_stability(log: DataFrame, expected: DataFrame) -> DataFrame:
    """Requests, completions, errors, error kinds, drift against the expected results, throughput."""
    joined = log.join(expected.select("case_id", F.col("result_hash").alias("_expected")), "case_id", "left")
    failed = F.col("error_type").isNotNull()
    base = joined.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~failed).alias("completed"),
        F.count_if(failed).alias("errors"),
        F.count_if(~failed & ~F.col("result_hash").eqNullSafe(F.col("_expected"))).alias("drifted"),
        F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_t0"),
        F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_t1"),
    )
    kinds = (
        log.where(failed).groupBy("strategy", "error_type").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("strategy").agg(F.array_join(F.array_sort(F.collect_set("error_type")), ",").alias("error_types"))
    )
    wall = (F.col("_t1") - F.col("_t0")) / 1e6
    return (
        base.join(kinds, "strategy", "left")
        .withColumn("throughput", F.when(wall > 0, F.col("completed") / wall).otherwise(0.0))
        .drop("_t0", "_t1")
    )

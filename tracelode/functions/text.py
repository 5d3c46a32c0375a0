"""Text functions: chunk spans, tokens, terms, normal forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
CHUNK_SIZE = 1200
CHUNK_OVERLAP = 200
MIN_CHUNK_SIZE = 200
MAX_CHUNK_SIZE = 4000
CJK = "\\u3400-\\u9fff"
SPACE = "\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u001c-\\u001f"
#: Letters after the sharp s that full case folding may change in a lower-cased text lie in these ranges.
LATE_FOLDS = "[\u0149-\u1fff\ua640-\uabff\ufb00-\ufb17\U00010400-\U0001e943]"


@lru_cache(1)
def _folded() -> dict[str, str]:
    """Lower-case characters that full case folding changes further, to one character or to several."""
    letters = (c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff")
    return {c: c.casefold() for c in letters if c.lower() == c and c.casefold() != c}


def chunk_spans(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Half-open spans of at most `size` code points that prefer to end at a line or word break."""
    total, half, keep = len(text), size // 2, min(CHUNK_OVERLAP, max(1, size // 2))
    at = 0
    while at < total:
        stop = at + size
        if stop >= total:
            yield at, total
            return
        for mark in ("\n", " "):
            cut = text.rfind(mark, at + half, stop)
            if cut > at:
                stop = cut
                break
        yield at, stop
        at = max(stop - keep, at + 1)


def chunk(df: DataFrame, text: str, carry: list[str], size: int = CHUNK_SIZE) -> DataFrame:
    """One row per non-blank chunk: carried columns, unit_order, char_start, char_end, text, n_tokens.

    The next start depends on the previous cut, so the spans of one text are walked in a
    small Python helper; Spark spreads the texts.
    """
    if not MIN_CHUNK_SIZE <= size <= MAX_CHUNK_SIZE:
        raise ValueError(f"chunk size must be within {MIN_CHUNK_SIZE}..{MAX_CHUNK_SIZE}")
    source = df.select(*carry, F.col(text).alias("_text"))
    schema = T.StructType(
        [source.schema[c] for c in carry]
        + [
            T.StructField("unit_order", T.IntegerType()),
            T.StructField("char_start", T.IntegerType()),
            T.StructField("char_end", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 128):  # few texts at a time, as texts may be long
                part = batch.slice(first, 128)
                row, order, starts, ends, pieces = [], [], [], [], []
                for k, body in enumerate(part.column(len(carry))):
                    body, n = body.as_py() or "", 0
                    for start, end in chunk_spans(body, size):
                        piece = body[start:end].strip()
                        if piece:
                            for column, value in zip((row, order, starts, ends, pieces), (k, n, start, end, piece)):
                                column.append(value)
                            n += 1
                kept = [part.column(i).take(pa.array(row, pa.int64())) for i in range(len(carry))]
                made = [pa.array(v, pa.int32()) for v in (order, starts, ends)]
                yield pa.RecordBatch.from_arrays([*kept, *made, pa.array(pieces, pa.string())], names=schema.names)
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(spans, schema)


def casefold(column: Column) -> Column:
    """Full Unicode case folding.

    Of the letters that lower-casing leaves to be folded, the micro sign and the sharp s are replaced outright; the
    others lie in a few ranges, and only texts with a character there go through the long list.
    """
    low = F.replace(F.translate(F.lower(column), "\u00b5", "\u03bc"), F.lit("\u00df"), F.lit("ss"))
    late = {c: f for c, f in _folded().items() if c not in "\u00b5\u00df"}
    one = {c: f for c, f in late.items() if len(f) == 1}
    out = F.translate(low, "".join(one), "".join(one.values()))
    for letter, plain in late.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.when(F.rlike(low, F.lit(LATE_FOLDS)), out).otherwise(low)


def strip(column: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(column, f"^[{SPACE}]+|[{SPACE}]+$", "")


def token_estimate(column: Column) -> Column:
    """CJK characters + alphanumeric runs + other visible symbols, at least 1."""
    pattern = f"([{CJK}]|(?:(?![{CJK}])[\\p{{L}}\\p{{N}}])+|[^{SPACE}\\p{{L}}\\p{{N}}])"
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(column, F.lit(pattern), 1)))


def latin_words(column: Column) -> Column:
    return F.transform(F.regexp_extract_all(column, F.lit("([A-Za-z0-9]+)"), 1), F.lower)


def cjk_runs(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(f"([{CJK}]+)"), 1)


def bigrams(run: Column) -> Column:
    return F.when(
        F.length(run) > 1,
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))


def bm25_tokens(column: Column) -> Column:
    """Lower-cased ASCII words, then the characters and bigrams of each CJK run."""
    parts = F.flatten(
        F.transform(
            cjk_runs(column),
            lambda run: F.concat(F.filter(F.split(run, ""), lambda c: c != ""), bigrams(run)),
        )
    )
    return F.concat(latin_words(column), parts)


def lexical_terms(column: Column) -> Column:
    """Unique ASCII words; only without any, CJK runs of up to 12 characters and their bigrams."""
    words = F.array_distinct(latin_words(column))
    runs = F.array_distinct(
        F.flatten(
            F.transform(
                cjk_runs(column),
                lambda run: F.concat(
                    F.when(F.length(run) <= 12, F.array(run)).otherwise(F.array().cast("array<string>")),
                    bigrams(run),
                ),
            )
        )
    )
    return F.when(F.size(words) > 0, words).otherwise(runs)


def text_runs(column: Column) -> Column:
    """Distinct maximal ASCII-alphanumeric and CJK runs of the case-folded text.

    A search term made of such characters is a substring of the text exactly when it is a
    substring of one of these runs.
    """
    return F.array_distinct(F.regexp_extract_all(casefold(column), F.lit(f"([a-z0-9]+|[{CJK}]+)"), 1))


def slug(name: Column, fallback: Column) -> Column:
    joined = F.regexp_replace(F.lower(strip(name)), f"[{SPACE}]+", "-")
    cut = F.regexp_replace(joined, "^-+|-+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(fallback)


@F.pandas_udf(T.StringType())
def nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def normal_answer(column: Column) -> Column:
    """NFKC, case-folded, every run of non-word characters becomes one blank."""
    words = F.regexp_replace(nfkc_casefold(column), "[^\\p{L}\\p{N}\\p{M}_]+", " ")
    return F.trim(words)


def normal_output(column: Column) -> Column:
    """`normal_answer` after dropping [n] citation marks."""
    return normal_answer(F.regexp_replace(column, "\\[\\d+\\]", " "))


def has_phrase(normal_text: Column, phrase: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), normal_text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def word_trigrams(column: Column) -> Column:
    """Distinct 3-grams of lower-cased words, each padded by two blanks before and one after."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("([\\p{L}\\p{N}]+)"), 1))
    return F.array_distinct(
        F.flatten(
            F.transform(
                words,
                lambda w: F.transform(
                    F.sequence(F.lit(1), F.length(w) + 1),
                    lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
                ),
            )
        )
    )

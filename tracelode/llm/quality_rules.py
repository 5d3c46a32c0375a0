"""Operator 6: quality rules as weak supervision.

Every rule looks at one feature of a whole text and votes good (1), bad (0) or abstains (-1). Its
accuracies, how often it votes which way on good and on bad text, and the share of good documents are
estimated by expectation maximisation over all documents at once: only
the counts of equal vote patterns matter, of which there are at most 3 ** rules, so the estimate
needs one small aggregate. A document is kept when its posterior probability of being good is at
least 0.5 and it passes the two base rules.

Results: null and empty texts have all counts 0, fail the base rule of ten words and are not kept.
Repeated or null ids give one row per input row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import U64, Ids, load, map_batches, mix, pieces, shared_table

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that rules look at.
MORE = ("n_lines", "n_upper", "n_lower", "n_letterless", "n_marks")
WINDOW = 5
#: A rule is not allowed to call more of the good text bad.
GOOD_FLAGGED = 0.01


def repeated_words(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document, words inside 5-word windows that occur twice or more in the document.

    `ids` are the word numbers of all documents one after another, `sizes` their word counts.
    """
    out = np.zeros(len(sizes), np.int64)
    n = len(ids) - WINDOW + 1
    if n < 1:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    word = mix(ids.astype(np.uint64) + U64(1))
    key = mix(doc[:n].astype(np.uint64) + U64(0x51ED))
    for k in range(WINDOW):
        key = key * U64(0x9E3779B97F4A7C15) + word[k : k + n]
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    if not len(inside):
        return out
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = order[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return out + np.bincount(doc, weights=covered, minlength=len(sizes)).astype(np.int64)


def _letterless(word: bytes) -> bool:
    return not any(c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in word)


_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))

SCHEMA = pa.schema([(name, pa.int64()) for name in ("doc_id", *COUNTS, *MORE)])


def features(docs: DataFrame) -> DataFrame:
    """The counts of every row of `docs`(doc_id, text)."""

    def start():
        ids = Ids(400_000)

        def work(batch: pa.RecordBatch):
            ids_of_rows, texts = batch.column(0), batch.column(1).to_pylist()
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            for a, b in pieces(raw):
                if ids.full:
                    ids.clear()
                out: dict[str, list] = {name: [] for name in SCHEMA.names}
                numbers, sizes = [], []
                for text, data in zip(texts[a:b], raw[a:b], strict=True):
                    text = text or ""
                    words = data.split()
                    numbers.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                    sizes.append(len(words))
                    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
                    out["n_words"].append(len(words))
                    out["word_chars"].append(len(text) - sum(map(text.count, " \t\n\v\f\r")))
                    out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
                    out["n_dup_lines"].append(len(lines) - len(set(lines)))
                    out["n_lines"].append(len(lines))
                    out["n_upper"].append(len(data) - len(data.translate(None, _UPPER)))
                    out["n_lower"].append(len(data) - len(data.translate(None, _LOWER)))
                    out["n_marks"].append(sum(map(text.count, "!?")))
                    bare = {w for w in set(words) if _letterless(w)}
                    out["n_letterless"].append(sum(w in bare for w in words) if bare else 0)
                out["n_repeat_words"] = repeated_words(np.concatenate(numbers), np.array(sizes))
                out["doc_id"] = ids_of_rows.slice(a, b - a)
                yield out

        return work

    ddl = ", ".join(f"{name} long" for name in SCHEMA.names)
    return map_batches(docs.select("doc_id", "text"), start, SCHEMA, ddl)


def _between(value: Column, good: tuple[float, float], bad: tuple[float, float]) -> Column:
    """Good inside `good`, bad outside `bad`, no vote between the two."""
    return F.when((value >= good[0]) & (value <= good[1]), 1).when((value < bad[0]) | (value > bad[1]), 0).otherwise(-1)


def votes() -> dict[str, Column]:
    """The rules; limits follow published web-text filters.

    None depends on the length of a text alone, which would make short and long texts the two classes.
    """
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    return {
        "word_length": _between(F.col("word_chars") / words, (3.0, 10.0), (2.0, 14.0)),
        "symbols": _between(F.col("n_symbols") / words, (0, 0.02), (0, 0.1)),
        "repeated_lines": _between(F.col("n_dup_lines") / lines, (0, 0.1), (0, 0.3)),
        "repeated_words": _between(F.col("n_repeat_words") / words, (0, 0.05), (0, 0.2)),
        "capitals": _between(F.col("n_upper") / letters, (0, 0.15), (0, 0.4)),
        "exclamations": _between(F.col("n_marks") / words, (0, 0.05), (0, 0.2)),
        "letterless": _between(F.col("n_letterless") / words, (0, 0.1), (0, 0.3)),
    }


def fit_patterns(
    patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, believed: float = 0.02
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of being good per vote pattern, accuracies (rule, class, vote), shares of the classes.

    Class 0 is good text. Bad text comes in kinds that do not resemble each other, so each rule has
    a class of its own, the text it was made to find; a rule has an accuracy in every class. Before
    seeing votes, with the weight of a share `believed` of the documents, rules are believed to vote
    bad on 1 in 200 good documents, never on more than `GOOD_FLAGGED` of them, and on 9 in 10 of their
    own kind; nothing is believed about other kinds.
    """
    rules = patterns.shape[1]
    if not len(patterns):
        return np.empty(0), np.full((rules, rules + 1, 2), 0.5), np.full(rules + 1, 1 / (rules + 1))
    is_vote = np.stack([patterns == v for v in (0, 1)], axis=2).astype(float)
    weight = believed * counts.sum() + 2
    prior = np.ones((rules, rules + 1, 2))
    prior[:, 0] = weight * np.array([0.005, 0.995])
    prior[np.arange(rules), np.arange(rules) + 1] = weight * np.array([0.9, 0.1])
    member = np.concatenate([0.2 + (patterns != 0).all(axis=1)[:, None], (patterns == 0)], axis=1).astype(float)
    member /= member.sum(axis=1, keepdims=True)
    how, share = prior, member.mean(axis=0)
    for _ in range(rounds):
        weight = member * counts[:, None]
        how = np.einsum("pc,pjv->jcv", weight, is_vote) + prior
        how /= how.sum(axis=2, keepdims=True)
        how[:, 0, 0] = np.minimum(how[:, 0, 0], GOOD_FLAGGED)
        how[:, 0, 1] = 1 - how[:, 0, 0]
        share = weight.sum(axis=0) + 1
        share /= share.sum()
        log = np.einsum("pjv,jcv->pc", is_vote, np.log(how)) + np.log(share)
        now = np.exp(log - log.max(axis=1, keepdims=True))
        now /= now.sum(axis=1, keepdims=True)
        moved = np.abs(now - member).max(initial=0)
        member = now
        if moved < 1e-9:
            break
    return member[:, 0], how, share


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base rule, posterior and verdict per row of `docs`."""
    rules = votes()
    counted = shared_table(features(docs), "quality-counts")
    voted = counted.withColumn("pattern", F.concat_ws(",", *[v.cast("string") for v in rules.values()]))
    seen = voted.groupBy("pattern").count().collect()  # at most 3 ** len(rules) rows
    patterns = np.array([[int(x) for x in r["pattern"].split(",")] for r in seen]).reshape(len(seen), len(rules))
    good, _, _ = fit_patterns(patterns, np.array([r["count"] for r in seen], dtype=float))
    spark = docs.sparkSession
    rows = [(r["pattern"], round(float(g), 9)) for r, g in zip(seen, good, strict=True)]
    posterior = spark.createDataFrame(rows, "pattern string, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.join(F.broadcast(posterior), "pattern").select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"))

"""Operator 9: toxicity from a learned lexicon, with misspellings and contexts.

The lexicon is learned from a bounded sample of labelled rows: words, and beginnings of words (stems),
that occur in many toxic documents and in next to no others. A trie holds the words. A word of a text is
matched by running its Levenshtein automaton, a bit-parallel one with up to two edits for long
terms, along the trie, so all terms near it are found in one walk; stems must begin it exactly. Terms that
few of the toxic documents hold are in the trie too; hits of them, exact or near, are kinds of their own. A hit
between quotation marks or near a word of reporting within a window counts as quotation, any other as
abuse. A logistic model over the logarithms of the counts by kind gives the score. Its weights are drawn
towards given ones where the sample has little to say, so misspellings and quotations count as they
should even if training texts have none.

Results: null and empty texts have no hits and get the score of documents without any. Without labels
of both kinds the lexicon is empty and all scores equal. Ids may be null or repeat.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import crc_mod, load, map_batches
from tracelode.llm.quality_model import labelled_sample

SAMPLE_ROWS = 12_000
#: Terms of the lexicon at most, and lengths of stems.
TERMS, STEMS = 2_000, (4, 5, 6)
WINDOW = 8
EDGES = ".,;:!?\"'()[]{}«»“”„‘’…*_-"
OPENING, CLOSING = "\"'«“„‘", "\"'»”’"
#: Words of reporting, in the languages of the corpus.
REPORTING = frozenset(
    "said says called quoted quote word term wrote sagte nannte zitat wort dit appelé citation mot dijo llamó cita palabra".split()
)
KINDS = ("exact", "near", "stem", "rare", "near_rare", "quoted")
#: Bias and weights that the model starts from and is drawn to.
PRIOR = np.array([-3.0, 5.0, 4.5, 5.0, 2.0, 1.5, 0.5])


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """`words` and `rare` ones are matched with edits, `stems` only as they are."""

    words: list[str]
    stems: list[str]
    rare: frozenset = frozenset()
    tries: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.often = set(self.words)
        # Of a term's allowed edits plus one pieces, one is unchanged: the first begins the word, the last ends
        # it, another is anywhere. Each piece has a trie of its terms, so few terms are walked for a word.
        self.sizes: dict[str, set[int]] = {"head": set(), "tail": set(), "inner": set()}
        for word in [*self.words, *self.rare]:
            n = edits_allowed(word) + 1
            cuts = [len(word) * i // n for i in range(n + 1)]
            for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                place = "head" if i == 0 else "tail" if i == n - 1 else "inner"
                self.sizes[place].add(y - x)
                node = self.tries.setdefault((place, word[x:y]), {})
                for c in word:
                    node = node.setdefault(c, {})
                node[""] = word
        self.stem_set = set(self.stems)

    def kind(self, word: str) -> int:
        """0: none, 1: a term, 2: near a term, 3: begins with a stem, 4: a rare term, 5: near a rare term only."""
        if word in self.often:
            return 1
        if word in self.rare:
            return 4
        for n in STEMS:
            if word[:n] in self.stem_set and len(word) >= n:
                return 3
        often, rare = self.distances(word)
        return (1 if often == 0 else 2) if often is not None else 0 if rare is None else 4 if rare == 0 else 5

    def distance(self, word: str) -> int | None:
        """Edits to the nearest term that allows as many."""
        return min((d for d in self.distances(word) if d is not None), default=None)

    def distances(self, word: str) -> tuple[int | None, int | None]:
        """Edits to the nearest frequent and to the nearest rare term that allow as many.

        The state of the automaton after a path of the trie is one bit set per number of edits: bit i says
        that the path matches the first i characters of `word` with that many.
        """
        most = 2 if len(word) >= 7 else 1
        first = [(1 << (e + 1)) - 1 for e in range(most + 1)]
        pieces = {("head", word[:n]) for n in self.sizes["head"]} | {("tail", word[-n:]) for n in self.sizes["tail"]}
        pieces |= {("inner", word[x : x + n]) for n in self.sizes["inner"] for x in range(len(word) - n + 1)}
        stack = [(self.tries[piece], first) for piece in pieces if piece in self.tries]
        best: list[int | None] = [None, None]
        if not stack:
            return None, None
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        full, end = (1 << (len(word) + 1)) - 1, 1 << len(word)
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    for e in range(min(most, edits_allowed(child)) + 1):
                        if state[e] & end:
                            rare = child not in self.often
                            best[rare] = e if best[rare] is None else min(best[rare], e)
                            break
                    continue
                hits, new = at.get(c, 0), []
                for e, old in enumerate(state):
                    bits = (old & hits) << 1
                    if e:
                        bits |= state[e - 1] << 1 | state[e - 1] | new[e - 1] << 1
                    new.append(bits & full)
                if new[-1]:
                    stack.append((child, new))
        return best[0], best[1]


class _Kinds(dict):
    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        got = self[token] = self.lexicon.kind(token.strip(EDGES))
        return got


def is_quoted(tokens: list[str], i: int) -> bool:
    """Whether token `i` stands between quotation marks or near a word of reporting."""
    before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
    token = tokens[i]
    opened = token[0] in OPENING
    for t in before:
        if t[0] in OPENING:
            opened = True
        if t[-1] in CLOSING or t.rstrip(".,;:!?")[-1:] in CLOSING and t.rstrip(".,;:!?"):
            opened = False
    opened = opened or token[0] in OPENING
    closed = any(t.rstrip(".,;:!?")[-1:] in CLOSING and t.rstrip(".,;:!?") for t in [token, *after])
    return opened and closed or any(t.strip(EDGES) in REPORTING for t in before[-3:] + after[:3])


COUNTED = pa.schema([("doc_id", pa.int64()), *[(k, pa.int64()) for k in KINDS]])


def count_hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Hits by kind of every row of `docs`(doc_id, text)."""

    def start():
        kinds = _Kinds(lexicon)

        def work(batch: pa.RecordBatch):
            out = {k: [0] * batch.num_rows for k in KINDS}
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = (text or "").lower().split()
                found = list(map(kinds.__getitem__, tokens))
                if any(found):
                    for i, kind in enumerate(found):
                        if kind:
                            out["quoted" if is_quoted(tokens, i) else KINDS[kind - 1]][row] += 1
                if len(kinds) > 600_000:
                    kinds.clear()
            yield {"doc_id": batch.column(0), **out}

        return work

    ddl = ", ".join(f"{n} long" for n in COUNTED.names)
    return map_batches(docs.select("doc_id", "text"), start, COUNTED, ddl)


SEEN = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64()), ("words", pa.int64())])


def learn_lexicon(docs: DataFrame, sample: DataFrame, terms: int = TERMS) -> Lexicon:
    """Words and stems (with a `*`) that mark toxic documents of the sample(doc_id, label)."""

    def start():
        def work(batch: pa.RecordBatch):
            seen: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for t in (text or "").lower().split() if 3 <= len(w := t.strip(EDGES)) <= 40}
                stems: dict[str, int] = {}
                for w in words:
                    for n in STEMS:
                        if len(w) > n:
                            stems[w[:n] + "*"] = stems.get(w[:n] + "*", 0) + 1
                for term, n in [*((w, 1) for w in words), *stems.items()]:
                    entry = seen.setdefault(term, [0, 0, 0])
                    entry[1 - label] += 1
                    entry[2] += n
            yield {"term": list(seen), **{c: [e[k] for e in seen.values()] for k, c in enumerate(("toxic", "other", "words"))}}

        return work

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")
    seen = map_batches(rows, start, SEEN, "term string, toxic long, other long, words long")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return Lexicon([], [])
    total = seen.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = ((F.col("toxic") + 0.5) / toxic) / ((F.col("other") + 0.5) / other)
    score = F.sqrt("toxic") * F.log(ratio)
    good = total.where((F.col("toxic") >= max(4, toxic // 400)) & (ratio >= 30))
    found = {r["term"]: r["toxic"] for r in good.orderBy(F.desc(score), "term").limit(terms).collect()}
    words = [t for t in found if not t.endswith("*")]
    # A stem of one whole term only says what that says; a longer stem nothing that a shorter one does not.
    kept: list[str] = []
    for stem in sorted((t[:-1] for t in found if t.endswith("*")), key=len):
        whole = [w for w in words if w.startswith(stem)]
        if not any(stem.startswith(s) for s in kept) and len(whole) != 1:
            kept.append(stem)
    often = max(4, toxic // 12)
    return Lexicon([w for w in words if found[w] >= often], kept, frozenset(w for w in words if found[w] < often))


def fit_weights(counts: np.ndarray, labels: np.ndarray, share: float, pull: float = 2.0) -> np.ndarray:
    """Logistic weights by Newton's method, rows weighted to the true share of label 1."""
    x = np.concatenate([np.ones((len(labels), 1)), np.log2(1 + counts)], axis=1)
    weights = PRIOR.copy()
    if not len(labels):
        return weights
    mean = labels.mean()
    row = np.where(labels == 1, share / mean, (1 - share) / (1 - mean)) if 0 < mean < 1 else np.ones(len(labels))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (row * (labels - p)) - pull * (weights - PRIOR)
        bend = (x * (row * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def score_toxicity(docs: DataFrame, labels: DataFrame, fits: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score, hits by kind) per row of `docs`, learned from the labelled rows that `fits`."""
    sample, share = labelled_sample(labels, "toxic", fits, sample_rows)
    lexicon = learn_lexicon(docs, sample)
    # The sample is bounded by its row count.
    known = count_hits(docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"), lexicon)
    rows = known.join(F.broadcast(sample), "doc_id").select(*KINDS, "label").toArrow()
    counts = np.stack([rows[k].to_numpy() for k in KINDS], axis=1).reshape(-1, len(KINDS)).astype(float)
    weights = fit_weights(counts, rows["label"].to_numpy().astype(float), share)
    linear = F.lit(float(weights[0]))
    for w, kind in zip(weights[1:], KINDS, strict=True):
        linear = linear + F.log2(1 + F.col(kind)) * float(w)
    score = F.round(1 / (1 + F.exp(-linear)), 9)
    return count_hits(docs, lexicon).select("doc_id", score.alias("score"), *KINDS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 4) == 2
    return score_toxicity(docs, labels, ~held).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )

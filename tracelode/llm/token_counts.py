"""Operator 7: token counts of a unigram tokenizer by dynamic programming over a trie of pre-tokens.

A text is cut at white space; a pre-token is a word with the vocabulary's mark for a word's beginning
before it. Its tokens are the pieces of the segmentation with the highest summed log-probability;
a character that no piece covers counts one token per UTF-8 byte. Distinct pre-tokens are put into a
trie, and the best score and its token count are computed once per node, that is once per distinct
prefix; the node where a pre-token ends has its count. The trie is kept while a task goes through its
documents and is thrown away when it has grown to `NODES`.

The public vocabulary is of the byte-fallback kind, with ranks for scores. Piece probabilities are taken
as falling with the rank by Zipf's law, which needs no training.

Results: null, empty and blank texts have no tokens. Among equally likely segmentations the one with
fewer tokens counts. Ids may be null or repeat; each row gives one row.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelode.llm.common import load, map_batches

NODES = 1_000_000
MARK = "▁"


class Pieces:
    """Pieces of a vocabulary file with their log-probabilities."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = sorted(
            (-model.get_score(i), model.id_to_piece(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        )
        total = math.log(sum(1 / (k + 2.7) for k in range(len(ranked))))
        self.score = {piece: -math.log(k + 2.7) - total for k, (_, piece) in enumerate(ranked)}
        self.longest = max(map(len, self.score))
        #: A byte of a character outside all pieces: less likely than any piece.
        self.byte = min(self.score.values()) - 10.0


class PretokenTrie:
    """Nodes are numbers: `child` leads from (node, character) to a node, and `best` and `tokens` have the
    score and the fewest tokens of the prefix that leads to a node."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    @property
    def nodes(self) -> int:
        return len(self.best)

    def count(self, word: str) -> int:
        """Tokens of a pre-token; walks what is known of it and computes the rest."""
        text = MARK + word
        child, bests, counts = self.child, self.best, self.tokens
        node, path = 0, [0]
        for c in text:
            node = child.get(node * 0x110000 + ord(c))
            if node is None:
                break
            path.append(node)
        else:
            return counts[node]
        score_of, longest = self.pieces.score.get, self.pieces.longest
        for i in range(len(path) - 1, len(text)):
            below, c = path[i], text[i]
            size = len(c.encode("utf-8", "surrogatepass"))
            best, tokens = bests[below] + size * self.pieces.byte, counts[below] + size
            for k in range(max(0, i + 1 - longest), i + 1):
                piece = score_of(text[k : i + 1])
                if piece is not None:
                    score, n = bests[path[k]] + piece, counts[path[k]] + 1
                    if score > best + 1e-9 or (score > best - 1e-9 and n < tokens):
                        best, tokens = score, n
            node = child[below * 0x110000 + ord(c)] = len(bests)
            bests.append(best)
            counts.append(tokens)
            path.append(node)
        return counts[node]


class _Counts(dict):
    """Word -> tokens; the terminal counts of the trie."""

    def __init__(self, trie: PretokenTrie) -> None:
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        got = self[word] = self.trie.count(word)
        return got


COUNT = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) per row of `docs`(doc_id, text), for a vocabulary file at `path`."""

    def start():
        counts = _Counts(PretokenTrie(Pieces(path)))

        def work(batch: pa.RecordBatch):
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                found = (text or "").split()
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
                if counts.trie.nodes > NODES:
                    counts.clear()
                    counts.trie.clear()
            yield {"doc_id": batch.column(0), "n_pretokens": words, "n_tokens": tokens}

        return work

    return map_batches(docs.select("doc_id", "text"), start, COUNT, "doc_id long, n_pretokens long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

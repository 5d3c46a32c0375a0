"""Operator 4: byte-pair encoding and decoding with a contiguous rank array per word.

A text is cut at the added tokens, normalised (NFC, white space, lower case) and split into
pre-tokens. A pre-token becomes an array of part ids, one per byte, and an array of the ranks of
adjacent parts. The lowest rank is found by scanning, its boundary is deleted, and only the two
neighbouring ranks are looked up again. Words longer than `SHORT` bytes keep the same arrays as a
linked list with a heap of ranks, since scanning would be quadratic. Encoded pre-tokens are kept in
a bounded table of the task; a document is the concatenation of its pre-tokens.

Results: null and empty texts have no tokens (n_tokens 0 and the hash of the empty string); ids may
be null or repeat, each input row gives one row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tracelode.llm.common import load, map_batches

SHORT = 200
NONE = 1 << 60
#: Characters whose letter class and lower case no Unicode version has changed.
STEADY = regex.compile("[\\x00-\u024f\u2010-\u2046\u20a0-\u20bf\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]*")
#: Pre-tokens remembered by a task.
REMEMBERED = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file of the word-end kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        #: Of two adjacent ids: rank of their merge and the merged id, in one number.
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault((vocab[a] << 20) | vocab[b], (rank << 20) | vocab[a + b])
        self.text_of = {i: s for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: s for s, i in self.added.items()}
        first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, first)) + ")") if first else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space is Unicode's White_Space property in the library, and was folded to blanks before.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"), regex.V0).findall
        kinds = [unicodedata.category(chr(c))[0] for c in range(256)]
        sets = {k: "".join(f"\\x{c:02x}" for c in range(256) if kinds[c] == k) for k in "LN"}
        narrow = pattern.replace(r"\s", r"\x09-\x0d\x20\x85\xa0")
        for k, chars in sets.items():
            narrow = narrow.replace(rf"\p{{{k}}}", chars)
        #: The same pattern for texts of Latin-1 characters, with its classes written out.
        self.split_narrow = re.compile(narrow.replace("[[", "[").replace("]]", "]")).findall
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.byte_of = {ord(s): b for b, s in enumerate(symbols)}

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a stretch without added tokens.

        Python's Unicode tables are older than the library's, so stretches with characters outside
        `STEADY` are normalised and split by the library's own two components.
        """
        try:
            text.encode("latin-1")  # such texts are in NFC
            return self.split_narrow(text.lower())
        except UnicodeEncodeError:
            if not STEADY.fullmatch(text):
                found = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
                return [bytes(map(self.byte_of.__getitem__, map(ord, w))).decode() for w, _ in found]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            return self.split(text.lower())

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) > SHORT:
            return self._encode_long(ids)
        rank = self.rank.get
        ranks = [rank((a << 20) | b, NONE) for a, b in pairwise(ids)]
        while ranks and (lowest := min(ranks)) != NONE:
            i = ranks.index(lowest)
            ids[i] = part = lowest & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1] << 20) | part, NONE)
            if i < len(ranks):
                ranks[i] = rank((part << 20) | ids[i + 1], NONE)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((ids[i] << 20) | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank((ids[i] << 20) | ids[j], NONE) != r:
                continue
            ids[i], ids[j] = r & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (s := rank((ids[k] << 20) | ids[after[k]], NONE)) != NONE:
                    heapq.heappush(heap, (s, k))
        return [i for i in ids if i >= 0]

    def parts(self, text: str | None) -> Iterator[tuple[bool, str]]:
        """(is an added token, stretch) in order."""
        if not text:
            return
        if self.cut is None or "<|" not in text:
            yield False, text
            return
        for k, part in enumerate(self.cut.split(text)):
            if part:
                yield k % 2 == 1, part

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for added, part in self.parts(text):
            if added:
                out.append(self.added[part])
            else:
                for word in self.pretokens(part):
                    out += self.encode_word(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by one blank, as the library does for files without a decoder."""
        return " ".join([self.text_of[i] for i in ids if i in self.text_of])


class _Remembered(dict):
    """Pre-token -> its ids as text; `decoded` has its decoded text."""

    def __init__(self, bpe: WordBpe) -> None:
        super().__init__()
        self.bpe = bpe
        self.decoded: dict[str, str] = {}

    def __missing__(self, word: str) -> str:
        ids = self.bpe.encode_word(word)
        self.decoded[word] = self.bpe.decode(ids)
        got = self[word] = " ".join(map(str, ids))
        return got


_loaded: dict[str, _Remembered] = {}


def _remembered(path: str) -> _Remembered:
    if path not in _loaded:
        _loaded[path] = _Remembered(WordBpe(path))
    return _loaded[path]


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and decoded text per row of `docs`(doc_id, text).

    `path` is a vocabulary file that every executor has. With `with_ids` the ids (array of int) and
    the decoded text are returned as well.
    """
    schema = SCHEMA
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema = pa.schema([*SCHEMA, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        ddl += ", ids array<int>, decoded string"

    def start():
        known = _remembered(path)
        bpe = known.bpe

        def work(batch: pa.RecordBatch):
            out: dict[str, list] = {name: [] for name in schema.names}
            out["doc_id"] = batch.column(0)
            for text in batch.column(1).to_pylist():
                ids_of: list[str] = []
                text_of: list[str] = []
                for added, part in bpe.parts(text):
                    if added:
                        ids_of.append(str(bpe.added[part]))
                        text_of.append(part)
                    else:
                        found = bpe.pretokens(part)
                        ids_of += map(known.__getitem__, found)
                        text_of += map(known.decoded.__getitem__, found)
                ids, decoded = " ".join(ids_of), " ".join(text_of)
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append([int(x) for x in ids.split()])
                    out["decoded"].append(decoded)
                if len(known) > REMEMBERED:
                    known.clear()
                    known.decoded.clear()
            yield out

        return work

    return map_batches(docs.select("doc_id", "text"), start, schema, ddl)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"), vocabulary_path())

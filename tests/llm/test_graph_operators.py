"""Collocations, SimHash near-duplicates and the conversation trie against SQL and brute force, and on awkward rows."""

import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelode.llm import collocations, prefix_trie, simhash

WORDS = "alpha beta gamma delta river stone cloud é漢 green".split()
#: Names that operators use inside; none may clash.
EXTRA = ("n", "f", "key", "print", "bucket", "gram", "pos", "digest", "size", "node", "words")


def same(spark_rows, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    result = con.execute(sql)
    order = [[d[0] for d in result.description].index(c) for c in spark_rows.columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)
    return sorted((tuple(r) for r in spark_rows.collect()), key=str) == want and len(want)


def with_extra(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA if c not in df.columns])


def texts():
    pick = random.Random(3)
    out = [(None, "en"), ("", "en"), (" \t . \n", "en"), ("A b\tB", None), ("a b", "und"), ("x" * 70_000 + " y", "en")]
    for k in range(2_500):
        words = [pick.choice(WORDS) for _ in range(pick.randrange(1, 30))]
        gaps = [pick.choice([" "] * 9 + ["  ", "\t", ". ", "\n", "\r\n", "!"]) for _ in words]
        out.append(("".join(w + g for w, g in zip(words, gaps)), pick.choice(["en", "de", None])))
    out += [("One long Passage that Many texts have in common, word for word", "en")] * 45
    out += [("so so so so so so so", "de")] * 20
    return [(i, t, lang) for i, (t, lang) in enumerate(out)] + [(None, "alpha beta gamma", "en")]


def test_collocations_equal_sql(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string, lang string").repartition(5)
    assert same(collocations.collocations(with_extra(docs)), collocations.OP11_SQL, documents=docs) > 40
    for name, value in (("SLICE", 300), ("BUCKET", 500), ("HELD", 20)):
        monkeypatch.setattr(collocations, name, value)
    assert same(collocations.collocations(docs), collocations.OP11_SQL, documents=docs) > 40
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_paths_are_compacted(spark):
    docs = spark.createDataFrame([("one two three four five six seven eight", "en")] * 3 + [("nine four five six", "en")], "text string, lang string")
    grams = collocations.frequent_grams(docs, 3)
    found = {r.gram: (r.head, r.place) for r in collocations.compact_paths(grams).collect()}
    head = "one two three four"
    assert found["two three four five"] == (head, 1) and found["three four five six"] == (head, 2)
    assert found["four five six seven"] == ("four five six seven", 0)  # the node before it has another way in
    assert found["five six seven eight"] == ("four five six seven", 1)


def conversations():
    pick = random.Random(4)
    out = [(None, 0, "user", "nobody"), (7, None, None, None), (7, None, "user", "first"), (7, 1, "user", ""), (7, 1, "user", "")]
    for c in [*range(0, 12), *range(95, 130), *range(205, 240), 300, 1_000_000_007]:
        for turn in range(pick.randrange(1, 9)):
            out.append((c, turn, pick.choice(["user", "assistant"]), pick.choice(["hello", "é漢!", "", "good bye"]) * (turn < 6)))
    out += [(400, k, "user", f"turn {k // 2}") for k in range(60)] + [(450, k, "user", f"turn {k // 2}") for k in range(40)]
    out += [(500 + k, 0, "user", "the same") for k in range(40)] + [(600 + k, t, "user", "the same") for k in range(30) for t in range(9)]
    return out


@pytest.mark.parametrize("rows", [1, 3, 16, 50_000])
def test_prefix_trie_equals_sql(spark, monkeypatch, rows):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", rows)
    table = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(prefix_trie.rebuilt(with_extra(table)))
    assert same(got, prefix_trie.OP13_SQL, conversations=table) > 100


def test_prefix_trie_of_few_rows(spark):
    table = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(table.limit(0))).count() == 0
    alone = table.where("conv_id = 300 and turn = 0")
    assert same(prefix_trie.trie(prefix_trie.rebuilt(alone)), prefix_trie.OP13_SQL, conversations=alone) >= 1
    gone = spark.createDataFrame([(c, 0, "user", "x") for c in range(501, 540)], "conv_id long, turn long, role string, text string")
    assert same(prefix_trie.trie(prefix_trie.rebuilt(gone)), prefix_trie.OP13_SQL, conversations=gone) >= 1


def test_extents_are_found_by_range_minima():
    pick = np.random.default_rng(1)
    shared = pick.integers(0, 5, 300)
    shared[0] = -1
    left, right = prefix_trie._extents(shared, prefix_trie._sparse(shared))
    for i in range(1, 300):
        a = max(k for k in range(i + 1) if shared[k] < shared[i])
        z = min([k for k in range(i, 300) if shared[k] < shared[i]], default=300) - 1
        assert (left[i], right[i]) == (a, z)


def test_golay_keys_meet():
    pick = np.random.default_rng(2)
    v = pick.integers(-(2**63), 2**63 - 1, 4_000)
    w = v.copy()
    for _ in range(simhash.DISTANCE):
        w ^= np.left_shift(np.uint64(1), pick.integers(0, 64, len(w)).astype(np.uint64)).view(np.int64)
    keys = []
    for prints in (v, w):
        row, key = simhash.segment_keys(prints)
        keys.append([set() for _ in prints])
        for a, b in zip(row.tolist(), key.tolist()):
            keys[-1][a].add(b)
    assert all(a & b for a, b in zip(*keys))
    assert {len(np.flatnonzero(simhash.golay_keys(v & 0x7FFFFF)[0] == i)) for i in range(50)} <= {1, 6}


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes) and hashes)


@pytest.mark.parametrize("group", [2, 2_048])
def test_simhash_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    pick = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "word"), (6, "word"), (None, "one two"), (7, "é漢 é漢 é漢 é漢")]
    base = [pick.choice(WORDS) + str(pick.randrange(90)) for _ in range(600)]
    for k in range(60):
        mine = list(base)
        for _ in range(k % 5):
            mine[pick.randrange(600)] = f"edit{k}"
        rows.append((10 + k, " ".join(mine)))
    rows += [(100 + k, " ".join(pick.choice(WORDS) for _ in range(pick.randrange(3, 90)))) for k in range(60)] + [(200, "z" * 90_000)]
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):  # links are few, so plain relabelling does
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    least = {}
    for (i, _), at in zip(rows, label):
        if i is not None:
            least[at] = min(i, least.get(at, i))
    want = sorted(((i, f"{p:016x}", least.get(at)) for (i, _), p, at in zip(rows, prints, label)), key=str)
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_refined_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    pick = np.random.default_rng(6)
    near = np.array([7], np.int64)
    for _ in range(4):  # a dense neighbourhood: many fingerprints share the same keys
        flips = np.left_shift(np.uint64(1), pick.integers(0, 64, 6).astype(np.uint64)).view(np.int64)
        near = np.unique(np.concatenate([near, *(near ^ f for f in flips)]))
    near = pick.permutation(near)[:600]
    links = simhash.near_prints(spark.createDataFrame([(int(x),) for x in near], "print long")).collect()

    def parts(pairs):
        label = {int(x): int(x) for x in near}

        def find(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
        return {x: find(x) for x in label}

    direct = [
        (int(x), int(y)) for i, x in enumerate(near)
        for y in near[i + 1 :][np.bitwise_count((near[i + 1 :] ^ x).view(np.uint64)) <= 3]
    ]
    assert parts(direct) == parts((r.a, r.b) for r in links) and len(direct) > len(links) / 4

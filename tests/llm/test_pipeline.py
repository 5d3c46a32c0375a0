"""The pipeline against its stages done by brute force on a small folder."""

import collections
import hashlib

from test_operators import brute_components, prose

import corpus_pipeline
from tracelode.llm import bpe, decontaminate


def documents():
    passage = prose(700, 90)
    out = [(k, prose(k, 60 + k % 7)) for k in range(40)]
    out += [(40 + k, prose(k, 60 + k % 7)) for k in range(4)]  # exact copies
    out += [(80 + k, prose(k, 60 + k % 7).replace(prose(k, 60 + k % 7).split()[30], "other", 1)) for k in range(10, 14)]
    out += [(60 + k, f"{prose(300 + k, 40)} {passage} é漢 {prose(400 + k, 30)}") for k in range(5)]  # a shared passage
    out += [(70 + k, prose(500 + k, 40) + " " + prose(900 + k, 25) + " " + prose(600 + k, 20)) for k in range(3)]  # benchmark
    out += [(100 + k, prose(k + 2000, 50).upper() + " ??") for k in range(20)]  # junk
    return out + [(130, None)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    folder, docs = str(tmp_path), documents()
    rows = [(i, t, "en", "src1", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in docs if i != 130], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(k, prose(900 + k, 25)) for k in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = [(i, t) for i, t in docs if i < 100 or i == 130]
    left = [r for r in left if r[0] in {i for i, _, _, kept in brute_components(left, 80) if kept}]
    seen = collections.Counter(d[k : k + 400] for _, t in left for d in [(t or "").encode()] for k in range(len(d) - 399))
    cut = []
    for i, t in left:
        data = (t or "").encode()
        mark = bytearray(len(data))
        for k in range(len(data) - 399):
            if seen[data[k : k + 400]] > 1:
                mark[k : k + 400] = b"\1" * 400
        # A character goes only if all its bytes do.
        kept, at = [], 0
        for c in t or "":
            size = len(c.encode())
            kept.append("" if all(mark[at : at + size]) else c)
            at += size
        cut.append((i, "".join(kept)))
    assert any(a[1] != b[1] for a, b in zip(left, cut) if a[1])
    clean = [(i, t) for i, t in cut if not any(text in decontaminate.normal(t) for _, text in items)]
    assert len(clean) == len(cut) - 3
    own, want = bpe.WordBpe(bpe.vocabulary_path()), {}
    for i, t in clean:
        ids = own.encode(t)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "near_duplicates", "suffix_array_dedup", "decontamination", "bpe_encoding"
    ]


def test_passages_of_over_fifty_words_are_cut(spark):
    def short(seed, n):
        return " ".join(w[:4] for w in prose(seed, n).split())

    docs = []
    for k, n in enumerate((50, 51, 55, 60)):  # all under 400 bytes
        passage = short(7000 + k, n)
        assert len(passage) < 400
        docs += [(10 * k + j, f"{prose(8000 + 10 * k + j, 30)} {passage} {prose(9000 + 10 * k + j, 20)}") for j in range(3)]
        docs.append((10 * k + 3, prose(8500 + k, 20) + "\n" + passage.replace(" ", "\n", 9)))
    docs += [(90, "漢字" * 90 + " a"), (91, "漢字" * 90 + " b"), (92, None), (93, " "), (94, "of " * 49 + "it")]
    words = {i: (t or "").encode().split() for i, t in docs}
    seen = collections.Counter(tuple(w[k : k + 51]) for w in words.values() for k in range(len(w) - 50))
    want = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(k, k + 51)}
        want[i] = [x.decode() for j, x in enumerate(w) if j not in gone]
    assert [sum(len(words[10 * k + j]) - len(want[10 * k + j]) for j in range(4)) for k in range(4)] == [0, 204, 220, 240]
    want |= {90: ["a"], 91: ["b"]}  # 540 bytes of one word
    for parts in (1, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = {r.doc_id: (r.text or "").split() for r in corpus_pipeline.cut_repeats(spark, df, "").collect()}
        assert got == want


def run_on(spark, folder, docs, labels, items):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _ string, spans string, label int"
    rows = [(i, t, "en", "src1", None if t is None else len(t), "x", "y", 5) for i, t in docs]
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, folder).collect()


def test_repeated_rows_keep_their_text(spark, tmp_path):
    docs = [(1, prose(1, 200)), (1, prose(1, 200)), (2, prose(2, 200)), (None, prose(3, 80)), (4, "x" * 70_000), (5, None), (6, "")]
    found = run_on(spark, str(tmp_path), docs, [(1, 1, 0)], [(1, None)])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == [(False, k) for k in (1, 2, 4, 5, 6)] + [(True, 0)]
    want = bpe.encode_documents(spark.createDataFrame([(1, prose(1, 200))], "doc_id long, text string"), bpe.vocabulary_path()).first()
    assert next(r for r in found if r["doc_id"] == 1)["ids_sha256"] == want["ids_sha256"]


def test_empty_tables(spark, tmp_path):
    assert run_on(spark, str(tmp_path), [], [], []) == []

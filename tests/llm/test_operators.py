"""The operators on training text against brute force, and on awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import (
    bpe, components, decontaminate, language, near_dups, quality_model, quality_rules, suffixes, token_counts,
    toxicity, urls,
)

WORDS = "alpha beta gamma delta river stone cloud green paper window market silver dragon copper orange valley".split()
#: Names that operators use inside; none may clash.
EXTRA = ("f", "n", "row", "node", "component", "key", "spans", "score", "signature", "label")


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, passage, pick = prose(1, 120), prose(2, 90), random.Random(5)
    out = [(1, base), (2, base), (3, base.replace(base.split()[60], "changed", 1)), (4, prose(3, 30) + " " + passage),
           (5, passage + " é ü 漢字 " + prose(4, 20)), (6, None), (7, ""), (8, " \t\n"), (9, "one two"), (10, "One TWO"),
           (11, "ab" * 900), (12, "line of text here now\n" * 40), (13, base), (13, base), (14, "x" * 120_000),
           (None, "some text without id " + prose(6, 10))]
    words = prose(7, 200).split()
    for k in range(15, 40):
        mine = list(words)
        for _ in range(pick.randrange(14)):
            mine[pick.randrange(len(mine))] = f"edit{k}"
        out.append((k, " ".join(mine)))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_common_passage_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "LARGE", 20)
    monkeypatch.setattr(suffixes._compare, "__defaults__", (7,))
    passage = prose(11, 90)
    rows = [(k, f"{prose(1000 + k, 40)} {passage[k % 5 :]} {prose(3000 + k, 40)}") for k in range(150)]
    seen = collections.Counter(t.encode()[k : k + 400] for _, t in rows for k in range(len(t.encode()) - 399))
    want = {}
    for i, t in rows:
        mark = bytearray(len(t.encode()))
        for k in range(len(mark) - 399):
            if seen[t.encode()[k : k + 400]] > 1:
                mark[k : k + 400] = b"\1" * 400
        want[i] = sum(mark)
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got == want and min(want.values()) > 400


def test_suffix_dedup_equals_brute_force(spark, rows, monkeypatch):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[k : k + 400] for _, t in texts for k in range(len(t) - 399))
    want = []
    for i, t in texts:
        mark = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                mark[k : k + 400] = b"\1" * 400
        rest = bytes(c for c, m in zip(t, mark) if not m)
        runs = sum(1 for k in range(len(t)) if mark[k] and (not k or not mark[k - 1]))
        want.append((i, len(t), sum(mark), runs, hashlib.sha256(rest).hexdigest()))
    want.sort(key=str)
    assert results(suffixes.remove_repeats(frame(spark, rows))) == want
    # Several batches and levels, and all groups of contexts divided.
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 1 << 15)
    monkeypatch.setattr(suffixes, "LARGE", 1)
    assert results(suffixes.remove_repeats(frame(spark, rows).repartition(5))) == want
    cut = suffixes.without_repeats(frame(spark, rows))
    assert cut.columns == frame(spark, rows).columns
    assert {r.doc_id: r.text for r in cut.collect()}[4].startswith(prose(3, 30)[:100])
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


def brute_components(rows, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and root[a] != root[b] and any(
                x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]
            ):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return [(i, max(map(len, sets[i])), root[i], root[i] == i) for i in ids]


def test_near_duplicates_equal_brute_force(spark, rows, monkeypatch):
    with_id = [(i, t) for i, t in rows if i is not None]
    got = results(near_dups.near_duplicates(frame(spark, rows)))
    want = brute_components(with_id, 85)
    assert [r for r in got if r[0] is not None] == sorted(want, key=str)
    assert [(r[0], r[2], r[3]) for r in got if r[0] is None] == [(None, None, True)]
    monkeypatch.setattr(near_dups, "BLOCK", 300)
    again = results(near_dups.near_duplicates(frame(spark, rows)))
    assert again == got
    assert near_dups.near_duplicates(frame(spark, [])).count() == 0
    kept = {r.doc_id for r in near_dups.one_of_each(frame(spark, rows), 80).collect()}
    assert kept == {i for i, _, c, k in brute_components(with_id, 80) if k} | {None}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (5, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 61)} | {k: 100 for k in range(101, 140)}


def test_bpe_equals_library(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    own = bpe.WordBpe(bpe.vocabulary_path())
    pick = random.Random(2)
    bits = ["it's", "we'll", "<|endoftext|>", "<|startoftext|>", "<|", "ΑΣ", "İ", "é", "é", "12", "!!", " ", "\n", "\x1c",
            "漢字", "aaaa", "'S", "̀", "\u0558", "\u2003", "😀", "ﬁ"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randrange(12))) for _ in range(3000)]
    texts += [t or "" for _, t in rows] + ["".join(pick.choice("abcde") for _ in range(3000))]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert results(bpe.encode_documents(frame(spark, rows), bpe.vocabulary_path())) == sorted(want, key=str)
    full = bpe.encode_documents(frame(spark, rows[:5]), bpe.vocabulary_path(), with_ids=True).collect()
    assert all(own.decode(r.ids) == r.decoded and len(r.ids) == r.n_tokens for r in full)


def test_decontamination_finds_what_is_within_budget(spark):
    pick = random.Random(9)
    items = [(k, prose(100 + k, 20 + k)) for k in range(8)] + [(90, None), (91, ""), (92, "short")]
    docs, want = [], {}
    for n in range(60):
        k = n % 8
        text, budget = list(items[k][1]), int(len(items[k][1]) * decontaminate.RATE)
        for _ in range(pick.randrange(2 * budget)):
            at = pick.randrange(len(text))
            text[at : at + pick.randrange(2)] = pick.choice(["#", ""])
        docs.append((n, "lead " + "".join(text).upper() + "\n tail of it"))
        text, pattern = decontaminate.normal(docs[-1][1]), items[k][1]
        column = list(range(len(pattern) + 1))
        best = column[-1]
        for c in text:
            new = [0]
            for j, p in enumerate(pattern):
                new.append(min(new[-1] + 1, column[j + 1] + 1, column[j] + (p != c)))
            column, best = new, min(best, new[-1])
        if best <= budget:
            want[n, k] = best
    docs += [(100, None), (101, ""), (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, docs), benchmark).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == want | {(None, 0): 0}
    clean = {r.doc_id for r in decontaminate.clean_documents(frame(spark, docs), benchmark).collect()}
    assert clean == {d for d, _ in docs if d is not None} - {d for d, _ in want}


def test_url_rules_and_verdicts(spark):
    pages = [(1, "https://Sub.Example.NET/en/a?x#y"), (2, "http://example.net/de/"), (3, "http://a.org/fr/x"), (4, "http://a.org"),
             (5, None), (6, "no scheme"), (7, "x://example.com/de/#"), (8, "http://notexample.com/de/"), (9, "http://b.net?q"), (9, "")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("gram", F.lit(1)).withColumn("host", F.lit("h"))
    got = {r.page_id: r for r in urls.filter_addresses(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("sub.example.net", "/en/a", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block") and (got[3].rule, got[3].verdict) == ("org/fr/", "allow")
    assert (got[4].host, got[4].path, got[4].rule) == ("a.org", "", None)
    assert [(got[k].host, got[k].path, got[k].rule, got[k].score) for k in (5, 6)] == [("", "", None, 0.0)] * 2
    assert got[7].rule == "example.com/de/" and got[8].rule is None
    assert urls.filter_addresses(df.limit(0)).count() == 0
    assert urls.filter_addresses(df.where("page_id = 4")).first().verdict == "allow"


def test_url_model_equals_brute_force(spark):
    counts = collections.Counter({("abcd", "a"): 3, ("abce", "a"): 1, ("xbcd", "b"): 2, ("abcd", "b"): 1})
    rows = [(g, counts[g, "a"], counts[g, "b"]) for g in ("abcd", "abce", "xbcd", "zzzz")]
    got = {r.gram: r["diff"] for r in urls.model(spark.createDataFrame(rows, "gram string, a long, b long")).collect()}

    def probability(gram, side):
        at = {g: r[1 + (side == "b")] for g, *_ in [(r[0],) for r in rows] for r in rows if r[0] == g}
        p = 1 / urls.ALPHABET
        for k in range(1, 5):
            level = collections.Counter()
            for g, n in at.items():
                level[g[4 - k :]] += n
            mine = gram[4 - k :]
            same = {g: n for g, n in level.items() if g[:-1] == mine[:-1] and n}
            n, kinds = sum(same.values()), len(same)
            p = (level[mine] + kinds * p) / (n + kinds) if n else p
        return p

    for gram in got:
        assert got[gram] == pytest.approx(np.log(probability(gram, "a") / probability(gram, "b")))


def test_quality_rules_counts(spark, rows):
    got = quality_rules.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        times = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {j for k in range(len(words) - 4) if times[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in quality_rules.COUNTS) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_quality_rules_tell_kinds_of_junk(spark):
    docs = [(k, prose(k, 60)) for k in range(80)] + [(100 + k, "### " + " ".join(w + "$$" for w in prose(k, 60).split())) for k in range(8)]
    docs += [(200 + k, prose(k, 60).upper() + "!!!") for k in range(8)]
    kept = {r.doc_id for r in quality_rules.judge(frame(spark, docs)).where("kept").collect()}
    assert kept == set(range(80))


def test_quality_classifier_on_held_out(spark):
    docs = [(k, prose(k, 50) if k % 3 else prose(k, 50).upper() + " ??") for k in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int")
    df = frame(spark, docs)
    model = quality_model.fit(df, labels, F.col("doc_id") < 200, sample_rows=150)
    got = {r.doc_id: r.score for r in quality_model.score(df, model).collect()}
    assert all((got[k] >= 0.5) == (k % 3 > 0) for k in range(200, 300))
    assert got[900] == got[901]
    assert len(quality_model.good_documents(df, model).columns) == len(df.columns)
    none = quality_model.fit(df, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_model.score(df, none).collect()} == {0.5}
    assert quality_model.score(frame(spark, []), model).count() == 0


def test_toxicity_automaton_equals_edit_distance():
    lexicon = toxicity.Lexicon(["idiot", "worthless", "pathetic", "abc"], ["vequ"])
    pick = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(3000):
        word = list(pick.choice(lexicon.words))
        for _ in range(pick.randrange(3)):
            at = pick.randrange(len(word) + 1)
            word[at : at + pick.randrange(2)] = pick.choice(["x", "", "t"])
        word = "".join(word)
        near = [d for t in lexicon.words if (d := distance(word, t)) <= toxicity.edits_allowed(t)]
        assert lexicon.distance(word) == min(near, default=None)
    assert [lexicon.kind(w) for w in ("idiot", "id1ot", "vequoir", "river", "")] == [1, 2, 3, 0, 0]


def test_toxicity_learns_terms(spark):
    docs = [(k, prose(k, 30) + (" you idiot " if k % 2 else " ") + prose(k + 1, 10)) for k in range(300)]
    docs += [(900, "what an idiiot " + prose(5, 20)), (901, prose(6, 20) + ' they said "idiot" once'), (902, None), (903, "")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, docs), labels, F.col("doc_id") < 200).collect()}
    assert all((got[k].score >= 0.3) == bool(k % 2) for k in range(200, 300))
    assert got[900].score >= 0.3 > got[901].score and got[901].quoted == 1
    assert got[902].score == got[903].score < 0.3
    empty = toxicity.score_toxicity(frame(spark, docs), labels.limit(0), F.lit(True))
    assert empty.select("score").distinct().count() == 1


def test_language_of_words_and_code_lengths(spark):
    langs = {"en": "the and that with this from have", "de": "der und das mit dies von haben", "fr": "le et que avec ceci de avoir"}
    pick = random.Random(3)
    docs = [(k, " ".join(pick.choice(langs[x].split()) for _ in range(30)), x) for k, x in enumerate(list(langs) * 40)]
    docs += [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, "der das und", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("key", F.lit(1))
    trees = language.train(df, F.col("doc_id") < 60)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, trees).collect()}
    assert all(got[i][0] == x for i, _, x in docs[60:120]) and got[903][0] == "de"
    assert [got[k] for k in (900, 901, 902)] == [("und", 0.0)] * 3
    # The code length of a word is that of its bytes, by the definition.
    known = collections.defaultdict(collections.Counter)
    for i, t, x in docs[:60]:
        for word in t.encode().split() if x == "en" else []:
            coded = b" " + word + b" "
            for k in range(1, len(coded)):
                for order in range(min(k, language.ORDER) + 1):
                    known[coded[k - order : k]][coded[k]] += 1

    def bits(context, byte):
        counts = known.get(context)
        n, kinds = (sum(counts.values()), len(counts)) if counts else (0, 0)
        if counts and counts[byte]:
            return -np.log2(counts[byte] / (n + kinds))
        left = -np.log2(kinds / (n + kinds)) if counts else 0.0
        return left + (bits(context[1:], byte) if context else 8.0)

    for word in (b"the", b"that", b"thou", b"zz", b"a"):
        coded = b" " + word + b" "
        want = sum(bits(coded[max(0, k - language.ORDER) : k], coded[k]) for k in range(1, len(coded)))
        assert trees.lengths([word])[0, trees.langs.index("en")] == pytest.approx(want, rel=1e-4)
    assert {r.lang_pred for r in language.identify(df, language.train(df, F.lit(False))).collect()} == {"und"}


def test_token_counts_equal_plain_segmentation(spark, rows):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.Pieces(path)

    def plain(word):
        text, best = token_counts.MARK + word, [(0.0, 0)]
        for i in range(1, len(text) + 1):
            size = len(text[i - 1].encode())
            options = [(best[i - 1][0] + size * pieces.byte, best[i - 1][1] + size)]
            for k in range(max(0, i - pieces.longest), i):
                if text[k:i] in pieces.score:
                    options.append((best[k][0] + pieces.score[text[k:i]], best[k][1] + 1))
            top = max(o[0] for o in options)
            best.append((top, min(n for s, n in options if s > top - 1e-9)))
        return best[-1][1]

    got = results(token_counts.count_tokens(frame(spark, rows), path))
    assert got == sorted(((i, len((t or "").split()), sum(map(plain, (t or "").split()))) for i, t in rows), key=str)


def test_misspelt_rare_terms_are_found(spark):
    lexicon = toxicity.Lexicon(["idiot"], ["vequ"], frozenset(["schurke", "miststück", "abcd"]))
    words = ("idiot", "idiott", "schurke", "schurk", "miststuck", "mistztuck", "abcd", "abce", "vequoir", "river")
    assert [lexicon.kind(w) for w in words] == [1, 2, 4, 5, 5, 5, 4, 0, 3, 0]
    # One term is in 185 toxic documents, another in 15 of them, under a twelfth.
    docs = [(k, prose(k, 20) + ((" idiot " if k < 185 else " schurke ") if k < 200 else " ")) for k in range(400)]
    docs += [(900, "you schurkke " + prose(5, 20)), (901, prose(6, 20))]
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, docs), labels, F.lit(True)).collect()}
    assert got[900].near_rare == 1 and got[900].score > got[901].score and got[195].rare == 1


def test_language_trees_keep_every_pair(spark):
    pick = random.Random(8)
    docs = [(k, " ".join("".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(10_000)), "big") for k in range(6)]
    docs.append((90, "ἀρχὴ λόγος θεός", "small"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    trees = language.train(df, F.lit(True))
    words = [w for _, t, _ in docs for w in t.encode().split()]
    pairs = np.unique(np.concatenate(language.context_keys(words)[1]))
    pairs = pairs[pairs > 0]
    assert len(pairs) > 200_000 and trees.langs == ["big", "small"]
    assert np.array_equal(trees.keys, pairs)


def test_an_id_with_three_texts_links_all_of_them(spark):
    texts = [prose(600 + k, 30) for k in range(3)]
    docs = [(1 + k, t) for k, t in enumerate(texts)] + [(9, t) for t in texts] + [(5, prose(700, 30))]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame(spark, docs)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5}

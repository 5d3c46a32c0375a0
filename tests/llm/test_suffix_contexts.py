"""Every string is in the context of one anchor, so a common passage costs a document few rows."""

import numpy as np
import pytest
from test_operators import prose

from tracelode.llm import suffixes


@pytest.mark.parametrize("unit", [suffixes.BYTES, suffixes.WORDS])
def test_every_string_has_one_anchor(unit):
    texts = [prose(k, 300) for k in range(4)] + ["ab " * 400, "x" * 1_500, "one two three " * 90, "short", "", prose(9, 60) * 3, "y " * 51]
    buf, sizes = unit.read([t.encode() for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at, f, left, right = suffixes.anchors(buf, starts, ends, unit)
    grams = suffixes.rolling(buf, unit.gram)
    want = []
    for a, b in zip(starts, ends):
        for s in range(a, b - unit.match + 1):
            want.append((s, s + int(np.argmin(grams[s : s + unit.reach + 1]))))
    got = [(s, p) for p, x, y in zip(at, left, right) for s in range(p - x, p + y - unit.reach + 1)]
    assert sorted(got) == want and len(set(at)) == len(at)
    assert (grams[at] == f).all() and left.max() <= unit.reach and right.max() <= unit.reach


def test_rows_of_a_common_passage(spark, monkeypatch):
    made, compare = [], suffixes._compare

    def counted(rows, unit, *more):
        out = suffixes.shared_table(compare(rows, unit, *more), "compared")
        made.append(out.count())
        return out

    monkeypatch.setattr(suffixes, "_compare", counted)
    passage, rows = prose(11, 90), []
    for n in (100, 200):
        docs = [(k, f"{prose(1000 + k, 40)} {passage} {prose(3000 + k, 40)}") for k in range(n)]
        found = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert all(r.n_removed >= len(passage) for r in found) and len(found) == n
        rows.append(sum(made))
        made.clear()
    # About a range at either end of the passage; what lies between has one context for all.
    assert rows[1] <= 2 * rows[0] and rows[0] < 250, rows

"""Very small limits, single characters of several tokens, and windows of the sparse table."""

import random

import numpy as np
import pytest

from thermaline.llm.mixing import mix_corpus
from thermaline.llm.splitting import SparseTable, split
from thermaline.llm.tokens import codec


@pytest.mark.parametrize("limit", [3, 5, 8])
def test_no_piece_is_over_a_small_limit(limit):
    c, rng = codec(), random.Random(limit)
    for _ in range(30):
        text = "".join(rng.choice(["a", " ", "\n", "é", "日", "😀", "word ", "\t\t", "@@ -1 +1 @@\n", "x" * 9]) for _ in range(60))
        pieces = split(text, c, limit, 1)
        data = text.encode()
        assert all(n <= limit and n == len(c.ids(data[s:e].decode())) for s, e, n in pieces)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(data) and all(p[1] >= q[0] > p[0] for p, q in zip(pieces, pieces[1:]))


def test_a_limit_below_one_character_is_refused():
    c = codec()
    char = next(ch for ch in "𒀀𓀀𐎠🜁日" if len(c.ids(ch)) > 1)
    with pytest.raises(ValueError, match="can be cut"):
        split(char * 4, c, 1, 0)


def test_the_table_makes_only_the_levels_asked_for():
    v = np.random.default_rng(0).integers(0, 5, 1000)
    t = SparseTable(v, 20)
    assert len(t.levels) == 5
    for lo in range(0, 980, 37):
        best = t.argmax(lo, lo + 19)
        assert v[best] == v[lo : lo + 20].max() and not (v[best + 1 : lo + 20] == v[best]).any()


def test_too_many_targets_are_refused_before_anything_is_encoded(spark, monkeypatch):
    from thermaline.llm import mixing

    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    docs = spark.createDataFrame([(1, "t", "a")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError, match="more than 1 sources"):
        mix_corpus(docs, targets)

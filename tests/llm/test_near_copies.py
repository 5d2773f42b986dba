"""Near copies in the pipeline's second stage."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from pyrocline.llm import near_copies

COLUMNS = "doc_id long, text string, source string"


def shingles(text):
    words = text.split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Smallest ids of the components of all pairs with a similarity of 0.8."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)


def edited(draw, words, edits):
    words = list(words)
    for at in draw.choice(len(words), edits, replace=False):
        words[at] = f"n{draw.integers(10**9)}"
    return words


def test_edited_copies_go(spark):
    draw = np.random.default_rng(3)
    rows = []
    for group in range(30):
        base = [f"w{k}" for k in draw.integers(0, 5000, 150 + group)]
        rows += [(len(rows) + k, " ".join(edited(draw, base, k))) for k in range(6)]  # 0 to 5 edits: on both sides of 0.8
    base = [f"c{k}" for k in range(400)]
    for _ in range(60):  # a chain: only neighbours are similar
        rows.append((len(rows), " ".join(base)))
        base = edited(draw, base, 3)
    wanted = brute_kept(rows)
    assert 30 < len(wanted) < 120
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(*r, "s") for r in rows], COLUMNS), "")
    assert sorted(r.doc_id for r in kept.collect()) == wanted


@pytest.mark.parametrize("rows", [[(1, None), (2, ""), (None, "the cat sat"), (3, " \n"), (4, "x"), (4, "x"), (5, "the cat sat"), (None, None)]])
def test_odd_rows(spark, rows):
    frame = spark.createDataFrame([(*r, "s") for r in rows], COLUMNS)
    assert sorted((r.doc_id, r.text or "") for r in near_copies.deduplicate(frame).collect()) == [(1, ""), (4, "x"), (5, "the cat sat")]
    assert near_copies.deduplicate(frame.where("false")).count() == 0
    assert near_copies.deduplicate(frame).columns == frame.columns


def test_one_id_with_two_texts(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "u v w x y z", "s")], COLUMNS)
    assert sorted((r.doc_id, r.text[0]) for r in near_copies.deduplicate(frame).collect()) == [(1, "a"), (2, "u")]

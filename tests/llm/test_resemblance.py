import random
from itertools import combinations

import pytest

from planarix.llm import resemblance
from tests.llm import cases


def plain_components(rows):
    """Smallest identifier of each row's component, by comparing all pairs of sets of 5-word shingles."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], least.get(find(i))) for i, r in enumerate(rows)]


def edited_rows():
    """Texts with several words changed here and there, so that similarities lie around 0.8, also in chains."""
    rnd = random.Random(3)
    out = []
    for g in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(30, 400))]
        for _ in range(20):
            out.append((len(out) * 7 % 1009, " ".join(words), "en", "a", 1))
            base = list(words)
            for _ in range(rnd.randrange(1, 2 + len(words) // 60)):
                base[rnd.randrange(len(base))] = f"e{rnd.randrange(5000)}"
            words = base if g % 2 or rnd.random() < 0.3 else words
    return out


@pytest.mark.parametrize("rows", [cases.rows(), edited_rows()])
def test_near_copies(spark, rows):
    got = resemblance.near_copies(cases.frame(spark, rows, extra=True)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(plain_components(rows), key=str)


def chained_rows():
    """Texts that share four fifths with their neighbours only: buckets hold several components' members for long."""
    rnd = random.Random(8)
    out = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(25):
            words = list(base)
            for _ in range(rnd.choice([1, 1, 2, 3, 5])):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            out.append((len(out), " ".join(words), "en", "a", 1))
    return out


@pytest.mark.parametrize("rows", [edited_rows(), chained_rows()])
def test_near_copies_in_small_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(resemblance, "BLOCK", 3)
    monkeypatch.setattr(resemblance, "FEW", 1)
    got = resemblance.near_copies(cases.frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(plain_components(rows))


def test_pipeline_drops_near_copies(spark, tmp_path):
    import corpus_pipeline as cp

    rows = edited_rows()
    kept = cp.drop_near_copies(spark, cases.frame(spark, rows), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in plain_components(rows)}


def test_empty(spark):
    assert resemblance.near_copies(cases.frame(spark, [])).count() == 0

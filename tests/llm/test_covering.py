import random

import numpy as np
import pyarrow as pa
import pytest

from planarix.llm import covering, resemblance
from tests.llm import cases
from tests.llm.test_resemblance import chained_rows, edited_rows, plain_components


def flip(rnd, print_, n):
    bits = np.unpackbits(print_.view(np.uint8))
    bits[rnd.sample(range(covering.BITS), n)] ^= 1
    return np.packbits(bits).view(np.uint64)


def test_close_fingerprints_meet():
    rnd, radius = random.Random(1), covering.PIECES * (covering.RADIUS + 1) - 1
    one = np.array([covering.fingerprint(np.array([rnd.getrandbits(64) for _ in range(9)], np.uint64)) for _ in range(300)])
    two = np.array([flip(rnd, p, rnd.randrange(radius + 1)) for p in one])
    assert (covering.keys(one) == covering.keys(two)).any(1).all()
    assert not (covering.keys(one) == covering.keys(one[::-1])).any(1)[:100].all()


def test_majority():
    hashes = np.array([random.Random(2).getrandbits(64) for _ in range(1000)], np.uint64)
    for n in (0, 1, 2, 255, 256, 1000):
        seeds = np.arange(1, covering.WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.unpackbits(resemblance.arrow.mix(hashes[:n, None] ^ seeds).view(np.uint8), axis=1).astype(int)
        assert (np.unpackbits(covering.fingerprint(hashes[:n]).view(np.uint8)) == (2 * bits.sum(0) > n)).all()


def joined(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent) if find(x) != x}


def test_links_span():
    rnd = random.Random(3)
    for _ in range(200):
        pairs = np.array([(rnd.randrange(40), rnd.randrange(40)) for _ in range(rnd.randrange(60))], np.int64).reshape(-1, 2)
        found = covering.spanning(pairs).tolist()
        assert joined(found) == joined(pairs.tolist()) and len(found) == len(joined(found))
    for n in (2, 40, 300):  # a bucket of chains and copies, against all pairs
        prints = [np.zeros(covering.WORDS, np.uint64)]
        while len(prints) < n:
            prints.append(flip(rnd, rnd.choice(prints[-9:]), rnd.randrange(1, 200)))
        prints = np.array(prints)[:, : covering.SENT]
        group = np.array([rnd.randrange(n) if rnd.random() < 0.2 else i for i in range(n)])
        near = [(int(group[i]), int(group[j])) for i in range(n) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= covering.NEAR]
        got = list(covering.bucket_links(group, prints))
        assert joined(got) == joined(near) and len(got) == len(joined(got))


@pytest.mark.parametrize("rows", [edited_rows(), chained_rows()])
def test_near_copies_in_large_buckets(spark, monkeypatch, rows):
    monkeypatch.setattr(covering, "SMALL", 2)
    got = resemblance.near_copies(cases.frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(plain_components(rows))


def test_pipeline_takes_candidates_from_simhash(spark, monkeypatch, tmp_path):
    """What neither equal first numbers nor the fingerprints' tables link, no other path does."""
    import corpus_pipeline as cp

    rows = edited_rows()
    different = {r[0] for r in {r[1]: r for r in rows}.values()}
    docs = cases.frame(spark, [r for r in rows if r[0] in different])
    sets = resemblance.shingle_sets(pa.array([r[1] for r in rows if r[0] in different]))
    first = {int(covering.fingerprint(s)[0]) for s in sets}
    assert cp.drop_near_copies(spark, docs, str(tmp_path)).count() < len(first)
    monkeypatch.setattr(covering, "groups", lambda prints: prints.selectExpr("print[0] node", "print[0] component").limit(0))
    assert cp.drop_near_copies(spark, docs, str(tmp_path)).count() == len(first)

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from planarix.llm import arrow, exact_dedup, simhash, substring_dedup
from tests.llm import cases


def lower(t):
    return (t or "").encode().lower()


def plain_exact(rows, largest):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = [i for i in groups[lower(r[1])] if i is not None]
        best = (max if largest else min)(ids) if ids else None
        out.append((r[0], best, len(groups[lower(r[1])]), r[0] == best, hashlib.sha256(lower(r[1])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("limit", [exact_dedup.TRIE_BYTES, 4000])
def test_exact(spark, keep, limit):
    got = exact_dedup.deduplicate(cases.frame(spark), keep=keep, limit=limit)
    found = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in got.collect()), key=str)
    assert found == plain_exact(cases.rows(), keep == "largest")


def test_exact_keeps_other_columns_and_empty_tables(spark):
    got = exact_dedup.deduplicate(cases.frame(spark, extra=True))
    assert got.count() == len(cases.rows()) and {"lang", "score"} <= set(got.columns)
    assert exact_dedup.deduplicate(cases.frame(spark, [])).count() == 0


def test_trie_spills_and_loses_nothing():
    rnd = random.Random(1)
    keys = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 40))) for _ in range(3000)]
    trie = exact_dedup.PatriciaTrie(limit=20000, largest=True)
    want = defaultdict(lambda: [0, -1])
    for n, k in enumerate(keys):
        trie.insert(k, n)
        want[k] = [want[k][0] + 1, n]
        if trie.full():
            trie.shrink()
    assert trie.spills > 0
    items = list(trie.items())
    assert len(items) == len(want) and all(want[k] == [n, b] for k, b, n in items)


def plain_substring(rows, size):
    docs = [lower_words.encode().split() if (lower_words := r[1]) else [] for r in rows]
    count = defaultdict(int)
    for d in docs:
        for i in range(len(d) - size + 1):
            count[tuple(d[i : i + size])] += 1
    out = []
    for r, d in zip(rows, docs, strict=True):
        gone = set()
        for i in range(len(d) - size + 1):
            if count[tuple(d[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((r[0], len(d), len(gone), b" ".join(w for i, w in enumerate(d) if i not in gone).decode()))
    return sorted(out, key=str)


TIGHT = substring_dedup.Limits(block=3000, dest=9000, held=50, step=40, least_bits=4, range_bits=5)


@pytest.mark.parametrize(("size", "gram", "limits"), [(35, 8, substring_dedup.LIMITS), (35, 8, TIGHT), (5, 2, substring_dedup.LIMITS), (3, 3, TIGHT)])
def test_substring(spark, size, gram, limits):
    got = substring_dedup.remove_repeats(cases.frame(spark), size=size, gram=gram, limits=limits)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=str) == plain_substring(cases.rows(), size)


def test_substring_filter_only_saves_work(spark):
    full = substring_dedup.Limits(cells=0, least_bits=4, range_bits=2)  # sixteen cells a row let everything pass
    got = substring_dedup.remove_repeats(cases.frame(spark, extra=True), limits=full)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=str) == plain_substring(cases.rows(), 35)
    assert substring_dedup.remove_repeats(cases.frame(spark, [])).count() == 0


def thue_morse(n):
    """A word and its complement, which agree under every polynomial hash modulo 2**64 for n of 1024 and more."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]


@pytest.mark.parametrize("n", [60, 1024, 4096])
def test_substring_tells_words_apart(spark, n):
    head = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{head} {w}", "en", "a", 1) for i, w in enumerate([*thue_morse(n), "other"])]
    got = substring_dedup.remove_repeats(cases.frame(spark, rows), limits=substring_dedup.Limits(cells=0, least_bits=1, range_bits=1)).collect()
    assert [r["n_removed"] for r in got] == [0, 0, 0]
    both = np.frombuffer(" ".join(thue_morse(n)).encode(), np.uint8)
    one, two = arrow.word_hashes(both, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
    assert one != two


def test_substring_of_a_long_text(spark):
    rnd = random.Random(4)
    words = [f"v{rnd.randrange(10**6)}" for _ in range(300_000)]
    words[200_000:200_050] = words[100:150]
    got = substring_dedup.remove_repeats(cases.frame(spark, [(1, " ".join(words), "en", "a", 1), (2, "short", "en", "a", 1)]), limits=substring_dedup.Limits(step=7000)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 300_000, 100), (2, 1, 0)]


def plain_fingerprint(text):
    words = lower(text).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(items, radius):
    """(fingerprint, id) -> smallest id reachable, over all pairs."""
    fps = sorted({f for f, _ in items})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    least = {}
    for f, i in items:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in fps}


def test_simhash(spark):
    rows = cases.rows()
    got = simhash.near_duplicates(cases.frame(spark, extra=True)).collect()
    prints = [(plain_fingerprint(r[1]), r[0]) for r in rows]
    classes = plain_classes(prints, 2)
    want = sorted(((i, f, classes[f]) for f, i in prints), key=str)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == want
    assert simhash.near_duplicates(cases.frame(spark, [])).count() == 0


def test_masks_cover_every_pair():
    from itertools import combinations

    for radius in (1, 2, 3):
        tables = simhash.masks(radius, 12)
        for flips in combinations(range(12), radius):
            pattern = sum(1 << f for f in flips)
            assert any(not pattern & m for m in tables)


@pytest.mark.parametrize("small", [simhash.SMALL, 10])
def test_links_span_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5))) for c in centres for _ in range(60)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    frame = spark.createDataFrame([(signed(f),) for f in sorted(fps)], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() for a, b in edges)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    want = plain_classes([(f, f) for f in fps], 2)
    assert len({find(f) for f in fps}) == len(set(want.values()))
    assert all(len({want[g] for g in fps if find(g) == find(f)}) == 1 for f in centres if f in fps)


def test_bucket_both_ways():
    rnd = np.random.default_rng(3)
    mask = simhash.masks(2)[3]
    base = int(rnd.integers(0, 1 << 62)) & mask
    values = np.unique(np.array([base | (int(x) & ~mask & (1 << 64) - 1) for x in rnd.integers(0, 1 << 8, 200)], np.uint64))
    roots = []
    for limit in (10_000, 1):
        simhash.SMALL, old = limit, simhash.SMALL
        a, b = simhash.bucket_links(values, mask, 2)
        simhash.SMALL = old
        roots.append(dict(zip(a.tolist(), b.tolist(), strict=True)))
    assert roots[0] == roots[1]

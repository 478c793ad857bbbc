import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from planarix.llm import mixing, queries, sharding, url_filter
from planarix.operators import components
from tests.llm import cases


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rnd = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, shards):
    rows = cases.rows()
    got = sharding.assign(cases.frame(spark, extra=True), shards).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    assert sharding.assign(cases.frame(spark, []), shards).count() == 0


def test_shards_are_near_equal_despite_hot_texts(spark):
    rows = [(i, "hot text " * 10 if i % 3 else f"text {i} " * (i % 50), "en", "a", 1) for i in range(20000)]
    got = sharding.assign(cases.frame(spark, rows), 8).groupBy("shard").sum("size").collect()
    sizes = [r["sum(size)"] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 500 + sum(sizes) / 8 * 2e-4


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixing(spark):
    rows = cases.rows()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = plain_targets(sizes)
    for extra in (False, True):
        got = mixing.mix(cases.frame(spark, extra=extra)).collect()
        assert len(got) == len(rows) + 0
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got:
            assert r["size"] == words(r["text"]) if "text" in r else True
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
            taken[r["source"]] += r["size"] * r["copies"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert all(abs(taken[s] - want[s]) <= largest[s] * 1.01 for s in sizes)
    assert mixing.mix(cases.frame(spark, [])).count() == 0
    empty = mixing.mix(cases.frame(spark, [(1, None, "en", None, 1), (2, "", "en", "a", 0)])).collect()
    assert [r["target"] for r in empty] == [0.0, 0.0]


def test_mixes_are_nested(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 37), f"s{i % 5}") for i in range(4000)], "doc_id long, text string, source string")
    runs = [{r["doc_id"]: r["copies"] for r in mixing.mix(docs, share=s).collect()} for s in (0.3, 0.8, 1.3, 1.9)]
    for small, big in zip(runs, runs[1:], strict=False):
        assert all(small[i] <= big[i] for i in small)


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.encode().lower().decode()
    fits = [(len(h) + len(p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "://x.com/en/1", "HTTP://A.Example.COM/en/7?x#y", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "http://b.net/de/", "http://example.net/de/80", "http://b.example.net/de/7", "http://example.org?x=/es/", "http://example.org/es/#", "a://b://c.org/es/", "http://é.ORG/es/É\n2", "http://.com/en/x", "http://com./en/", "x://y.net/de/://"] * 2
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: plain_judge(u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def keyed(rows):
    """Rows as comparable tuples, also where values are missing."""
    return sorted((tuple(r) for r in rows), key=str)


def test_pipeline_stages(spark, tmp_path):
    """Every stage against a plain version, over hard cases and columns named as operators name their results."""
    import corpus_pipeline as cp
    from planarix.llm import toxicity
    from tests.llm.test_resemblance import plain_components

    base = str(tmp_path)
    cases.frame(spark, extra=True).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(200, 260)], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    everything = docs.collect()
    text = docs.columns.index("text")

    # toxicity: the rows whose own score is below a half
    labels = spark.read.parquet(f"{base}/labels.parquet").where(~queries.held_out())
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    kept = cp.drop_toxic(spark, docs, base)
    assert kept.columns == docs.columns and keyed(kept.collect()) == keyed(r for r in everything if scorer.score(r["text"] or "") < 0.5)

    # exact copies: one row a text, of the largest identifier
    exact = cp.drop_exact_copies(spark, docs, base)
    best = {}
    for r in everything:
        body = (r[text] or "").encode().lower()
        if body not in best or (r["doc_id"] is not None and (best[body] is None or r["doc_id"] > best[body])):
            best[body] = r["doc_id"]
    found = exact.collect()
    assert exact.columns == docs.columns and sorted(((r["text"] or "").encode().lower(), r["doc_id"]) for r in found if r["doc_id"] is not None) == sorted((b, i) for b, i in best.items() if i is not None)
    assert len(found) == len(best) and all(tuple(r) in set(map(tuple, everything)) for r in found)

    # near copies: the smallest identifier of each group, of all pairs
    near = cp.drop_near_copies(spark, exact, base)
    rows = [tuple(r) for r in found]
    want = [r for r, (i, c) in zip(rows, plain_components(rows), strict=True) if i == c]
    assert near.columns == docs.columns and keyed(near.collect()) == keyed(want)

    # mixing: every document as often as the mix says
    mixed = cp.mix_sources(spark, docs, base)
    times = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(docs).collect()}
    want = [r for r in everything for _ in range(times[r["doc_id"], r["source"]])]
    assert mixed.columns == docs.columns and keyed(mixed.collect()) == keyed(want)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in everything:
        sizes[r["source"]] += words(r["text"])
    for r in want:
        taken[r["source"]] += words(r["text"])
    assert all(abs(taken[s] - t) <= max(words(r["text"]) for r in everything if r["source"] == s) for s, t in plain_targets(sizes).items())


def test_pipeline_runs(spark, tmp_path):
    import corpus_pipeline as cp

    base = str(tmp_path)
    cases.frame(spark).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(200, 260)], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    out = cp.run(spark, base)
    assert out.where("not round_trip").count() == 0 and out.count() > 0
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, base).collect(), docs.schema)
    assert out.groupBy("doc_id").count().exceptAll(docs.groupBy("doc_id").count()).count() == 0 and out.count() == docs.count(), name
    cases.frame(spark, []).write.mode("overwrite").parquet(f"{base}/documents.parquet")
    assert cp.run(spark, base).count() == 0

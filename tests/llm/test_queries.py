"""Registered queries against plain versions, over the smallest tables and hand-made hard cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard as zstd
from pyspark.sql import functions as F

from planarix.llm import arrow, fingerprints, quality, queries, toxicity
from tests.llm import cases
from tests.llm.test_dedup import plain_classes, plain_fingerprint


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The smallest tables with the hard cases added."""
    base = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = cases.frame(spark).selectExpr("-doc_id as doc_id", "text", "lang", "source", "n_chars")
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    spark.read.parquet(f"{sf_dir}/pages.parquet").write.parquet(f"{base}/pages.parquet")
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{base}/documents.parquet").to_pylist()]
    return str(base), rows


def held_out(ident):
    return ident is not None and zlib.crc32(str(ident).encode()) % 5 == 0


def plain_toxicity(model, text):
    """A window's gain is the difference of its two compressed lengths; the curve is a logistic one."""
    params = zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=model.match, target_length=32, strategy=zstd.STRATEGY_GREEDY)
    size = lambda d, w: len(zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)).compress(w))
    words, word = [], ""
    kind = lambda c: 0 if c.isspace() else 1 if re.match(r"[^\W_]", c) else 2
    for c in (text or "").lower():
        if word and kind(c) != kind(word[-1]):
            words.append(word)
            word = ""
        word = word + c if kind(c) else ""
    words = [w for w in [*words, word] if w]
    windows = [(" " + " ".join(words[i : i + model.window]) + " ").encode() for i in range(0, len(words), model.window)]
    gains = [size(model.ordinary, w) - size(model.toxic, w) for w in windows]
    hit = [g for g in gains if g >= model.threshold]
    n = max(1, len(gains))
    x = (math.log1p(len(hit)), math.log1p(100 * len(hit) / n), math.log1p(sum(hit) / n))
    z = model.bias + sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=True))
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_toxicity(spark, tables):
    base, rows = tables
    got = queries.op1_toxicity(spark, base).collect()
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~queries.held_out()))
    some = [(i, t) for n, (i, t) in enumerate(rows) if n % 7 == 0 or i is None or i < 0]
    scores = defaultdict(list)
    for r in got:
        assert r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5)
        scores[r["doc_id"]].append(r["score"])
    assert sum(map(len, scores.values())) == len(rows)
    for i, t in some:
        if len(t or "") < 20_000:
            want = plain_toxicity(model, t)
            assert any(abs(want - s) < 1e-9 for s in scores[i]), i


def test_toxicity_never_learns_from_held_out_rows(spark, tables, tmp_path):
    base, _ = tables
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{base}/{t}.parquet")
        if t == "labels":
            df = df.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    scores = [sorted(map(str, queries.op1_toxicity(spark, p).select("doc_id", "score").collect())) for p in (base, str(tmp_path))]
    assert scores[0] == scores[1]


def plain_features(text):
    raw = (text or "").encode()
    mixed = lambda n: int(arrow.mix(np.array([n], np.uint64))[0]) % quality.BUCKETS
    grams = Counter(mixed(int.from_bytes(raw[i : i + 4], "little")) for i in range(len(raw) - 3))
    spots = lambda w: int(arrow.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) % quality.BUCKETS
    words = Counter(spots(w) for w in raw.split())
    out = {}
    for part, base in ((grams, 0), (words, quality.BUCKETS)):
        for k, n in part.items():
            out[base + k] = math.sqrt(n / sum(part.values()))
    return out


def test_quality(spark, tables):
    """Expected grade and tail from the cumulative logistic model, term by term."""
    base, rows = tables
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality"))
    got = defaultdict(list)
    for r in queries.op2_quality(spark, base).collect():
        got[r["doc_id"]].append((r["expected_grade"], r["tail_probability"]))
    assert sum(map(len, got.values())) == len(rows)
    for i, t in [r for n, r in enumerate(rows) if n % 11 == 0 and len(r[1] or "") < 5000]:
        z = sum(model.weights[k] * v for k, v in plain_features(t).items())
        upto = [1 / (1 + math.exp(-(b - z))) for b in model.thresholds] + [1.0]
        chance = [b - a for a, b in zip([0.0, *upto], upto, strict=False)]
        want = (sum(p * g for p, g in zip(chance, model.grades, strict=True)), sum(p for p, g in zip(chance, model.grades, strict=True) if g >= 1))
        assert any(abs(a - want[0]) < 1e-3 and abs(b - want[1]) < 1e-3 for a, b in got[i])


def test_quality_fit_is_the_optimum():
    """No small step from the fitted weights lowers the penalised loss by much."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 3)).astype(np.float32)
    grade = np.digitize(x @ [2.0, -1.0, 0.0] + rnd.logistic(size=300), [-1.0, 0.5, 2.0])
    w, b = quality.train(x, grade, np.ones(300), 4, rounds=4000)

    def loss(w, b):
        edge = np.concatenate([[-np.inf], b, [np.inf]])
        z = x @ w
        p = 1 / (1 + np.exp(-(edge[grade + 1] - z))) - 1 / (1 + np.exp(-(edge[grade] - z)))
        return -np.log(p).mean() + 1e-4 * (w**2).sum()

    here = loss(w, b)
    assert all(loss(w + d[:3], b + d[3:]) > here - 2e-4 for d in rnd.normal(scale=0.05, size=(200, 6)))
    assert abs(w[0] - 2) < 0.5 and abs(w[1] + 1) < 0.5 and (np.diff(b) > 0).all()


def test_quality_sample_bounds(spark):
    ratings = spark.range(40_000).selectExpr("id as doc_id", "case when id % 100 = 0 then 1 else 0 end as quality")
    picked, counts = quality.sample(ratings, 600, 500, "doc_id", "quality")
    n = {r["grade"]: r["count"] for r in picked.groupBy("grade").count().collect()}
    assert counts == {0.0: 39_600, 1.0: 400} and n == {0.0: 300, 1.0: 300}
    with pytest.raises(ValueError, match="steps"):
        quality.sample(spark.range(1000).selectExpr("id as doc_id", "id / 7.0 as quality"), 600, 500, "doc_id", "quality")


def test_sharding(spark, tables):
    base, rows = tables
    got = queries.op6_sharding(spark, base).collect()
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None} and {r["shard"] for r in got} <= set(range(8))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len((t or "").encode()) + 1 for _, t in rows)


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, tables):
    """Texts of fewer shingles than a sketch holds have exact likenesses, those of others come near."""
    base, rows = tables
    got = queries.op7_fingerprints(spark, base).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + (1 << 63) & (1 << 64) - 1, r[1] or ""))
    want, prints = defaultdict(list), defaultdict(set)
    for (i, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        edited = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()].append((shingles(t), shingles(edited), shingles(f), t))
    assert len(got) == len(rows)
    for r in got:
        a, e, n, text = want[r["doc_id"], r["n_chars"], r["edited_sha256"]][0]
        prints[text].add(r["fingerprint"])
        for found, b in ((r["near_edited"], e), (r["near_next"], n)):
            exact = 1.0 if not a and not b else len(a & b) / len(a | b)
            assert abs(found - exact) < (1e-9 if len(a | b) <= fingerprints.K else 0.25)
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_of_other_identifiers(spark):
    rows = [("b", "one two three"), ("a", "four"), (None, "five six"), ("b", "one two three"), ("c", None)] * 3
    docs = spark.createDataFrame(rows, "name string, text string").withColumn("h", F.lit(1))
    got = fingerprints.compare_edits(docs, id_col="name").collect()
    assert Counter(r["name"] for r in got) == Counter(i for i, _ in rows)
    nulls = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "concat('text ', id) as text")
    parts, ranges = fingerprints.with_next(nulls)
    assert len(ranges) > 1 and parts.where("not guest").count() == 3000
    merged = fingerprints.merged(fingerprints.fingerprint(docs.withColumnRenamed("name", "n")), ["n", "h"])
    assert {r["n"] for r in merged.collect()} == {"a", "b", "c", None}


def test_simhash(spark, tables):
    base, rows = tables
    got = queries.op8_simhash(spark, base).collect()
    prints = [(plain_fingerprint(t), i) for i, t in rows]
    classes = plain_classes(prints, 2)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{f:016x}", classes[f]) for f, i in prints)


def test_urls(spark, tables):
    from tests.llm.test_tables import plain_judge

    base, _ = tables
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{base}/pages.parquet").collect()}
    got = queries.op10_url_filter(spark, base).collect()
    assert len(got) == len(urls) and all((r["host"], r["path"], r["rule"], r["verdict"]) == plain_judge(urls[r["page_id"]]) for r in got)

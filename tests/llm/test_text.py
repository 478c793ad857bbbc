import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from planarix.llm import arrow, bpe, fingerprints, quality, toxicity
from tests.llm import cases

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_words_of_batches():
    texts = [r[1] for r in cases.rows()] + ["\x85a", "b"]
    col = pa.array(texts, pa.string())
    for step in (1, 100, 1 << 20):
        got = []
        for i, j, raw, off in arrow.pieces(col, step):
            s, e, rows = arrow.word_spans(raw, off)
            got += [(i + r, raw[a:b].tobytes()) for a, b, r in zip(s, e, rows, strict=True)]
        assert got == [(n, w) for n, t in enumerate(texts) for w in (t or "").encode().split()]


def test_bpe_equals_library(spark, library):
    done = bpe.decode(bpe.encode(cases.frame(spark, extra=True), PATH), PATH).collect()
    assert len(done) == len(cases.rows())
    for r in done:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.encode(cases.frame(spark, []), PATH).count() == 0


def test_bpe_random_strings(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)  # generations turn over
    codec, rnd = bpe.Codec(bpe.Tables.load(PATH)), random.Random(2)
    for _ in range(3000):
        t = "".join(rnd.choice("aeiotnsrlhd  'st1é\n") if rnd.random() < 0.9 else chr(rnd.randrange(0x20, 0x2FFF)) for _ in range(rnd.randrange(0, 60)))
        t = t.encode("utf-8", "ignore").decode()
        assert np.frombuffer(codec.encode(t), "<i4").tolist() == library.encode(t, add_special_tokens=False).ids
    for start in (0x558, 0x88F, 0xA7CE, 0x12550, 0x18D09, 0x323B0, 0x1E6F0, 0x4E00, 0x1F600):
        t = "".join(f"a{chr(c)}{chr(c)}1 {chr(c)}'s " for c in range(start, start + 8))
        assert np.frombuffer(codec.encode(t), "<i4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert codec.decode([0, 50256]) == library.decode([0, 50256], skip_special_tokens=False)


def test_workers_keep_nothing_of_other_steps(spark):
    """Python workers are used again by later steps: a codec and free memory of an earlier one mustn't add to theirs."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    assert bpe.encode(docs, PATH).where("size(ids) > 0").count() == 64

    def held(batch):
        import gc

        gc.collect()
        return [pa.array([sum(isinstance(x, bpe.Codec) for x in gc.get_objects())] * batch.num_rows)]

    assert arrow.with_columns(docs, "codecs bigint", held).agg({"codecs": "max"}).first()[0] == 0

    def anonymous() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) // 1024

    def large(batch):
        before = anonymous()
        some = [pa.array([1.0] * (1 << 17)) for _ in range(128)]  # 1 MB each
        del some
        return [pa.array([before] * batch.num_rows)]

    first = arrow.with_columns(docs, "mb bigint", large).agg({"mb": "min"}).first()[0]
    assert arrow.with_columns(docs, "mb bigint", large).agg({"mb": "max"}).first()[0] < first + 64


def test_sketches_match_plain_sets():
    texts = [r[1] for r in cases.rows()]
    for k in (4, 64):
        got = fingerprints.sketches(pa.array(texts, pa.string()), k)
        every = fingerprints.sketches(pa.array(texts, pa.string()), 1 << 30)
        for t, a, b in zip(texts, got, every, strict=True):
            words = (t or "").encode().split()
            want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            assert len(b) == len(want) and a.tolist() == b[:k].tolist() and (np.diff(a.astype(object)) > 0).all()


def test_sketch_estimates():
    left, right = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(1000, 5000))
    a, b, both = fingerprints.sketches(pa.array([left, right, left + " " + right], pa.string()), 512)
    assert abs(fingerprints.resemblance(a, b, 512) - 3000 / 5000) < 0.08
    assert abs(fingerprints.containment(a, b, 512) - 0.75) < 0.1
    assert abs(fingerprints.distinct(a, 512) / 3996 - 1) < 0.15
    assert fingerprints.from_hex(fingerprints.to_hex(a)).tolist() == a.tolist()
    assert len(np.setdiff1d(fingerprints.merge(a, b, 512), both)) <= 6  # but for shingles across the seam


def test_merged_fingerprints(spark):
    df = fingerprints.fingerprint(cases.frame(spark), k=16)
    got = {r["source"]: r["fingerprint"] for r in fingerprints.merged(df, ["source"], k=16).collect()}
    for s, f in got.items():
        parts = [x for r in df.collect() if r["source"] == s for x in fingerprints.from_hex(r["fingerprint"]).tolist()]
        assert fingerprints.from_hex(f).tolist() == sorted(set(parts))[:16]


def test_edits(spark):
    rows = cases.rows()
    got = fingerprints.compare_edits(cases.frame(spark)).collect()
    hashed = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63) & (1 << 64) - 1  # noqa: E731  in signed order
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]), r[1] or ""))
    want = []
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        t, f = r[1] or "", n[1] or ""
        want.append((r[0], len(t), t[: len(t) - len(t) // 2] + f[: len(t) // 2]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        a, e = (fingerprints.from_hex(r[c]) for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == fingerprints.resemblance(a, e) and 0 <= r["near_next"] <= 1
        assert e.tolist() == fingerprints.sketches(pa.array([r["edited"]]))[0].tolist()
    assert fingerprints.compare_edits(cases.frame(spark, [])).count() == 0
    one = fingerprints.compare_edits(cases.frame(spark, [(5, "abc d e", "en", "a", 1)])).collect()
    assert len(one) == 1 and one[0]["edited"] == "abc abc" and one[0]["near_next"] == 1.0


def _prose(rnd, bad=()):
    words = [rnd.choice("ta ri mo ne su").join(rnd.choices(["lo", "ka", "ti", "er", "in"], k=3)) for _ in range(rnd.randrange(30, 200))]
    for b in bad:
        for _ in range(2):
            words[rnd.randrange(len(words))] = b + rnd.choice(["", "a", "en"])
    return " ".join(words)


def test_toxicity_learns(spark):
    rnd = random.Random(4)
    rows = [(i, _prose(rnd, ("grobnik", "vexal") if i % 5 == 0 else ()), "en", "a", 1) for i in range(600)] + [(9001, None, "en", "a", 1), (9002, "", "en", "a", 1)]
    docs = cases.frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    right = sum(got[i]["predicted"] == int(i % 5 == 0) for i in range(300, 600))
    assert right >= 294 and got[9001]["predicted"] == got[9002]["predicted"] == 0
    assert toxicity.fit(docs, labels) == model


def test_toxicity_without_a_class(spark):
    docs = cases.frame(spark, extra=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    some = spark.createDataFrame([(7, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {1}


def test_quality_grades(spark):
    rnd = random.Random(6)
    junk = lambda share: " ".join("%%$" if rnd.random() < share else rnd.choice(["tari", "mone", "sulo", "kati"]) for _ in range(120))
    rows = [(i, junk((0.6, 0.35, 0.15, 0.0)[i % 4]), "en", "a", 1) for i in range(800)]
    docs = cases.frame(spark, rows)
    ratings = spark.createDataFrame([(i, i % 4) for i in range(500)], "doc_id long, quality int")
    model = quality.fit(docs, ratings)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.score(docs, model, reach=2.0).collect()}
    assert np.mean([abs(got[i]["expected_grade"] - i % 4) for i in range(500, 800)]) < 0.5
    assert np.mean([(got[i]["tail_probability"] >= 0.5) == (i % 4 >= 2) for i in range(500, 800)]) > 0.9


def test_quality_edges(spark):
    docs = cases.frame(spark, extra=True)
    for known in ([], [(1, 1)], [(1, 0), (15, 1), (None, 1), (4, None)]):
        out = quality.score(docs, quality.fit(docs, spark.createDataFrame(known, "doc_id long, quality int"))).collect()
        assert len(out) == len(cases.rows()) and all(0 <= r["tail_probability"] <= 1.000001 for r in out)


def test_query_digests(spark, sf_dir, library):
    from planarix.llm import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op5_bpe(spark, sf_dir).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()

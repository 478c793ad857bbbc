"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarix.llm import bpe, exact_dedup, fingerprints, mixing, quality, sharding, simhash, substring_dedup, toxicity, url_filter


def tokenizer_path() -> str:
    """The vocabulary file's place on the driver; executors get its tables by broadcast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def held_out(ident: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out())
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("keep"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    base = exact_dedup.deduplicate(docs, keep="largest")
    return base.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _digests(text: str, ids, decoded: str) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path(), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests, keep=["doc_id"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents", "doc_id", "text"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edits(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# The rules of the registered query.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_quality, op3_exact_dedup, op4_substring_dedup, op5_bpe, op6_sharding, op7_fingerprints, op8_simhash, op9_mixing, op10_url_filter, pipeline]
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP3 = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as body from documents)
select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
  doc_id is not distinct from max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from t
"""

_OP4 = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
starts as (select r, unnest(range(1, greatest(0, len(words) - 34) + 1)) as s from d),
wins as (select d.r, s, sha256(array_to_string(words[s : s + 34], ' ')) as h from starts join d using (r)),
rep as (select r, s from (select r, s, count(*) over (partition by h) as n from wins) where n > 1),
gone as (select distinct r, unnest(range(s, s + 35)) as p from rep),
places as (select r, unnest(range(1, len(words) + 1)) as p, unnest(words) as word from d),
kept as (select p.r, string_agg(word, ' ' order by p.p) as body, count(*) as n from places p anti join gone g on p.r = g.r and p.p = g.p group by p.r)
select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from d left join kept using (r)
"""

_OP9 = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
r as (select *, 2.0::double * source_size as lim, 2.0::double * source_size / weight as ratio from w),
l as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(lim) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from r window before as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, min_by(level, ratio) filter (where level <= ratio) over () as final from l),
t as (select source, source_size, case when final is null then lim else least(lim, weight * final) end as target from f),
b as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
g as (select source, h, sum(size) as n from d group by source, h),
c as (
  select g.source, g.h, n, b.target - b.whole * b.source_size as extra, sum(n) over (partition by g.source order by g.h) - n as before
  from g join b on g.source is not distinct from b.source),
p as (select source, h, 2 * (extra - before) >= n as more from c)
select d.doc_id, d.size, b.source_size, b.target, d.size * (b.whole + case when p.more then 1 else 0 end) as taken
from d join b on d.source is not distinct from b.source join p on d.source is not distinct from p.source and d.h = p.h
"""

_OP10 = rf"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, row_number() over () as r
  from pages),
rules(h, p, v) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
hits as (
  select r, h || p as rule, v, row_number() over (partition by r order by length(h || p) desc) as n
  from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from u left join (select * from hits where n = 1) using (r)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op3_exact_dedup": _OP3, "op4_substring_dedup": _OP4, "op9_mixing": _OP9, "op10_url_filter": _OP10}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source that should give a fraction q of its tokens takes
each document floor(q) times and once more those whose hash lies below a threshold. The
threshold is found without sorting: tokens are summed by source and hash bucket, the bucket in
which the running sum passes the budget is refined by the next bits of the hash, and so on
until single hash values remain. Larger budgets only raise thresholds, so their mixes are
nested. Documents are then filtered by comparison with their source's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planarix import storage

# The words of a text, and hash width in bits refined by this many bits at a time.
WORD = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from one row a source: weighted shares of `share` times all sizes.

    Sources in code point order, null last, take the weights in turn. A target stops at `most`
    times its source; the excess goes to the others by weight until none is above. Closed form:
    with sources ordered by size per weight, the first k are full and the rest share what is
    left; k is the first at which the next one isn't full. One row a source, whatever the corpus.
    """
    line = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", turn[((F.row_number().over(line) - 1) % len(weights)).cast("int")])
    full = w.withColumn("full", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("full") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    step = full.select(
        "*",
        F.coalesce(F.sum("full").over(before), F.lit(0.0)).alias("spent"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
        F.sum("weight").over(everything).alias("all_weight"),
    ).withColumn("level", (F.col("budget") - F.col("spent")) / (F.col("all_weight") - F.col("gone")))
    # the first source that its level doesn't fill sets the level for all after it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return step.withColumn("final", level).select(
        "source", "source_size", F.when(F.col("final").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("weight") * F.col("final"))).alias("target")
    )


def _edge(rows: DataFrame, shift: int) -> DataFrame:
    """(key, extra, bucket, used): each source's first bucket in which the running sum passes `extra`.

    `rows` has key (a source), extra, used (tokens below the rows' range), hash and size.
    """
    hist = rows.groupBy("key", "extra", "used", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
    run = hist.withColumn("upto", F.col("used") + F.sum("n").over(Window.partitionBy("key").orderBy("bucket")))
    first = run.where("upto > extra").groupBy("key", "extra").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("used"))).alias("e"))
    return first.select("key", "extra", "e.bucket", "e.used")


def thresholds(slim: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row a source: source, source_size, target, whole (times every document is taken), below (hash threshold of one more).

    `slim` has source, size and hash. A document of the boundary is taken if that comes nearer to
    the target than leaving it.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = storage.materialise(goals.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    wanted = goals.select(F.col("source").alias("key"), "extra")

    def within(rows: DataFrame, edge: DataFrame, shift: int) -> DataFrame:
        edge = edge.select(F.col("key").alias("k"), F.col("extra"), F.col("used"), F.col("bucket"))
        return rows.join(edge, rows["key"].eqNullSafe(edge["k"]) & (F.shiftright(rows["hash"], shift) == edge["bucket"])).select("key", "extra", "used", "bucket", "hash", "size")

    # first level: partial sums leave each task with one row for each source and bucket
    hist = slim.groupBy(F.col("source").alias("key"), F.shiftright("hash", BITS - STEP).alias("hash")).agg(F.sum("size").alias("size"))
    w = wanted.withColumnRenamed("key", "k")
    one = _edge(hist.join(w, hist["key"].eqNullSafe(w["k"])).select("key", "extra", F.lit(0).cast("long").alias("used"), "hash", "size"), 0)
    rows = within(slim.select(F.col("source").alias("key"), "hash", "size"), one, BITS - STEP)
    two = _edge(rows, BITS - 2 * STEP)
    rows = within(rows.select("key", "hash", "size"), two, BITS - 2 * STEP)
    last = rows.groupBy("key", "extra", "used", "bucket", "hash").agg(F.sum("size").alias("n"))
    run = last.withColumn("before", F.col("used") + F.sum("n").over(Window.partitionBy("key").orderBy("hash")) - F.col("n"))
    cut = run.groupBy("key").agg(
        F.coalesce(F.min(F.when(2 * (F.col("extra") - F.col("before")) < F.col("n"), F.col("hash"))), F.shiftleft(F.min("bucket") + 1, BITS - 2 * STEP)).alias("below")
    )
    full = F.lit(1 << BITS)
    return goals.join(cut, goals["source"].eqNullSafe(cut["key"]), "left").select("source", "source_size", "target", "whole", F.coalesce("below", full).alias("below"))


def hash_of(ident: Column) -> Column:
    """60 uniform bits of an identifier: the first 15 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Append size, source_size, target and copies to every row; the mix takes `copies` times the row, at most `most` (an integer) times.

    Null texts have size 0; a null source is a source of its own. Rows with the same identifier
    share their hash and so their fate. With no words at all every target is 0. Columns of the
    four names are replaced.
    """
    base = docs.drop("size", "source_size", "target", "copies")
    ident, source, text = (F.col(c) for c in (id_col, source_col, text_col))
    slim = storage.materialise(base.select(ident.alias("id"), source.alias("source"), n_words(text).alias("size"), hash_of(ident).alias("hash")), "sizes")
    state = storage.materialise(thresholds(slim, weights, share, most), "thresholds")
    state = state.select(*[F.col(c).alias(f"__{c}") for c in state.columns])
    if set(base.columns) <= {id_col, text_col, source_col}:
        rows = slim.select(*[F.col({id_col: "id", source_col: "source"}[c]).alias(c) for c in base.columns if c != text_col], F.col("size").alias("__size"), F.col("hash").alias("__hash"))
    else:
        rows = base.select("*", n_words(text).alias("__size"), hash_of(ident).alias("__hash"))
    joined = rows.join(state, F.col(source_col).eqNullSafe(F.col("__source")))
    return joined.select(
        *[c for c in rows.columns if c not in ("__size", "__hash")], F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__whole") + (F.col("__hash") < F.col("__below")).cast("long")).alias("copies"),
    )

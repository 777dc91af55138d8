"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only.

Every row gets an exponential key -ln(u) / quality with u from its doc_id. A source whose target is t
words of its s takes floor(t / s) complete epochs, then its rows by rising key until the words left are
used up; the row at the border gives the words still wanted. The border is found from sums over key
buckets and then inside one bucket, so no source is ever sorted in one task.

Defined results: null or wordless texts have size 0 and give 0 words; null sources are one source, the
last; equal rows (same source, doc_id, size) at the border share its words evenly, rounded down; an
empty table gives an empty result. Sources are assumed to be names: their table fits one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import WORD_GAP, materialize, table

BUCKETS = 1024
MAX_REPEATS = 3
#: Characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>!"
SEED = "mix-1:"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1: the share of characters that are no symbols."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    bare = F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n == 0, 0.25).otherwise(0.25 + 0.75 * bare / n)


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """In (0, 1), the same for the same doc_id in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: the shares by weight, none above cap times its source.

    Water filling in closed form: by rising size / weight, sources are capped while the level that the
    others would reach lies above their own cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wheel = F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("w", F.get(wheel, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    everyone = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(everyone) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))).alias("left"),
        F.sum("w").over(after).alias("w_left"),
        F.row_number().over(fill).alias("k"),
    )
    fits = F.col("w") * F.col("left") <= cap * F.col("source_size") * F.col("w_left")
    first = F.min(F.when(fits, F.col("k"))).over(everyone)
    at = level.withColumn("first", first)
    share = F.struct(F.col("left"), F.col("w_left"))
    chosen = F.max(F.when(F.col("k") == F.col("first"), share)).over(everyone)
    return at.select("source", "source_size", "w", "k", "first", chosen.alias("at")).select(
        "source",
        "source_size",
        F.when(F.col("k") < F.col("first"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("w").cast("double") * F.col("at.left") / F.col("at.w_left")).alias("target"),
    )


def keyed(docs: DataFrame, text: Column | None = None, quality: Column | None = None) -> list[Column]:
    """Columns size, key and bucket of every row."""
    text = F.col("text") if text is None else text
    quality = quality_weight(text) if quality is None else quality
    key = -F.log(uniform(F.col("doc_id"))) / quality
    return [n_words(text).alias("size"), key.alias("key"), F.least(F.floor(BUCKETS * (1 - F.exp(-key))), F.lit(BUCKETS - 1)).cast("int").alias("bucket")]


def plan(sized: DataFrame) -> DataFrame:
    """One row a source: source_size, target, epochs and the border (bucket, key, doc_id, words each).

    sized: doc_id, source, size, key, bucket; read a few times, so it should be a written table.
    """
    goal = targets(sized)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target")) / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialize(goal.withColumn("extra", (F.round(F.col("target")) - F.col("epochs") * F.col("source_size")).cast("long")), "mix-goals")
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    cum = sums.withColumn("upto", F.sum("words").over(run))
    g = goal.alias("g")
    cut = cum.join(g, same(cum, goal)).where((F.col("upto") >= F.col("g.extra")) & (F.col("upto") - F.col("words") < F.col("g.extra")))
    cut = materialize(cut.select(cum["source"], cum["bucket"], (F.col("g.extra") - F.col("upto") + F.col("words")).alias("wanted")), "mix-cuts")
    inside = sized.join(cut.alias("c"), same(sized, cut) & (sized["bucket"] == cut["bucket"])).select(sized["source"], sized["bucket"], sized["key"], sized["doc_id"], sized["size"], F.col("c.wanted"))
    inside = inside.groupBy("source", "bucket", "key", "doc_id", "size", "wanted").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum(F.col("n") * F.col("size")).over(order))
    words = F.col("n") * F.col("size")
    border = inside.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - words < F.col("wanted")))
    border = border.select(
        "source",
        F.struct("bucket", "key", F.col("doc_id"), "size").alias("border"),
        F.floor((F.col("wanted") - F.col("upto") + words) / F.col("n")).cast("long").alias("each"),
    )
    return materialize(goal.join(border.alias("b"), goal["source"].eqNullSafe(border["source"]), "left").select(goal["source"].alias("m_source"), "source_size", "target", "epochs", "extra", "border", "each"), "mix-plan")


def taken() -> Column:
    """Words that the mix takes of a row with size, key, bucket, doc_id joined with its source's plan."""
    me = F.struct(F.col("bucket"), F.col("key"), F.col("doc_id"), F.col("size"))
    part = F.when(F.col("extra") <= 0, 0).when(me < F.col("border"), F.col("size")).when(me == F.col("border"), F.col("each")).otherwise(0)
    return (F.col("epochs") * F.col("size") + part).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs (doc_id, text, source)."""
    sized = materialize(docs.select("doc_id", "source", *keyed(docs)), "mix-sizes")
    p = plan(sized)
    return sized.join(p, sized["source"].eqNullSafe(p["m_source"])).select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def resample(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: each row as often as the mix takes it, to the nearest whole copy."""
    sized = materialize(docs.select("doc_id", "source", *keyed(docs)), "mix-sizes")
    p = plan(sized)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(whole, "doc_id", "source", *keyed(docs))
    rows = rows.join(p, rows["source"].eqNullSafe(p["m_source"]))
    copies = F.when(F.col("size") > 0, F.floor((2 * taken() + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    return rows.select("__row", copies.alias("__copies")).where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / (CASE WHEN length(coalesce(text, '')) = 0 THEN 0.25::DOUBLE ELSE 0.25::DOUBLE + 0.75::DOUBLE * length(translate(text, '#*$%&|<>!', '')) / length(text) END) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
f AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER b, 0) AS lft, sum(w) OVER a AS w_left, row_number() OVER o AS k FROM r
  WINDOW o AS (ORDER BY source_size / w, source NULLS LAST),
    b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS (SELECT min(k) AS first FROM f WHERE w * lft <= 3 * source_size * w_left),
t AS (SELECT f.source, f.source_size, CASE WHEN f.k < z.first THEN CAST(3 * f.source_size AS DOUBLE) ELSE CAST(f.w AS DOUBLE) * g.lft / g.w_left END AS target
  FROM f, z, f g WHERE g.k = z.first),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target) - e.epochs * e.source_size AS extra,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, extra - (upto - size))) AS BIGINT) AS taken FROM c
"""

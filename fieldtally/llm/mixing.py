"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a rate: how often its documents should come on average, so that its share of all characters
is its weight. A document's count is the inverse of the Poisson distribution with that mean at a number
drawn from a hash of the seed and the document; the document is exploded by its count, and the copies are
put in the order of another hash, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read_table, table

#: A rate above this is the sum of several independent draws, so that exp() does not vanish.
STEP = 8.0
#: Values of a draw; the chance of more at a mean of STEP is below the resolution of the draw.
VALUES = 64
#: Sources that are broadcast; beyond, rates are joined by a shuffle with salted keys.
SOURCES = 10_000
SALTS = 64


def drawn(seed: int, purpose: str, *keys: Column) -> Column:
    """A number in [0, 1) with 52 bits from an MD5 hash."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *keys)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """Distribution function of a Poisson variable at 0, 1, .., VALUES - 1 as an array."""
    begin = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(acc, k):
        p = acc["p"] * mean / k
        total = acc["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(VALUES - 1)), begin, step, lambda acc: acc["all"])


def rates(docs: DataFrame, source: str, text: str, weights: dict | None, epochs: float) -> DataFrame:
    """(source, draws, table): one row per source.

    ``weights`` gives a target weight by source (absent: 0); without it each source weighs the square root
    of its characters. All documents together come ``epochs`` times, counted in characters.
    """
    sizes = docs.groupBy(column(docs, source).alias("source")).agg(F.sum(F.coalesce(F.length(column(docs, text).cast("string")), F.lit(0))).alias("chars"))
    if weights is None:
        weight = F.sqrt("chars")
    elif not weights:
        weight = F.lit(0.0)
    else:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() if k is not None for x in (str(k), float(w))] or [F.lit(""), F.lit(0.0)])
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.coalesce(given[F.col("source").cast("string")], F.lit(0.0)))
    sizes = table(sizes.withColumn("weight", weight.cast("double")), "source-sizes")
    chars, total = sizes.agg(F.sum("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight")))).first()
    rate = F.when(F.col("chars") > 0, F.col("weight") / F.lit(total) * F.lit(float(epochs)) * F.lit(chars) / F.col("chars")).otherwise(0.0) if total else F.lit(0.0)
    draws = F.greatest(F.lit(1), F.ceil(rate / STEP).cast("int"))
    return sizes.select("source", rate.alias("rate"), draws.alias("draws"), poisson_table(rate / draws).alias("table"))


def mix(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: dict | None = None, epochs: float = 1.0, seed: int = 1
) -> DataFrame:
    """``docs`` replicated and shuffled, with ``copy`` (1, 2, ..) and ``place`` (its key in the global order).

    Rows that share id and text share their draw. A null source is a source of its own, a null id counts as
    empty text. Sources without characters, with weight 0 or not among ``weights`` are drawn at rate 0. An
    empty table stays empty. Existing columns named ``copy`` or ``place`` are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("copy", "place")]
    plain = docs.select(*[column(docs, c).alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    found = rates(docs, source, text, weights, epochs).withColumnsRenamed({"source": "s"})
    if found.limit(SOURCES + 1).count() <= SOURCES:
        joined = plain.join(F.broadcast(found), at[source].eqNullSafe(F.col("s")))
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = plain.withColumn("own", F.pmod(F.xxhash64(at[id]), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, at[source].eqNullSafe(F.col("s")) & (F.col("own") == F.col("salt")))
    key = F.concat_ws("|", F.coalesce(at[id].cast("string"), F.lit("")), F.md5(F.coalesce(at[text].cast("string"), F.lit(""))))
    joined = joined.withColumn("key", key)
    one = lambda i: F.size(F.filter(F.col("table"), lambda c: c <= drawn(seed, "count", F.col("key"), i.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda acc, i: acc + one(i))
    joined = joined.withColumn("count", count).where("count > 0")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    placed = copies.withColumn("place", drawn(seed, "place", F.col("key"), F.col("copy").cast("string")))
    out = placed.select(*[F.col(f"c{i}") for i in range(len(names))], "copy", "place")
    # Places are even over [0, 1), so that equal ranges need no sample of them, which would draw everything twice.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = out.repartitionById(parts, F.floor(F.col("place") * parts).cast("int"))
    return dealt.sortWithinPartitions("place", at[id], "copy").toDF(*names, "copy", "place")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(read_table(spark, folder, "documents"))


#: DuckDB: the same hashes, distribution functions and order keys.
OP5_SQL = """
WITH RECURSIVE sizes AS (
    SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM documents GROUP BY source),
totals AS (SELECT sum(chars) AS all_chars, sum(sqrt(chars)) FILTER (chars > 0) AS all_weight FROM sizes),
rates AS (SELECT source, CASE WHEN chars > 0 AND all_weight > 0 THEN sqrt(chars) / all_weight * 1.0 * all_chars / chars ELSE 0.0 END AS rate
    FROM sizes, totals),
means AS (SELECT source, greatest(1, CAST(ceil(rate / 8.0) AS INTEGER)) AS draws, rate / greatest(1, CAST(ceil(rate / 8.0) AS INTEGER)) AS mean FROM rates),
steps AS (
    SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS total FROM means
    UNION ALL SELECT source, draws, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM steps WHERE k < 63),
tables AS (SELECT source, draws, list(total ORDER BY k) AS cdf FROM steps GROUP BY source, draws),
keyed AS (SELECT *, concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, ''))) AS key FROM documents),
counted AS (
    SELECT d.*, list_sum(list_transform(range(1, draws + 1), lambda i:
        len(list_filter(cdf, lambda c: c <= CAST('0x' || substr(md5('1|count|' || key || '|' || i), 1, 13) AS BIGINT) / 4503599627370496.0)))) AS n
    FROM keyed d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS c FROM counted WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy,
    CAST('0x' || substr(md5('1|place|' || key || '|' || c), 1, 13) AS BIGINT) / 4503599627370496.0 AS place
FROM copies"""

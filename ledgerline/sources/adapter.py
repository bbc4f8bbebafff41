"""The claim graph of the driver's tables: documents are episodes, their lines are claims.

Keys are dense in the order of (doc_id, line); they are counted on a narrow frame of line counts by document, so no text moves for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cutoff(doc_id: Column) -> Column:
    return F.when(doc_id % 11 != 0, F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (doc_id % 700).cast("int")), "yyyy-MM-dd"))


def episodes(docs: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    spanned = d % 7 != 0
    return docs.select(
        F.concat(F.lit("doc-"), d.cast("string")).alias("id"),
        "text",
        F.struct(F.when(spanned, "span").otherwise("absent").alias("kind"), F.when(spanned, F.concat(F.lit("doc:"), d.cast("string"))).alias("value")).alias("locator"),
        F.col("source").alias("source_type"),
        cutoff(d).alias("data_cutoff"),
        (d % 4).cast("smallint").alias("authority_tier"),
        F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")).alias("tags"),
        "doc_id",
    )


def running_before(narrow: DataFrame, key: str, n: str) -> DataFrame:
    """narrow with `before`: the sum of n over smaller keys. Ranges of keys are summed apart, and their totals (a row a range) together.

    The number of ranges is given, so that no adaptive plan joins ranges differently for the totals and for the rows."""
    parts = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy("_part").agg(F.sum(n).alias("_sum"))
    ahead = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inner = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_inner", inner).join(ahead, "_part").withColumn("before", F.col("_ahead") + F.col("_inner")).drop("_part", "_inner", "_ahead")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lines): the lines that are not blank."""
    return docs.select("doc_id", F.filter(F.split("text", "\n"), lambda x: ~blank(x)).alias("lines"))


def first_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, before): the key of each document's first claim."""
    return running_before(lines(docs).select("doc_id", F.size("lines").alias("n")), "doc_id", "n").select("doc_id", "before")


def claims(docs: DataFrame) -> DataFrame:
    """(claim_key, doc_id, pos, text, status): a claim for every line that is not blank."""
    c = lines(docs).join(first_keys(docs).hint("merge"), "doc_id").select("doc_id", "before", F.posexplode("lines").alias("pos", "text"))
    key = (F.col("before") + F.col("pos")).cast("bigint")
    status = F.when(key % 10 == 0, "rejected").when((key % 10).between(1, 3), "active").otherwise("staged")
    return c.select(key.alias("claim_key"), "doc_id", "pos", "text", status.alias("status"))


def lineage(claims: DataFrame) -> DataFrame:
    """(seq, claim_key, episode_id, extractor_version): the own document, and for every 13th claim the next one, which may not exist."""
    k, d = F.col("claim_key"), F.col("doc_id")
    on = F.when(k % 13 == 0, F.array(d, d + 1)).otherwise(F.array(d))
    e = claims.select("claim_key", F.posexplode(on).alias("n", "doc"))
    return e.select((k * 2 + F.col("n")).alias("seq"), "claim_key", F.concat(F.lit("doc-"), F.col("doc").cast("string")).alias("episode_id"), F.when(k % 3 == 0, "v1").otherwise("v2").alias("extractor_version"))


def conversation_episodes(turns: DataFrame) -> DataFrame:
    """Turns of conversations as episodes conv-turn."""
    i = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select(i.alias("id"), "text", F.struct(F.lit("span").alias("kind"), F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("value")).alias("locator"), F.col("role").alias("source_type"), F.lit(None).cast("string").alias("data_cutoff"), F.lit(3).cast("smallint").alias("authority_tier"), F.array(F.concat(F.lit("role:"), "role")).alias("tags"))

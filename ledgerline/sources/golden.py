"""Golden corpora and run manifests of the evaluation: a JSON file each, checked as a whole before anything is scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from ..schema import HEDGES

CORPUS = "id string, version string, episodes array<struct<id:string,text:string,golden_claims:array<struct<text:string,source_count:bigint,evidence_span:string,hedges:array<string>>>>>"
RUN = "run_id string, extractor_version string, claims array<struct<episode_id:string,text:string,evidence_span:string>>"


@dataclass
class Corpus:
    """episodes (id, text) and golden (pos, episode_id, text, hedges), pos counting within the episode."""

    id: str
    version: str
    episodes: DataFrame
    golden: DataFrame


@dataclass
class Run:
    """candidates (pos, episode_id, text, span), pos counting over the run."""

    id: str
    version: str
    candidates: DataFrame


def _read(spark: SparkSession, path: str, kind: str, what: str) -> DataFrame:
    try:
        one = spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path)
        n = one.limit(2).count()
    except Exception as e:
        raise ValueError(f"invalid {what}: {str(e).splitlines()[0][:200]}") from None
    if n != 1:
        raise ValueError(f"invalid {what}: one JSON object is expected")
    return one


def _void(c: Column) -> Column:
    return F.coalesce(blank(c), F.lit(True))


def _refuse(rows: DataFrame, rules: list[tuple[str, Column]], what: str) -> None:
    """ValueError with the first rule that some row breaks."""
    first = rows.select(F.coalesce(*[F.when(bad, F.lit(say)) for say, bad in rules]).alias("say")).filter("say IS NOT NULL").first()
    if first:
        raise ValueError(f"invalid {what}: {first['say']}")


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    """A corpus needs an id, a version, distinct episodes, and golden claims with text, span, a source and known hedges."""
    one = _read(spark, path, CORPUS, "corpus")
    _refuse(one, [("corpus id must be non-empty", _void(F.col("id"))), ("corpus version must be non-empty", _void(F.col("version"))), ("episodes are missing", F.col("episodes").isNull())], "corpus")
    eps = one.select(F.explode("episodes").alias("e")).select("e.*")
    _refuse(eps, [("episode id must be non-empty", _void(F.col("id"))), ("episode text is missing", F.col("text").isNull())], "corpus")
    _refuse(eps.groupBy("id").agg(F.count("*").alias("n")), [("an episode id stands twice", F.col("n") > 1)], "corpus")
    gold = eps.select(F.col("id").alias("episode_id"), F.posexplode("golden_claims").alias("pos", "c")).select(F.col("pos").cast("bigint").alias("pos"), "episode_id", "c.*")
    gold = gold.withColumn("hedges", F.transform(F.coalesce("hedges", F.array().cast("array<string>")), F.lower))
    unknown = F.size(F.array_except("hedges", F.array(*map(F.lit, HEDGES)))) > 0
    rules = [(f"golden claim {c} must be non-empty", _void(F.col(c))) for c in ("text", "evidence_span")]
    _refuse(gold, [*rules, ("golden claim source_count must be 1 or more", F.coalesce(F.col("source_count") < 1, F.lit(True))), ("a hedge is outside the vocabulary", unknown)], "corpus")
    head = one.select("id", "version").first()
    return Corpus(head["id"], head["version"], eps.select("id", "text"), gold.select("pos", "episode_id", "text", "hedges"))


def read_run(spark: SparkSession, path: str) -> Run:
    """A run needs its id, its extractor's version, and candidates with episode, text and span."""
    one = _read(spark, path, RUN, "run")
    _refuse(one, [("run id must be non-empty", _void(F.col("run_id"))), ("extractor version must be non-empty", _void(F.col("extractor_version"))), ("claims are missing", F.col("claims").isNull())], "run")
    c = one.select(F.posexplode("claims").alias("pos", "c")).select(F.col("pos").cast("bigint").alias("pos"), "c.episode_id", "c.text", F.col("c.evidence_span").alias("span"))
    _refuse(c, [(f"candidate {x} must be non-empty", _void(F.col(x))) for x in ("episode_id", "text", "span")], "run")
    head = one.select("run_id", "extractor_version").first()
    return Run(head["run_id"], head["extractor_version"], c)

"""The queries p6_ to p10_ over the project's tables, and SQL for those that have any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.functions.text import source_key
from wayledger.llm.mixing import mix, plan_mix, shares
from wayledger.llm.offence import fitted, labelled_sample, offence_scores
from wayledger.llm.packing import fill_report, pack
from wayledger.llm.pii import personal_information
from wayledger.llm.tokens import token_count
from wayledger.llm.truncation import cut_rates, judged
from wayledger.session import table, use_checkpoints


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(table(spark, d, "fixmystreet"), "delivery_id", ["title", "description"])


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All reports with placeholders for what was found."""
    return personal_information(table(spark, d, "fixmystreet"), "delivery_id", ["title", "description"], redacted=True)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_count("text").alias("tokens"))


def _containers(spark: SparkSession, d: str) -> dict[str, int]:
    return {r[0]: int(r[1]) for r in table(spark, d, "pack_sizes").select("container", "capacity_tokens").collect()}  # a row a kind of container


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d), "doc_id", "tokens", _containers(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    containers = _containers(spark, d)
    return fill_report(pack(_sizes(spark, d), "doc_id", "tokens", containers), containers)


def _mix_docs(spark: SparkSession, d: str) -> DataFrame:
    """The sizes by source, kept in the shared checkpoint folder, as the plan and the draw both read them."""
    use_checkpoints(spark)
    docs = table(spark, d, "documents").select("doc_id", source_key("source").alias("source"), token_count("text").alias("tokens"))
    return docs.checkpoint()


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of as many tokens as the targets' sources have together: small sources reach their caps, and what they lack
    goes to the others."""
    docs = _mix_docs(spark, d)
    return mix(docs, plan_mix(docs, table(spark, d, "mix_targets"), "all"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of that mixture."""
    docs = _mix_docs(spark, d)
    plan = plan_mix(docs, table(spark, d, "mix_targets"), "all")
    return shares(mix(docs, plan), plan)


def p9_shares_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same for the largest mixture that meets all targets, in which no source is clamped."""
    docs = _mix_docs(spark, d)
    plan = plan_mix(docs, table(spark, d, "mix_targets"))
    return shares(mix(docs, plan), plan)


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    tables = (("fixmystreet", "delivery_id"), ("road_status", "row_id"))
    one, two = (table(spark, d, t).select(F.lit(t).alias("src"), F.col(k).alias("row_key"), "feed", F.col("description").alias("text")) for t, k in tables)
    return one.unionByName(two)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cut, _ = judged(_descriptions(spark, d))
    return cut.select(F.col("src").alias("src_table"), "row_key")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each feed cuts."""
    return cut_rates(*judged(_descriptions(spark, d)))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    docs = table(spark, d, "documents")
    return offence_scores(docs, fitted(labelled_sample(docs, table(spark, d, "review_labels"))))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("score > 0").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, offensive ones and their share for each source."""
    scored = p10_scores(spark, d).join(table(spark, d, "documents").select("doc_id", source_key("source").alias("source")), "doc_id")
    out = scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") > 0).alias("offensive"))
    return out.withColumn("rate", F.col("offensive") / F.col("documents"))


QUERIES = {f.__name__: f for f in (p6_found, p6_rates, p7_found, p7_redacted, p8_packed, p8_fill, p9_mix, p9_shares, p9_shares_exact, p10_found, p10_scores, p10_rates)}
SQL: dict[str, str] = {}

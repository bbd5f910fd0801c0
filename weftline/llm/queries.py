"""Registered queries of the operators in this package: one folder of tables in, one frame out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import calls, language, mixing, near_copies, packing, page_tree, residue, site_lines
from weftline.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "documents"), table(spark, d, "urls"), table(spark, d, "blocks"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    documents, blocks = table(spark, d, "documents"), table(spark, d, "blocks")
    return site_lines.without_lines(documents, blocks, site_lines.repeated_lines(documents, table(spark, d, "urls"), blocks))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_tree.page_furniture(table(spark, d, "documents"), table(spark, d, "blocks")).select("doc_id", "position")


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    return page_tree.page_bodies(table(spark, d, "documents"), table(spark, d, "blocks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = calls.defective_calls(table(spark, d, "calls"), table(spark, d, "documents"), table(spark, d, "langs"))
    return found.select("request_key", "defect")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.all_pairs(*near_copies.near_copies(table(spark, d, "documents"), table(spark, d, "blocks")))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives; with ``p4_members`` they are the whole answer without expanding copies into pairs."""
    pairs, _ = near_copies.near_copies(table(spark, d, "documents"), table(spark, d, "blocks"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), F.round("similarity", 6).alias("similarity"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of equal articles of every document that takes part, by its least id."""
    _, members = near_copies.near_copies(table(spark, d, "documents"), table(spark, d, "blocks"))
    return members


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.groups(*near_copies.near_copies(table(spark, d, "documents"), table(spark, d, "blocks")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"), table(spark, d, "blocks")).select("doc_id", "position")


def p5_templates(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_templates(residue.residue(table(spark, d, "documents"), table(spark, d, "blocks")))


def p5_by_status(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return residue.residue_by_status(documents, table(spark, d, "fetch_route_events"), residue.residue(documents, table(spark, d, "blocks")))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity: texts that were placed, containers above it, and texts whose pieces leave a gap or overlap."""
    item = F.explode("items").alias("item")
    packed = p6_containers(spark, d)
    over = packed.groupBy("spec_id").agg(F.count_if(F.col("used_tokens") > F.col("capacity_tokens")).alias("over"), F.count_if(F.col("used_tokens") != F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["tokens"])).alias("wrong_sums"))
    pieces = packed.select("spec_id", item).groupBy("spec_id", "item.doc_id").agg(F.sum("item.tokens").alias("n"), F.max(F.col("item.start_token") + F.col("item.tokens")).alias("end"), F.count(F.lit(1)).alias("pieces"), (F.max("item.piece") + 1).alias("named"))
    texts = pieces.groupBy("spec_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n") != F.col("end")) | (F.col("pieces") != F.col("named"))).alias("broken"))
    return over.join(texts, "spec_id")


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each target that has texts: whether no text is used too often, and the share lies within a fiftieth of what the weights ask."""
    got = p7_shares(spark, d).where("n_tokens > 0")
    goal = got.agg(F.sum("target_share").alias("all"))  # one row
    return got.crossJoin(goal).select("source_id", (F.col("most_repeats") <= F.col("max_repeats")).alias("kept"), (F.abs(F.col("actual_share") - F.col("target_share") / F.col("all")) < 0.02).alias("near"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_languages(table(spark, d, "documents"), table(spark, d, "langs"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"), table(spark, d, "langs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p2_found": p2_found,
    "p2_bodies": p2_bodies,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p4_members": p4_members,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_templates": p5_templates,
    "p5_by_status": p5_by_status,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_invariants": p6_invariants,
    "p7_mixture": p7_mixture,
    "p7_invariants": p7_invariants,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
}

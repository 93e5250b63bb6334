"""The corpus queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.llm import ann, chat, decontaminate, grading, hardneg, jaccard_join, language, line_dedup, merkle, mixing, repeats, urlfilter, warc
from gaugework.llm.store import table


def op5_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op8_warc_bundles(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("archive", "frame", "frame_offset")


def op9_suffix_repeats(spark, sf_dir):
    return repeats.repeats_digest(table(spark, sf_dir, "documents"))


def op1_additive_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark, sf_dir):
    return language.language_digest(table(spark, sf_dir, "documents"))


def op4_chat_format(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_quality_grade(spark, sf_dir):
    return grading.grades_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest_digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), lambda vec_id: vec_id % 100 == 0)


def op13_url_filters(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_additive_ann": op1_additive_ann,
    "op2_mix_sources": op2_mix_sources,
    "op3_language_id": op3_language_id,
    "op4_chat_format": op4_chat_format,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_grade": op6_quality_grade,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc_bundles": op8_warc_bundles,
    "op9_suffix_repeats": op9_suffix_repeats,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filters": op13_url_filters,
}
ORACLES = {
    "op1_additive_ann": ann.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op8_warc_bundles": warc.ORACLE,
    "op9_suffix_repeats": repeats.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_hard_negatives": hardneg.ORACLE,
    "op13_url_filters": urlfilter.ORACLE,
}

"""Queries of the corpus operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.llm import chat, decontaminate, edits, html_main, packing, quality, reshard, simhash, topk, toxicity
from wayfold.session import table


def op1_quality_fm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_reshard_flow(spark, sf_dir):
    return reshard.reshard(table(spark, sf_dir, "documents"), reshard.by_source(20), 20, 16)


def op3_token_edits(spark, sf_dir):
    return edits.recount(table(spark, sf_dir, "documents"), edits.sample_edits())


def op4_html_tree(spark, sf_dir):
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op5_simhash_anchors(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate_prefix(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing_tiers(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_chat_template(spark, sf_dir):
    return chat.digests(chat.format_with_probe(table(spark, sf_dir, "conversations")))


def op9_toxicity_ordinal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_topk_blocks(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = (op1_quality_fm, op2_reshard_flow, op3_token_edits, op4_html_tree, op5_simhash_anchors, op6_decontaminate_prefix, op7_packing_tiers, op8_chat_template, op9_toxicity_ordinal, op10_topk_blocks)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """None: hashed features, fingerprints, tokenizers, templates and page trees have no SQL form."""
    return {}

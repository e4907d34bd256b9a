"""The registered queries ``opN_<name>`` over whole tables, and their oracle SQL."""

from __future__ import annotations

from tidemill.llm import ann, chat, conversation_repair, infill, jaccard, mixing, packing, pii, quality, secrets, sharding, suffix_dedup, topk
from tidemill.llm.common import table


def op1_sampled_splitters(spark, sf_dir):
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op2_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


def op3_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark, sf_dir):
    return topk.topk(table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark, sf_dir):
    digest, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return digest.select("doc_id", "size", "source_size", "target", "taken", "draws")


def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


def op10_nearest_by_curves(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark, sf_dir):
    return infill.digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_chat_format(spark, sf_dir):
    return chat.digests(chat.format_chats(chat.with_hostile_conversation(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_sampled_splitters, op2_personal_data, op3_suffix_array_dedup, op4_exact_top_k, op5_quality_classifier, op6_secret_scan, op7_best_fit_packing, op8_source_mixing, op9_ngram_jaccard_join, op10_nearest_by_curves, op11_fill_in_middle, op12_conversation_repair, op13_chat_format)}
ORACLE_SQL: dict[str, str] = {"op4_exact_top_k": topk.ORACLE, "op9_ngram_jaccard_join": jaccard.ORACLE, "op11_fill_in_middle": infill.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE, "op13_chat_format": chat.ORACLE}

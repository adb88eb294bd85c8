"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from spanforge.llm import chat, classifier, decontaminate, licenses, neardup, packing, pii, quality, ransfile, substrings
from spanforge.llm.common import table


def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 2048)


def op2_token_ids(spark, sf_dir):
    return ransfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op3_near_duplicates(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark, sf_dir):
    return licenses.digests(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark, sf_dir):
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_repeated_substrings(spark, sf_dir):
    return substrings.removed(table(spark, sf_dir, "documents"))


PLANTED_TURNS = "select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"


def op9_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(turns.unionByName(spark.sql(PLANTED_TURNS)))


def op10_pii(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents"))


OP9_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m as (
  select *, row_number() over w as k,
         lag(role) over w as before,
         length(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'))
           + length(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2')) + 23 as chars
  from t window w as (partition by conv_id order by turn nulls first, role, text)
), g as (
  select conv_id, count(*) as n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
         coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
         sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
         sum(chars)::bigint as formatted_chars,
         coalesce(min(k) filter (where not coalesce(
           (role = 'system' and before is null)
           or (role = 'user' and (before is null or before in ('system', 'assistant')))
           or (role = 'assistant' and before = 'user'), false)), 0) as broken
  from m group by conv_id
)
select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
       broken = 0 as valid, (broken - 1)::bigint as first_broken_turn
from g
"""


def queries():
    return {
        "op1_packing": op1_packing,
        "op2_token_ids": op2_token_ids,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_quality_rules": op4_quality_rules,
        "op5_license_scan": op5_license_scan,
        "op6_decontamination": op6_decontamination,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_repeated_substrings": op8_repeated_substrings,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_pii": op10_pii,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op4_quality_rules": quality.oracle(), "op9_chat_formatting": OP9_SQL}

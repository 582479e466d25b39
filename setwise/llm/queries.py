"""The queries of this folder's operators: ``(spark, sf_dir) -> DataFrame``, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, language_id, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~held_out(F.col("doc_id")))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.margin", "language.rejected")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs).select("doc_id", "lines.*")


OP2_SQL = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
), trimmed as (
  select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as t from lines
), shared as (
  select t from trimmed where t <> '' group by t having count(distinct source) >= 10
), marked as (
  select m.*, m.t in (select t from shared) as is_shared from trimmed m
), counted as (
  select doc_id, count(*) filter (t <> '') as n_lines, count(*) filter (is_shared) as n_shared,
    coalesce(string_agg(line, chr(10) order by pos) filter (not is_shared), '') as clean
  from marked group by doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_shared, 0) as n_shared,
  coalesce(n_lines > 0 and n_shared = n_lines, false) as none_own, case when n_shared > 0 then clean else d.text end as text
from documents d left join counted c on d.doc_id = c.doc_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id is not distinct from max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_coverage(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    out = quality_classifier.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


#: Both of its texts spell control strings.
PROBE_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.createDataFrame(PROBE_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    done = chat.format_chats(rows.unionByName(probe))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = """
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped as (
  select *,
    length(regexp_replace(replace(role, chr(92), chr(92) || chr(92)), '<[|]im_start[|]>|<[|]im_end[|]>|<[|]endoftext[|]>|<s>|</s>|[[]INST[]]|[[]/INST[]]|<<SYS>>|<</SYS>>', chr(92) || '0.', 'g')) as role_chars,
    length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '<[|]im_start[|]>|<[|]im_end[|]>|<[|]endoftext[|]>|<s>|</s>|[[]INST[]]|[[]/INST[]]|<<SYS>>|<</SYS>>', chr(92) || '0.', 'g')) as text_chars
  from rows_
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(12 + role_chars + 1 + text_chars + 11)::bigint as formatted_chars
from escaped group by conv_id
"""


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op2_line_dedup": op2_line_dedup,
    "op1_language_id": op1_language_id,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_bpe_codec": op10_bpe_codec,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op9_chat_formatting": OP9_SQL,
}

"""The operators over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import chat, decontam, licenses, lmscore, neardup, packing, quality, records, sharding, viterbi
from strandlog.llm.shared import table, written


def vocabulary_file(name: str) -> str:
    """The place of a public tokenizer's file; STRANDLOG_TOKENIZERS names another folder."""
    import os

    if folder := os.environ.get("STRANDLOG_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {"messages": [{"role": r, "content": CONTROL_TEXT} for r in ("user", "assistant")]}
    records = chat.records_of_rows(table(spark, sf_dir, "conversations")).union(spark.createDataFrame([("-1", json.dumps(extra))], "id string, record string"))
    return chat.digests(chat.formatted(chat.conversations(records)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_documents(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# ---- stages of the pipeline ----------------------------------------------------------------------------------
# Each takes the columns of documents, in any number, and all but the last return them as they were. Null and empty texts
# fail the quality rules; rows without an id are no near duplicates of anything and stay; of rows of one id that are all
# kept as that group's least, one stays; an empty table gives an empty one. tests/llm/test_pipeline.py holds them.


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least id stays; of its repeated rows, one."""
    found = neardup.near_duplicates(docs)
    gone = written(found.where("NOT kept").select("doc_id").distinct(), "gone")
    rows = docs.join(neardup.checked_broadcast(gone), "doc_id", "left_anti")
    again = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = neardup.checked_broadcast(written(again, "again"))
    return rows.join(again, "doc_id", "left_anti").unionByName(rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_file("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_token_counts, op3_virtual_slots, op4_decontaminate, op5_license_scan, op6_quality_rules, op7_cross_entropy, op8_near_duplicates, op9_best_fit, op10_binary_records, pipeline)}

_TAILS = r"INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|TURN\]|/TURN\]"
_ESCAPED = rf"length(regexp_replace(%s, '([\[<])(\\*)({_TAILS})', '\1\2\\\3', 'g'))"
_ORDER = "ORDER BY turn, role, text"
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' {_ORDER})) AS turns_sha256,
      coalesce(sum(CASE WHEN role='assistant' THEN length(text) END),0)::BIGINT AS loss_chars,
      sha256(string_agg(CASE WHEN role='assistant' THEN text ELSE '' END, '' {_ORDER})) AS loss_sha256,
      sum({_ESCAPED % 'text'} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 31 + {_ESCAPED % 'role'} END)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id""",
    "op8_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<4 THEN [array_to_string(w,' ')] ELSE list_distinct(list_transform(range(1,len(w)-2), lambda i: array_to_string(w[i:i+3],' '))) END AS g FROM w),
    s AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
    l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x=b.x AND a.doc_id<>b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100*count(*) >= 80*(a.n+b.n-count(*))),
    r(a,b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b=l.a)
    SELECT g.doc_id, len(g.g) AS n_shingles, m.c AS component_id, g.doc_id=m.c AS kept FROM g JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a=g.doc_id""",
}

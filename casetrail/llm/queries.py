"""One query per operator of this package over the given tables, and the SQL twins where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casetrail.llm import (alignment, class_lm, decontaminate, embedding_lsh, exact_dedup, langid, packing, pii, quality, simhash, url_filter,
                           warc, whitening)
from casetrail.llm.url_filter import ALLOW, BLOCK, Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [Rule("com", "/", ALLOW), Rule("example.com", "/en/", BLOCK), Rule("www.example.com", "/en/", ALLOW),
         Rule("net", "/es/", BLOCK), Rule("net", "/fr/", BLOCK)]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


# pages of the given tables declare no links, and the tidied form of an url has the rule of the url, so what no rule
# decides is allowed; aliases are tested in tests/llm
OP1_SQL = """
with rules(host, path, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts as (
  select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']),
                           {'host': '', 'path': ''}) as part from pages),
split as (
  select row_number() over () as r, page_id, coalesce(part.path, '') as path,
         translate(coalesce(part.host, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from parts)
select any_value(s.page_id) as page_id, any_value(s.host) as host, any_value(s.path) as path,
       arg_max(r.host || r.path, length(r.host || r.path)) as rule,
       coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') as verdict
from split s left join rules r on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path)
group by s.r"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with payloads as (select page_id, coalesce(html, '') as body from pages),
last as (select *, strlen(body) as size, max(page_id) over (partition by body) as last_id from payloads)
select page_id, size as payload_bytes, sha1(body) as payload_digest,
       case when size >= 1000 and page_id <> last_id then 'revisit' else 'response' end as record_type,
       case when size >= 1000 and page_id <> last_id then last_id end as refers_to from last"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
with texts as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = min(doc_id) over same as kept, sha256(body) as text_sha256
from texts window same as (partition by body)"""


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("file", "pos")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scores(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "copies")


def op11_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_class_lm": op8_class_lm,
    "op9_language_id": op9_language_id,
    "op10_simhash": op10_simhash,
    "op11_embedding_lsh": op11_embedding_lsh,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op5_warc": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
}

"""The registered queries of this subpackage, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scoring, toxicity
from .common import documents
from .language import identify
from .licenses import scan
from .lines import clean_lines
from .packing import pack
from .quality import quality
from .setjoin import jaccard_components
from .sharding import shard
from .tiling import contaminations


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n; of a null id 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(0))


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir), id_remainder(5) == 1)


def op4_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("detections")


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


def op6_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), id_remainder(5) == 0)


def op7_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 24)


def op8_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir)).select("doc_id", "lines_found", "lines_removed", "text")


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), id_remainder(4) == 2).drop("shares")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_outliers": op1_quality_outliers,
    "op2_string_tiling": op2_string_tiling,
    "op3_partial_matching": op3_partial_matching,
    "op4_signature_rules": op4_signature_rules,
    "op5_vector_packing": op5_vector_packing,
    "op6_factorization_machine": op6_factorization_machine,
    "op7_kd_tree": op7_kd_tree,
    "op8_site_spread": op8_site_spread,
    "op9_language_mixture": op9_language_mixture,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

ORACLE: dict[str, str] = {
    "op8_site_spread": r"""
with b as (
  select list(k) as ks from (
    select trim(l, e' \t\r\x0b\f') as k, count(distinct coalesce(source, '')) as n
    from (select unnest(string_split(text, chr(10))) as l, source from documents) group by 1)
  where n >= 10 and k <> ''),
c as (
  select doc_id, text, string_split(text, chr(10)) as a,
    list_filter(string_split(text, chr(10)), lambda x: not coalesce(list_contains(ks, trim(x, e' \t\r\x0b\f')), false)) as f
  from documents, b)
select doc_id, coalesce(len(a), 0) as lines_found,
  case when len(list_filter(f, lambda x: trim(x, e' \t\r\x0b\f') <> '')) > 0 then len(a) - len(f) else 0 end as lines_removed,
  case when len(list_filter(f, lambda x: trim(x, e' \t\r\x0b\f') <> '')) > 0 then array_to_string(f, chr(10)) else text end as text
from c""",
    "op10_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, (select min(b) from reach where reach.a = w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id""",
}

"""Derived tables, the same text for both engines but for names of types and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.queries.registry import table

_SPARK = {"S": "string", "D": "date_format(l_shipdate,'dd/MM/yyyy')"}
_DUCK = {"S": "varchar", "D": "strftime(l_shipdate,'%d/%m/%Y')"}

_DIRTY = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
  case when (l_partkey*7+l_linenumber) % 20 = 0 then 'Unknown'
       when (l_partkey*7+l_linenumber) % 20 = 1 then 'N/A'
       when (l_partkey*7+l_linenumber) % 20 = 2 then ' 12 pcs '
       else concat('$', cast(cast(l_quantity as int) as {S}), ',000') end as qty_txt,
  case when l_partkey % 11 = 0 then null else l_extendedprice end as price_null,
  case when l_partkey % 17 = 0 then null
       when l_suppkey % 2 = 0 then l_returnflag else upper(l_linestatus) end as flag_null,
  {D} as ship_txt
from lineitem"""

_SKEWED = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity, l_discount, l_returnflag,
  l_extendedprice * l_quantity as gross,
  case when l_partkey % 13 = 0 then null else l_extendedprice * l_extendedprice * l_quantity end as steep
from lineitem"""

_CANDIDATES = """
select concat(source, '/', cast(doc_id % 700 as {S}), case when doc_id % 31 = 0 then '-security' else '' end) as source_id,
  concat('https://data.example.org/', source, '/', cast(doc_id as {S})) as url,
  concat(lang, '-', cast(n_chars % 101 as {S})) as search,
  cast(doc_id % 4 as int) as variant,
  case doc_id % 3 when 0 then 'huggingface' when 1 then 'kaggle' else 'web_scrape' end as source_type,
  (doc_id % 3) < 2 as is_downloadable,
  cast(n_chars as double) / 1024 as size_mb,
  case doc_id % 8 when 0 then 'csv' when 1 then 'parquet' when 2 then 'jsonl' when 3 then 'xlsx'
       when 4 then 'zip' when 5 then 'unknown' when 6 then null else 'h5' end as file_extension,
  case doc_id % 5 when 0 then 'MIT' when 1 then 'CC-BY-NC-4.0' when 2 then 'UNKNOWN'
       when 3 then null else 'unknown' end as license,
  n_chars as downloads, doc_id % 17 as likes, doc_id % 5 as votes,
  doc_id as arrival
from documents"""

DIRTY_SQL = _DIRTY.format(**_DUCK)
SKEWED_SQL = _SKEWED.format(**_DUCK)
CANDIDATES_SQL = _CANDIDATES.format(**_DUCK)

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _derive(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql.format(**_SPARK).replace(f"from {source}", "from {source}"), source=table(spark, sf_dir, source))


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with currency text, null tokens, nulls and European dates."""
    return _derive(spark, sf_dir, _DIRTY, "lineitem")


def skewed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with products that have outliers."""
    return _derive(spark, sf_dir, _SKEWED, "lineitem")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset candidates made from documents: many searches with few results each, and repeated ids."""
    return _derive(spark, sf_dir, _CANDIDATES, "documents")

"""Catalogue search and ranking queries on candidates derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.operators import catalog as g
from millrace.operators import web
from millrace.queries.registry import query, table
from millrace.queries.views import CANDIDATES_SQL, candidates

_WITH = f"with c as ({CANDIDATES_SQL}) "
ORDER = ["arrival"]
BY = ["search"]
LIMIT = 3


def _sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_LICENSE = "case when license is null or license in ('', 'UNKNOWN') then 0.0 else 1.0 end"
_METADATA = "(case when size_mb > 0 then 0.25 else 0 end + case when coalesce(file_extension, '') <> 'unknown' then 0.25 else 0 end)"
_FORMAT = "case " + " ".join(
    f"when lower(file_extension) in {_sql_in(x)} then {s}" for s, x in fixed.FORMAT_SCORES
) + " else 0.0 end"
_TOTAL = (
    f"round(0.4*({_LICENSE}) + case when is_downloadable then 0.3 else 0 end + 0.2*({_METADATA}) + 0.1*({_FORMAT}), 2)::double"
)
_CLEAN = " and ".join(f"not contains(lower(source_id), '{w}')" for w in fixed.ID_BLACKLIST)


@query(
    "candidates_normalize",
    "select 'https://huggingface.co/datasets/' || source || '/' || doc_id as url, source || '/' || doc_id as source_id,"
    " 'huggingface' as source_type, true as is_downloadable, n_chars / 1048576.0::double as size_mb,"
    " 'parquet' as file_extension, n_chars as downloads, 0.0::double as compliance_score from documents"
    " union all select 'https://www.kaggle.com/datasets/' || lang || '/' || doc_id, lang || '/' || doc_id, 'kaggle', true,"
    " n_chars / 1048576.0::double, 'csv', 0, 0.0 from documents"
    " union all select url, 'page ' || page_id, 'web_scrape', false, 0, 'unknown', 0, 0.2 from pages",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    first = docs.select(
        F.concat_ws("/", "source", "doc_id").alias("id"), F.col("n_chars").alias("size_bytes"),
        F.col("n_chars").alias("downloads"),
    )
    second = docs.select(F.concat_ws("/", "lang", "doc_id").alias("id"), F.col("n_chars").alias("size_bytes"))
    pages = table(spark, sf, "pages").select(
        "url", F.concat(F.lit("page "), F.col("page_id")).alias("title"), F.lit("").alias("snippet")
    )
    parts = [
        g.normalize_candidates(first, "huggingface"), g.normalize_candidates(second, "kaggle"),
        g.normalize_candidates(pages, "web_scrape"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "url", "source_id", "source_type", "is_downloadable", "size_mb", "file_extension", "downloads", "compliance_score"
    )


def _waterfall(by: str, source: str = "c") -> str:
    return (
        f"(select r.* from (select *, row_number() over (partition by {by}, source_type order by arrival) as rn from {source}) r"
        f" join (select {by}, least(count(*) filter (where source_type = 'huggingface'), {LIMIT}) as a,"
        f" least(count(*) filter (where source_type = 'kaggle'), {LIMIT}) as b from {source} group by all) n using ({by})"
        f" where (source_type = 'huggingface' and rn <= {LIMIT}) or (source_type = 'kaggle' and rn <= {LIMIT} and a < {LIMIT})"
        f" or (source_type = 'web_scrape' and a + case when a < {LIMIT} then b else 0 end < 3))"
    )


@query("candidates_waterfall", _WITH + f"select search, source_type, source_id, arrival from {_waterfall('search')}")
def _(spark, sf):
    return g.waterfall(candidates(spark, sf), LIMIT, BY, ORDER).select("search", "source_type", "source_id", "arrival")


def _accumulate(source: str) -> str:
    return (
        f"(select c.* from {source} c join (select search, variant, coalesce(sum(count(*)) over (partition by search"
        " order by variant rows between unbounded preceding and 1 preceding), 0) as before"
        f" from {source} group by 1, 2) n using (search, variant) where before < {2 * LIMIT})"
    )


@query("candidates_accumulate", _WITH + f"select search, variant, source_id, arrival from {_accumulate('c')}")
def _(spark, sf):
    return g.accumulate(candidates(spark, sf), LIMIT, BY, ORDER).select("search", "variant", "source_id", "arrival")


@query(
    "candidates_dedup",
    _WITH + "select source_id, arrival, url from c qualify row_number() over (partition by source_id order by arrival) = 1",
)
def _(spark, sf):
    return g.dedup(candidates(spark, sf), ORDER, []).select("source_id", "arrival", "url")


@query("candidates_blacklist", _WITH + f"select source_id, arrival from c where {_CLEAN}")
def _(spark, sf):
    return g.drop_blacklisted(candidates(spark, sf)).select("source_id", "arrival")


@query("candidates_topk", _WITH + f"select source_id, arrival, {_TOTAL} as compliance_score from c order by 3 desc, 2 limit 25")
def _(spark, sf):
    scored = g.compliance_score(candidates(spark, sf))
    return g.top_candidates(scored, 25, ORDER).select("source_id", "arrival", "compliance_score")


_SEARCHED = (
    f", w as {_waterfall('search, variant')}, m as {_accumulate('w')}, u as (select * from m qualify"
    " row_number() over (partition by search, source_id order by variant, arrival) = 1), s as (select *,"
    f" {_TOTAL} as compliance_score from u where {_CLEAN}) select search, source_id, arrival, compliance_score from s"
    f" qualify row_number() over (partition by search order by compliance_score desc, variant, arrival) <= {LIMIT}"
)


@query("intelligent_search", _WITH.rstrip() + _SEARCHED.replace("r.*", "r.* exclude (rn)"))
def _(spark, sf):
    found = g.intelligent_search(candidates(spark, sf), LIMIT, BY, ORDER)
    return found.select("search", "source_id", "arrival", "compliance_score")


@query("compliance_score", _WITH + f"select arrival, {_TOTAL} as compliance_score from c")
def _(spark, sf):
    return g.compliance_score(candidates(spark, sf)).select("arrival", "compliance_score")


_STRICT = (
    "case when coalesce(nullif(page_license, ''), license) is null or upper(coalesce(nullif(page_license, ''), license))"
    " = 'UNKNOWN' then 0.0 when coalesce(nullif(page_license, ''), license) in "
    + _sql_in([x[0] for x in fixed.LICENSES if x[3]]) + " then 1.0 else 0.5 end"
)


@query(
    "score_license",
    _WITH + ", p as (select *, case when arrival % 4 = 0 then 'Apache-2.0' when arrival % 4 = 1 then '' end as page_license"
    " from c) select arrival, (case when coalesce(nullif(page_license, ''), license) is null or"
    " coalesce(nullif(page_license, ''), license) = 'UNKNOWN' then 0.0 else 1.0 end)::double as score,"
    f" ({_STRICT})::double as strict_score from p",
)
def _(spark, sf):
    paged = candidates(spark, sf).withColumn(
        "page_license", F.when(F.col("arrival") % 4 == 0, "Apache-2.0").when(F.col("arrival") % 4 == 1, "")
    )
    return paged.select(
        "arrival", g.score_license(paged).alias("score"), g.score_license(paged, strict=True).alias("strict_score")
    )


@query(
    "score_metadata",
    _WITH + f"select arrival, ({_METADATA} + 0.25 + case when arrival % 2 = 0 then 0.25 else 0 end)::double as score from c",
)
def _(spark, sf):
    paged = candidates(spark, sf).withColumns(
        {
            "dataset_name": F.col("source_id"),
            "page_description": F.when(F.col("arrival") % 2 == 0, F.concat(F.lit("about "), F.col("source_id"))).otherwise(""),
        }
    )
    return paged.select("arrival", g.score_metadata(paged).alias("score"))


@query("score_format", _WITH + f"select arrival, ({_FORMAT})::double as score from c")
def _(spark, sf):
    found = candidates(spark, sf)
    return found.select("arrival", g.score_format(found).alias("score"))


@query(
    "score_breakdown",
    _WITH + f"select arrival, {_TOTAL} as total_score, round(0.4*({_LICENSE}), 2)::double as license_part,"
    " (case when is_downloadable then 0.3 else 0 end)::double as downloadable,"
    f" round(0.2*({_METADATA}), 2)::double as metadata_part, round(0.1*({_FORMAT}), 2)::double as format_part,"
    f" ({_LICENSE})::double as raw_license, ({_METADATA})::double as raw_metadata, ({_FORMAT})::double as raw_format from c",
)
def _(spark, sf):
    return g.score_breakdown(candidates(spark, sf)).select(
        "arrival", "total_score", "license_part", "downloadable", "metadata_part", "format_part", "raw_license",
        "raw_metadata", "raw_format",
    )


_RANK = "case when href like '%.parquet' then 0 when href like '%.csv' then 1 when href like '%.json' then 2" \
    " when href like '%.jsonl' then 3 when href like '%.zip' then 4 else 5 end"
_ENDINGS = [".csv", ".jsonl", "", ".parquet", ".zip", ".json"]


@query(
    "rank_links",
    "with a as (select page_id, url, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),"
    " '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1) as h from pages),"
    " b as (select page_id, url, unnest(h) as raw, generate_subscripts(h, 1) - 1 as pos from a),"
    " l as (select page_id, url, pos, raw || (case (pos + page_id) % 6 "
    + " ".join(f"when {i} then '{e}'" for i, e in enumerate(_ENDINGS)) + " end) as href from b),"
    " d as (select * from l qualify " + _RANK + " < 5 or row_number() over (partition by page_id, href order by pos) = 1),"
    f" r as (select *, row_number() over (partition by page_id order by {_RANK}, pos) - 1 as choice from d)"
    " select page_id, choice::int as choice, case when href like '/%' then regexp_extract(url, '^([a-z]+)', 1) || '://' ||"
    " regexp_extract(url, '//([^/?#]*)', 1) || href else href end as download_url from r where choice < 3",
)
def _(spark, sf):
    from millrace.functions import html as h

    pages = table(spark, sf, "pages")
    endings = F.array(*[F.lit(e) for e in _ENDINGS])
    found = F.transform(
        h.links(F.col("html")),
        lambda l, i: F.struct(
            F.concat(l["href"], F.get(endings, ((i + F.col("page_id")) % len(_ENDINGS)).cast("int"))).alias("href")
        ),
    )
    return web.rank_links(pages.select("page_id", "url", found.alias("links"))).select("page_id", "choice", "download_url")


@query(
    "candidates_popularity",
    _WITH + ", p as (select 'https://data.example.org/' || source_type || '/' || likes as url, arrival, downloads + votes + likes as popularity"
    " from c) select * from p qualify row_number() over (partition by url order by popularity desc, arrival) = 1",
)
def _(spark, sf):
    found = candidates(spark, sf).withColumn(
        "url", F.concat(F.lit("https://data.example.org/"), F.col("source_type"), F.lit("/"), F.col("likes"))
    )
    return g.popularity(found, ORDER).select("url", "arrival", "popularity")


@query(
    "route_ids",
    "with i as (select doc_id, case doc_id % 3 when 0 then source || '/' || doc_id when 1 then source || '-' || doc_id"
    " else 'http://x.example/' || doc_id end as source_id from documents) select doc_id, source_id,"
    " case when contains(source_id, '/') and not starts_with(source_id, 'http') then 'kaggle' else 'huggingface' end as source_type,"
    " case when contains(source_id, '/') and not starts_with(source_id, 'http') then 'https://www.kaggle.com/datasets/'"
    " else 'https://huggingface.co/datasets/' end || source_id as url,"
    " case when contains(source_id, '/') and not starts_with(source_id, 'http') then 'xlsx' else 'parquet' end"
    " as file_extension, 0.5::double as compliance_score from i",
)
def _(spark, sf):
    which = F.col("doc_id") % 3
    ids = table(spark, sf, "documents").select(
        "doc_id",
        F.when(which == 0, F.concat_ws("/", "source", "doc_id"))
        .when(which == 1, F.concat_ws("-", "source", "doc_id"))
        .otherwise(F.concat(F.lit("http://x.example/"), F.col("doc_id")))
        .alias("source_id"),
    )
    return g.route_ids(ids)


@query(
    "candidates_validate",
    _WITH + ", b as (select arrival, nullif(source_id, case when arrival % 19 = 0 then source_id end) as source_id,"
    " case when arrival % 7 = 0 then 'not a url' else url end as url,"
    " case when arrival % 11 = 0 then 'ftp' else source_type end as source_type,"
    " case when arrival % 5 = 0 then 1.5 else 0.5 end as score from c) select arrival,"
    " concat_ws(';', case when source_id is null then 'missing source_id' end, case when url = 'not a url' then 'bad url' end,"
    " case when source_type = 'ftp' then 'bad source_type' end, case when score > 1 then 'score out of range' end) as reasons,"
    " source_id is not null and url <> 'not a url' and source_type <> 'ftp' and score <= 1 as is_valid from b",
)
def _(spark, sf):
    n = F.col("arrival")
    broken = candidates(spark, sf).withColumns(
        {
            "source_id": F.when(n % 19 != 0, F.col("source_id")),
            "url": F.when(n % 7 == 0, "not a url").otherwise(F.col("url")),
            "source_type": F.when(n % 11 == 0, "ftp").otherwise(F.col("source_type")),
            "compliance_score": F.when(n % 5 == 0, 1.5).otherwise(0.5),
        }
    )
    return g.validate_candidates(broken).select("arrival", F.array_join("reasons", ";").alias("reasons"), "is_valid")

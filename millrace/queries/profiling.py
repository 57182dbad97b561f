"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.operators import profile as p
from millrace.operators.recipe import Recipe, default_recipe, rule_actions, validate_recipe
from millrace.operators.split import detect_strategy
from millrace.queries.registry import query, table
from millrace.queries.views import DIRTY_SQL, LINE_KEY, SKEWED_SQL, dirty_lineitem, skewed_lineitem

LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINE_STRINGS = ["l_returnflag", "l_linestatus"]
DIRTY_COLUMNS = [
    ("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"),
    ("l_shipdate", "temporal"), ("qty_txt", "categorical"), ("price_null", "numeric"), ("flag_null", "categorical"),
    ("ship_txt", "categorical"),
]
SKEWED_NUMBERS = ["l_quantity", "l_discount", "gross", "steep"]


def _each(columns, template: str) -> str:
    return " union all ".join(template.format(c=c) for c in columns)


def _quantile(c: str, p: float) -> str:
    return f"list_sort(list({c}) filter (where {c} is not null))[1+round({p}*(count({c})-1))::int]::double"


_HINT = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(\"column\"), '{m}')" for m in marks) + f" then '{hint}'"
    for hint, marks in fixed.DOMAIN_HINTS
) + " end"

_SKEW = "(avg({c})-median({c}))/nullif(stddev_samp({c}),0)"


@query(
    "profile_dataset_info",
    "select count(*) as total_rows, 11 as total_columns, count(*) > 100000 as sampled,"
    " least(count(*), 100000) as sample_size from lineitem",
)
def _(spark, sf):
    return p.dataset_info(table(spark, sf, "lineitem"))


@query(
    "profile_sample",
    "select o_orderkey, o_custkey, o_totalprice from orders"
    " order by md5('42|' || o_orderkey::varchar), o_orderkey limit 5000",
)
def _(spark, sf):
    sampled = p.profile_sample(table(spark, sf, "orders"), ["o_orderkey"], 5000)
    return sampled.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "profile_nulls",
    f"with t as ({DIRTY_SQL}) "
    + _each(
        [c for c, _ in DIRTY_COLUMNS],
        "select '{c}' as \"column\", count(*) filter (where {c} is null) as null_count,"
        " printf('%.2f', (count(*) filter (where {c} is null))::double / count(*) * 100)::double as null_percentage from t",
    ),
)
def _(spark, sf):
    return p.null_counts(dirty_lineitem(spark, sf))


@query(
    "profile_distinct",
    f"with t as ({DIRTY_SQL}) "
    + _each(
        [c for c, _ in DIRTY_COLUMNS],
        "select '{c}' as \"column\", count(distinct {c}) + (case when count(*) > count({c}) then 1 else 0 end)"
        " as unique_count, count(distinct {c}) as distinct_values from t",
    ),
)
def _(spark, sf):
    return p.distinct_counts(dirty_lineitem(spark, sf))


@query(
    "profile_distinct_approx",
    f"with t as ({DIRTY_SQL}) "
    + _each(
        [c for c, _ in DIRTY_COLUMNS],
        "select '{c}' as \"column\", count(distinct {c}) as distinct_values, true as within from t",
    ),
)
def _(spark, sf):
    # estimates next to exact counts: within three standard errors of 5 %
    dirty = dirty_lineitem(spark, sf)
    near = p.distinct_counts(dirty, exact=False).select("column", F.col("distinct_values").alias("estimate"))
    off = F.abs(F.col("estimate") - F.col("distinct_values"))
    exact = p.distinct_counts(dirty).select("column", "distinct_values").join(near, "column")
    return exact.withColumn("within", off <= 0.15 * F.col("distinct_values")).drop("estimate")


@query(
    "profile_numeric",
    _each(
        LINE_NUMBERS,
        "select '{c}' as \"column\", min({c})::double as \"min\", max({c})::double as \"max\", round(avg({c}), 4) as mean,"
        " median({c})::double as median, round(stddev_samp({c}), 4) as std from lineitem",
    ),
)
def _(spark, sf):
    stats = p.numeric_profile(table(spark, sf, "lineitem"))
    return stats.select("column", "min", "max", F.round("mean", 4).alias("mean"), "median", F.round("std", 4).alias("std"))


@query(
    "profile_quartiles",
    _each(
        LINE_NUMBERS,
        "select '{c}' as \"column\", " + _quantile("{c}", 0.25) + " as q1, " + _quantile("{c}", 0.75)
        + " as q3 from lineitem",
    ),
)
def _(spark, sf):
    return p.numeric_profile(table(spark, sf, "lineitem")).select("column", "q1", "q3")


def _fenced(select: str) -> str:
    return (
        f"with t as ({SKEWED_SQL}), q as ("
        + _each(
            SKEWED_NUMBERS,
            "select '{c}' as \"column\", " + _quantile("{c}", 0.25) + " as q1, " + _quantile("{c}", 0.75) + " as q3 from t",
        )
        + "), v as ("
        + _each(SKEWED_NUMBERS, "select '{c}' as \"column\", {c}::double as x from t")
        + f") {select}"
    )


@query(
    "profile_outliers",
    _fenced(
        "select \"column\", round(any_value(q1 - 1.5*(q3-q1)), 4) as lower, round(any_value(q3 + 1.5*(q3-q1)), 4) as upper,"
        " count(*) filter (where x < q1 - 1.5*(q3-q1) or x > q3 + 1.5*(q3-q1)) as outlier_count,"
        " printf('%.2f', (count(*) filter (where x < q1 - 1.5*(q3-q1) or x > q3 + 1.5*(q3-q1)))::double / count(x) * 100)"
        "::double as outlier_percentage from v join q using (\"column\") group by 1"
    ),
)
def _(spark, sf):
    stats = p.numeric_profile(skewed_lineitem(spark, sf).select(*SKEWED_NUMBERS))
    return stats.select(
        "column", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "outlier_count",
        "outlier_percentage",
    )


@query(
    "profile_skew",
    f"with t as ({SKEWED_SQL}) "
    + _each(
        SKEWED_NUMBERS,
        f"select '{{c}}' as \"column\", round({_SKEW}, 3) as skewness, abs({_SKEW}) > 1 as is_skewed from t",
    ),
)
def _(spark, sf):
    return p.numeric_profile(skewed_lineitem(spark, sf).select(*SKEWED_NUMBERS)).select("column", "skewness", "is_skewed")


_STRINGS = [c for c, kind in DIRTY_COLUMNS if kind == "categorical"]


@query(
    "profile_categorical",
    f"with t as ({DIRTY_SQL}) "
    + _each(
        _STRINGS,
        "select '{c}' as \"column\", count(distinct {c}) as unique_count, count(distinct {c}) > count({c})*0.5"
        " as is_high_cardinality, printf('%.3f', count(distinct {c})::double / count({c}))::double as cardinality_ratio from t",
    ),
)
def _(spark, sf):
    return p.categorical_profile(dirty_lineitem(spark, sf))


@query(
    "profile_top_values",
    f"with t as ({DIRTY_SQL}), v as ("
    + _each(_STRINGS, "select '{c}' as \"column\", {c} as \"value\" from t where {c} is not null")
    + '), n as (select "column", "value", count(*) as "count" from v group by 1, 2)'
    ' select "column", "value", "count", row_number() over (partition by "column" order by "count" desc, "value")::int'
    " as rank from n qualify rank <= 5",
)
def _(spark, sf):
    return p.top_values(dirty_lineitem(spark, sf), _STRINGS)


@query(
    "value_counts",
    " union all ".join(
        f"select '{c}' as \"column\", {c} as \"value\", count(*) as \"count\" from lineitem group by 2" for c in LINE_STRINGS
    ),
)
def _(spark, sf):
    return p.value_counts(table(spark, sf, "lineitem"), LINE_STRINGS)


@query(
    "profile_temporal",
    "select 'ts' as \"column\", strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as min_date,"
    " strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as max_date, bool_and(ok) as is_monotonic from"
    " (select ts, coalesce(ts >= lag(ts) over (order by event_id), true) as ok from events)"
    " union all select 'shuffled', strftime(min(s), '%Y-%m-%d %H:%M:%S.%f'), strftime(max(s), '%Y-%m-%d %H:%M:%S.%f'),"
    " bool_and(ok) from (select s, coalesce(s >= lag(s) over (order by event_id), true) as ok from"
    " (select event_id, ts + to_seconds(event_id % 7919) as s from events))",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "ts", (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 7919)).alias("shuffled")
    )
    found = p.temporal_profile(events, ["event_id"])
    micros = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    text = {c: F.date_format(F.col(c).cast("timestamp_ntz"), micros) for c in ("min_date", "max_date")}
    return found.withColumns(text)


@query(
    "domain_hints",
    f"select p_partkey, \"column\", {_HINT} as hint from (select p_partkey, p_name as \"column\" from part union all"
    " select p_partkey, p_brand || ' ' || case p_size % 7 when 0 then 'Sale Price' when 1 then 'Birth_Year' when 2 then 'updatedAt_time'"
    " when 3 then 'ROW_ID' when 4 then 'titleText' when 5 then 'page_id' else 'colour' end from part)",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    words = ["Sale Price", "Birth_Year", "updatedAt_time", "ROW_ID", "titleText", "page_id", "colour"]
    word = F.get(F.array(*[F.lit(w) for w in words]), F.col("p_size") % 7)
    names = F.array(F.col("p_name"), F.concat_ws(" ", "p_brand", word))
    return part.select("p_partkey", F.explode(names).alias("column")).withColumn("hint", p.domain_hint(F.col("column")))


def _dirty_profile_sql() -> str:
    shared = (
        "select '{c}' as \"column\", {i} as position, '{kind}' as type, count(*) filter (where {c} is null) as null_count,"
        " printf('%.2f', (count(*) filter (where {c} is null))::double / count(*) * 100)::double as null_percentage,"
    )
    nothing = {
        "mean": "double", "median": "double", "std": "double", "q1": "double", "q3": "double", "outlier_count": "bigint",
        "skewness": "double", "is_high_cardinality": "boolean", "cardinality_ratio": "double", "top_values": "varchar",
        "min_date": "varchar", "is_monotonic": "boolean",
    }
    parts = []
    for i, (c, kind) in enumerate(DIRTY_COLUMNS):
        values = {n: f"null::{t}" for n, t in nothing.items()}
        values["unique_count"] = f"count(distinct {c}) + (case when count(*) > count({c}) then 1 else 0 end)"
        if kind == "numeric":
            fence = f"(select {_quantile(c, 0.25)} as a, {_quantile(c, 0.75)} as b from t)"
            values.update(
                mean=f"round(avg({c}), 4)", median=f"median({c})::double", std=f"round(stddev_samp({c}), 4)",
                q1=_quantile(c, 0.25), q3=_quantile(c, 0.75), skewness=f"round({_SKEW.format(c=c)}, 3)",
                outlier_count=f"(select count(*) from t, {fence} f where {c} < a-1.5*(b-a) or {c} > b+1.5*(b-a))",
            )
        elif kind == "categorical":
            values.update(
                unique_count=f"count(distinct {c})", is_high_cardinality=f"count(distinct {c}) > count({c})*0.5",
                cardinality_ratio=f"printf('%.3f', count(distinct {c})::double / count({c}))::double",
                top_values=f"(select string_agg(v || ':' || n, ';' order by n desc, v) from (select {c} as v, count(*) as n"
                f" from t where {c} is not null group by 1 order by n desc, v limit 5))",
            )
        else:
            values.update(
                min_date=f"strftime(min({c}), '%Y-%m-%d %H:%M:%S')",
                is_monotonic=f"(select bool_and(ok) from (select coalesce({c} >= lag({c}) over"
                " (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate), true) as ok from t))",
            )
        listed = ", ".join(f"{v} as {n}" for n, v in values.items())
        parts.append(shared.format(c=c, i=i, kind=kind) + f" {listed} from t")
    return f"with t as ({DIRTY_SQL}) select *, {_HINT} as domain_hint from (" + " union all ".join(parts) + ")"


def _flat(profile):
    top = F.array_join(
        F.transform("top_values", lambda x: F.concat(x["value"], F.lit(":"), x["count"].cast("string"))), ";"
    )
    return profile.select(
        "column", "position", "type", "null_count", "null_percentage", F.round("mean", 4).alias("mean"), "median",
        F.round("std", 4).alias("std"), "q1", "q3", "outlier_count", "skewness", "is_high_cardinality",
        "cardinality_ratio", top.alias("top_values"), "min_date", "is_monotonic", "unique_count", "domain_hint",
    )


@query("column_profile", _dirty_profile_sql())
def _(spark, sf):
    return _flat(p.column_profile(dirty_lineitem(spark, sf), LINE_KEY))


_KINDS = f"with t as ({DIRTY_SQL}), k as (" + _each(
    _STRINGS, "select '{c}' as c, count(distinct {c}) as d, count({c}) as n, count(*) as a from t"
) + ")"


@query(
    "profile_insights",
    _KINDS + " select 9::bigint as total_columns, 5::bigint as numeric_columns, 3::bigint as categorical_columns,"
    " 1::bigint as temporal_columns,"
    " (select string_agg(c, ',') from k where d <= n*0.5 and d < 50 and n > 0) as target_candidates,"
    " '' as high_missing_columns, true as has_temporal",
)
def _(spark, sf):
    found = p.profile_insights(p.column_profile(dirty_lineitem(spark, sf)))
    return found.withColumns(
        {c: F.array_join(c, ",") for c in ("target_candidates", "high_missing_columns")}
    )


# --- recipes and strategies, decided on profiles ---

_RULES = f"""
with t as ({SKEWED_SQL}), p as (select * from (values
  {", ".join(f"('{c}', {i}, '{k}')" for i, (c, k) in enumerate([
      ("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"),
      ("l_shipdate", "temporal"), ("l_quantity", "numeric"), ("l_discount", "numeric"), ("l_returnflag", "categorical"),
      ("gross", "numeric"), ("steep", "numeric")]))}) p("column", position, kind)),
n as ({_each(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "gross", "steep"],
  "select '{c}' as c, 100 * (count(*) filter (where {c} is null))::double / count(*) as missing,"
  " abs((avg({c})-median({c}))/nullif(stddev_samp({c}),0)) > 1 as skewed,"
  " (select 100 * (count(*) filter (where x < a-1.5*(b-a) or x > b+1.5*(b-a)))::double / count(x) from"
  " (select {c}::double as x from t), (select " + _quantile("{c}", 0.25) + " as a, " + _quantile("{c}", 0.75)
  + " as b from t)) as outside from t")})
select "column", position::int as position,
  case when kind = 'numeric' and outside > 0 and outside < 20 then 'clip' else 'keep' end as outlier_action,
  case when coalesce(missing, 0) = 0 or missing > 30 then 'keep' when missing < 5 then 'drop_rows'
       when skewed then 'median' else 'mean' end as impute_action,
  kind = 'categorical' and (select count(distinct l_returnflag) from t) between 2 and 50 as is_target,
  coalesce(missing, 0) > 90 as drop_column
from p left join n on p."column" = n.c"""


@query("rule_recipe", _RULES)
def _(spark, sf):
    return rule_actions(p.column_profile(skewed_lineitem(spark, sf)))


@query(
    "default_recipe",
    _KINDS + " select (select first(c order by case c when 'qty_txt' then 0 when 'flag_null' then 1 else 2 end) from k"
    " where d <= n*0.5 and d < 50 and n > 0) as target_column, 'keep' as outlier_strategy, 'mode' as impute_strategy,"
    " '' as type_conversions, coalesce((select string_agg(c, ',') from k where (a-n)::double/a > 0.9), '') as drop_columns,"
    " 0.5::double as confidence",
)
def _(spark, sf):
    return default_recipe(p.column_profile(dirty_lineitem(spark, sf))).frame(spark)


@query(
    "validate_recipe",
    f"with t as ({DIRTY_SQL}), r as (select count(*) filter (where flag_null is null) as gaps from t)"
    " select null::varchar as target_column, 'clip' as outlier_strategy,"
    " case when gaps > 0 then 'mode' else 'median' end as impute_strategy, 'qty_txt:Float64' as type_conversions,"
    " 'ship_txt' as drop_columns, 0.8::double as confidence from r",
)
def _(spark, sf):
    asked = Recipe(
        "no_such_column", "clip", "median", {"qty_txt": "Float64", "ghost": "Int64"}, ["ship_txt", "phantom"], 0.8
    )
    return validate_recipe(asked, p.column_profile(dirty_lineitem(spark, sf))).frame(spark)


@query(
    "detect_split_strategy",
    "select 'events' as source, case when (select bool_and(ok) from (select coalesce(ts >= lag(ts) over"
    " (order by event_id), true) as ok from events)) then 'temporal' else 'random' end as strategy"
    " union all select 'orders', case when (select bool_and(ok) from (select coalesce(o_orderdate >= lag(o_orderdate)"
    " over (order by o_orderkey), true) as ok from orders)) then 'temporal' when (select count(distinct o_orderstatus)"
    " from orders) < 50 then 'stratified' else 'random' end"
    " union all select 'customer', 'random'",
)
def _(spark, sf):
    cases = [
        ("events", ["event_id"], "event_type"), ("orders", ["o_orderkey"], "o_orderstatus"), ("customer", ["c_custkey"], None),
    ]
    found = [(t, detect_strategy(p.column_profile(table(spark, sf, t), o), target)) for t, o, target in cases]
    return spark.createDataFrame(found, "source string, strategy string")



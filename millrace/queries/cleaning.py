"""Cleaning queries, on the dirty line items where not said otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import cells
from millrace.functions import fixed_values as fixed
from millrace.operators import clean as c
from millrace.operators import dates as d
from millrace.operators import recipe as r
from millrace.operators.profile import column_profile
from millrace.queries.registry import query, table
from millrace.queries.views import DIRTY_SQL, LINE_KEY, LINE_ORDER, SKEWED_SQL, dirty_lineitem, skewed_lineitem

KEY = ", ".join(LINE_KEY)
ORDER = ", ".join(LINE_ORDER)
FORMATS = [f for f, _ in fixed.DATE_FORMATS]

# an oracle for coercion: strip, undecorate, null tokens, number
_BARE = "regexp_replace(trim({x}), '[,$%€£¥]', '', 'g')"
_TOKENS = ", ".join(f"'{t}'" for t in fixed.NULL_TOKENS)


def _bare(x: str) -> str:
    return f"(case when {_BARE.format(x=x)} not in ({_TOKENS}) then {_BARE.format(x=x)} end)"


def _number(x: str) -> str:
    return f"try_cast({_bare(x)} as double)"


# --- dates ---

_TEXTS = ("qty_txt", "flag_null", "ship_txt")
_FORMAT = "case " + " ".join(
    f"when count(try_strptime({{0}}, '{f}')) > 0.9 * count({{0}}) then '{f}'" for f in FORMATS
) + " end"
_DETECT = f"with t as ({DIRTY_SQL}) " + " union all ".join(
    f"select '{x}' as \"column\", {_FORMAT.format(x)} as format from t" for x in _TEXTS
)


@query("date_detect_format", _DETECT)
def _(spark, sf):
    return d.detect_date_formats(dirty_lineitem(spark, sf), LINE_ORDER)


@query(
    "date_columns",
    f"with f as ({_DETECT}) select n as \"column\", n = 'l_shipdate' or n in (select \"column\" from f"
    " where format is not null) as is_date from (values ('l_orderkey'), ('l_partkey'), ('l_suppkey'), ('l_linenumber'),"
    " ('l_shipdate'), ('qty_txt'), ('price_null'), ('flag_null'), ('ship_txt')) n(n)",
)
def _(spark, sf):
    return d.date_columns(dirty_lineitem(spark, sf), LINE_ORDER)


@query(
    "date_parse",
    f"with t as ({DIRTY_SQL}) select {KEY}, try_strptime(ship_txt, '%d/%m/%Y')::date as european,"
    " try_strptime(ship_txt, '%m/%d/%Y')::date as american,"
    " try_strptime(strftime(l_shipdate, '%d-%b-%Y'), '%d-%b-%Y')::date as named,"
    " try_strptime(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')::date as timed from t",
)
def _(spark, sf):
    texts = dirty_lineitem(spark, sf).select(
        *LINE_KEY,
        F.col("ship_txt").alias("european"),
        F.col("ship_txt").alias("american"),
        F.date_format("l_shipdate", "dd-MMM-yyyy").alias("named"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("timed"),
    )
    formats = {"european": "%d/%m/%Y", "american": "%m/%d/%Y", "named": "%d-%b-%Y", "timed": "%Y-%m-%d %H:%M:%S"}
    return d.parse_dates(texts, formats)


@query(
    "date_auto_parse",
    f"with t as ({DIRTY_SQL}) select {KEY}, qty_txt, flag_null, try_strptime(ship_txt, '%d/%m/%Y')::date as ship_txt from t",
)
def _(spark, sf):
    return d.auto_parse_dates(dirty_lineitem(spark, sf), LINE_ORDER).select(*LINE_KEY, "qty_txt", "flag_null", "ship_txt")


_UNIX = "select event_id, user_id, value, epoch(ts)::bigint as seconds, epoch_ms(ts) as millis from events"


def _unix(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", "value",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"),
    )


@query(
    "unix_ts_detect",
    f"with t as ({_UNIX}) "
    + " union all ".join(
        f"select '{x}' as \"column\", bool_and({x} between 946684800 and 2524608000"
        f" or {x} between 946684800000 and 2524608000000) as is_unix from t"
        for x in ("event_id", "user_id", "value", "seconds", "millis")
    ),
)
def _(spark, sf):
    return d.detect_unix_ts(_unix(spark, sf), ["event_id"])


@query(
    "unix_ts_parse",
    "select event_id, ts::date as seconds, ts::date as millis, ts::date as mixed from events",
)
def _(spark, sf):
    mixed = F.when(F.col("event_id") % 2 == 0, F.col("millis")).otherwise(F.col("seconds"))
    events = _unix(spark, sf).withColumn("mixed", mixed)
    return d.parse_unix_ts(events, ["seconds", "millis", "mixed"]).select("event_id", "seconds", "millis", "mixed")


# --- coercion, types, names ---


@query(
    "coerce_mixed_ratio",
    f"with t as ({DIRTY_SQL}) "
    + " union all ".join(
        f"select '{x}' as \"column\", count({_bare(x)}) as filled, count({_number(x)}) as numeric,"
        f" round(count({_number(x)})::double / count({_bare(x)}), 6) as ratio from t"
        for x in ("qty_txt", "flag_null", "ship_txt")
    ),
)
def _(spark, sf):
    return c.coerce_ratios(dirty_lineitem(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query("coerce_mixed", f"with t as ({DIRTY_SQL}) select {KEY}, {_number('qty_txt')} as qty_txt, flag_null, ship_txt from t")
def _(spark, sf):
    return c.coerce_mixed(dirty_lineitem(spark, sf)).select(*LINE_KEY, "qty_txt", "flag_null", "ship_txt")


@query(
    "smart_preprocess",
    f"with t as ({DIRTY_SQL}) select {KEY}, {_number('qty_txt')} as qty_txt, flag_null,"
    " try_strptime(ship_txt, '%d/%m/%Y')::date as ship_txt, l_shipdate::date as compact from t",
)
def _(spark, sf):
    compact = dirty_lineitem(spark, sf).withColumn("compact", F.date_format("l_shipdate", "yyyyMMdd"))
    return c.smart_preprocess(compact, LINE_ORDER).select(*LINE_KEY, "qty_txt", "flag_null", "ship_txt", "compact")


@query("strip_commas", f"with t as ({DIRTY_SQL}) select {KEY}, replace(qty_txt, ',', '') as qty_txt from t")
def _(spark, sf):
    return c.strip_commas(dirty_lineitem(spark, sf), ["qty_txt"]).select(*LINE_KEY, "qty_txt")


@query(
    "convert_types",
    f"select {KEY}, l_quantity::int as l_quantity, l_tax::varchar as l_tax, l_returnflag,"
    " l_shipdate::date as day, try_cast(l_linestatus as double) as l_linestatus from lineitem",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate"))
    typed = c.convert_types(lines, {"l_quantity": "Int32", "l_tax": "Utf8", "day": "Date", "l_returnflag": "Decimal"})
    lossy = c.convert_types(typed, {"l_linestatus": "Float64"}, on_error="null")
    return lossy.select(*LINE_KEY, "l_quantity", "l_tax", "l_returnflag", "day", "l_linestatus")


@query("drop_columns", f"with t as ({DIRTY_SQL}) select * exclude (qty_txt, ship_txt) from t")
def _(spark, sf):
    return c.drop_columns(dirty_lineitem(spark, sf), ["qty_txt", "ship_txt", "no_such_column"])


@query("clean_headers", "select o_orderkey as \"key\", o_custkey as cust, o_totalprice as total, o_orderstatus as total_2 from orders")
def _(spark, sf):
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    messy = table(spark, sf, "orders").select(*cols).toDF("\ufeffkey", "cust\u200b ", "\u200ctotal", " total\u2060")
    return c.clean_headers(messy)


@query(
    "standardize_columns",
    "select o_orderkey as user_id, o_totalprice as total_purchase_amount, o_orderstatus as is_active,"
    " o_custkey as of_orders, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') as slug from orders",
)
def _(spark, sf):
    named = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("User ID"),
        F.col("o_totalprice").alias("Total Purchase Amount ($)"),
        F.col("o_orderstatus").alias("Is Active?"),
        F.col("o_custkey").alias("# of Orders"),
        cells.snake_case(F.col("o_orderpriority")).alias("Slug"),
    )
    return c.standardize_columns(named)


@query(
    "apply_mapping",
    "select o_orderkey as id, o_custkey as buyer, 'complete' as kind from orders union all"
    " select o_orderkey, o_custkey, 'partial' from orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    full = c.standardize_columns(orders, {"o_orderkey": "id", "o_custkey": "buyer"})
    part = c.standardize_columns(orders.toDF("ID!", "Buyer"), {"ID!": "never used"})
    return full.withColumn("kind", F.lit("complete")).unionByName(part.withColumn("kind", F.lit("partial")))


# --- outliers and missing values ---

_BOUNDS = (
    f"with t as ({SKEWED_SQL}), b as (select "
    + ", ".join(
        f"list_sort(list({x}) filter (where {x} is not null))[1+round({p}*(count({x})-1))::int]::double as {x}_{q}"
        for x in ("gross", "steep")
        for q, p in (("a", 0.25), ("z", 0.75))
    )
    + " from t), f as (select "
    + ", ".join(f"{x}_a-1.5*({x}_z-{x}_a) as {x}_lo, {x}_z+1.5*({x}_z-{x}_a) as {x}_hi" for x in ("gross", "steep"))
    + " from b) "
)


def _steep_profile(spark, sf):
    lines = skewed_lineitem(spark, sf)
    return lines, column_profile(lines.select("gross", "steep"))


@query(
    "outlier_clip",
    _BOUNDS + f"select {KEY}, case when gross is null then null else greatest(least(gross, gross_hi), gross_lo) end as gross,"
    " case when steep is null then null else greatest(least(steep, steep_hi), steep_lo) end as steep from t, f",
)
def _(spark, sf):
    lines, profile = _steep_profile(spark, sf)
    return c.handle_outliers(lines, "clip", profile).select(*LINE_KEY, "gross", "steep")


@query(
    "outlier_drop",
    _BOUNDS + f"select {KEY}, gross, steep from t, f where gross >= gross_lo and gross <= gross_hi and steep >= steep_lo"
    " and steep <= steep_hi",
)
def _(spark, sf):
    lines, profile = _steep_profile(spark, sf)
    return c.handle_outliers(lines, "drop", profile).select(*LINE_KEY, "gross", "steep")


_GAPS = {
    "price_null": {"type": "numeric", "null_percentage": 9.0},
    "flag_null": {"type": "categorical", "null_percentage": 5.0},
}


@query(
    "missing_drop_rows",
    f"with t as ({DIRTY_SQL}) select {KEY}, price_null, flag_null from t where price_null is not null"
    " and flag_null is not null",
)
def _(spark, sf):
    lines = dirty_lineitem(spark, sf)
    return c.handle_missing(lines, "drop_rows", column_profile(lines)).select(*LINE_KEY, "price_null", "flag_null")


@query(
    "impute_mean",
    f"with t as ({DIRTY_SQL}) select {KEY}, flag_null, round(coalesce(price_null, (select avg(price_null) from t)), 4)"
    " as price_null from t",
)
def _(spark, sf):
    filled = c.handle_missing(dirty_lineitem(spark, sf), "mean", _GAPS)
    return filled.select(*LINE_KEY, "flag_null", F.round("price_null", 4).alias("price_null"))


@query(
    "impute_median",
    f"with t as ({DIRTY_SQL}) select {KEY}, flag_null, round(coalesce(price_null, (select median(price_null) from t)), 4)"
    " as price_null from t",
)
def _(spark, sf):
    filled = c.handle_missing(dirty_lineitem(spark, sf), "median", _GAPS)
    return filled.select(*LINE_KEY, "flag_null", F.round("price_null", 4).alias("price_null"))


_FILL = "last_value({x} ignore nulls) over ({p}order by {o} rows between unbounded preceding and current row) as {x}"


@query(
    "impute_ffill",
    f"with t as ({DIRTY_SQL}) select {KEY}, "
    + ", ".join(_FILL.format(x=x, p="", o=ORDER) for x in ("price_null", "flag_null"))
    + " from t",
)
def _(spark, sf):
    filled = c.handle_missing(dirty_lineitem(spark, sf), "mode", _GAPS, LINE_ORDER)
    return filled.select(*LINE_KEY, "price_null", "flag_null")


@query(
    "impute_ffill_keyed",
    f"with t as ({DIRTY_SQL}) select {KEY}, "
    + ", ".join(_FILL.format(x=x, p="partition by l_suppkey ", o=ORDER) for x in ("price_null", "flag_null"))
    + " from t",
)
def _(spark, sf):
    filled = c.handle_missing(dirty_lineitem(spark, sf), "mode", _GAPS, LINE_ORDER, ["l_suppkey"])
    return filled.select(*LINE_KEY, "price_null", "flag_null")


@query(
    "impute_mode",
    f"with t as ({DIRTY_SQL}), m as (select flag_null as v from t where flag_null is not null group by 1"
    f" order by count(*) desc, 1 limit 1) select {KEY}, coalesce(flag_null, (select v from m)) as flag_null from t",
)
def _(spark, sf):
    return c.impute_mode(dirty_lineitem(spark, sf), ["flag_null"]).select(*LINE_KEY, "flag_null")


# --- recipes ---

RECIPE = r.Recipe(
    "flag_null", "drop", "drop_rows", {"l_linenumber": "Float64"}, ["l_discount"], 0.9, "drop what cannot be used"
)
_DIRTY_STEEP = (
    _BOUNDS + f", g as (select {KEY}, gross, steep, l_linenumber::double as line, case when l_partkey % 17 = 0 then null"
    " else l_returnflag end as flag_null, l_shipdate::date as ship_txt, gross >= gross_lo and gross <= gross_hi"
    " and steep >= steep_lo and steep <= steep_hi as inside from t, f) "
).replace(") , g as", "), g as")


def _recipe_input(spark, sf):
    return skewed_lineitem(spark, sf).select(
        *LINE_KEY, "gross", "steep", "l_discount",
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_returnflag")).alias("flag_null"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("ship_txt"),
    )


@query(
    "apply_recipe",
    _DIRTY_STEEP + f"select l_orderkey, l_partkey, l_suppkey, line as l_linenumber, l_shipdate, gross, steep, flag_null,"
    " ship_txt from g where coalesce(inside, false) and flag_null is not null",
)
def _(spark, sf):
    lines = _recipe_input(spark, sf)
    return c.apply_recipe(lines, RECIPE, column_profile(lines), LINE_ORDER)[0]


_AUDIT = (
    "select * from (values (1, 'AUTO_PARSE_DATES', 'ship_txt'), (2, 'DROP', 'l_discount'),"
    " (3, 'TYPE_CONVERSION', 'l_linenumber:Float64'), (4, 'OUTLIERS', 'drop'), (5, 'MISSING', 'drop_rows'))"
    " a(step, action, detail)"
)


@query(
    "recipe_audit",
    _DIRTY_STEEP + f", a as ({_AUDIT}), n as (select count(*) as total, count(*) filter (where inside) as kept,"
    " count(*) filter (where inside and flag_null is not null) as full_rows from g)"
    " select step, action, detail, case step when 4 then total when 5 then kept end as rows_before,"
    " case step when 4 then kept when 5 then full_rows end as rows_after from a, n",
)
def _(spark, sf):
    lines = _recipe_input(spark, sf)
    cleaned, audit = c.apply_recipe(lines, RECIPE, column_profile(lines), LINE_ORDER, observe=True)
    cleaned.write.format("noop").mode("overwrite").save()
    return audit.frame()


@query(
    "recipe_dry_run",
    f"select step, action, detail, (select count(*) from lineitem) as total from ({_AUDIT})",
)
def _(spark, sf):
    lines = _recipe_input(spark, sf)
    same, audit = c.apply_recipe(lines, RECIPE, column_profile(lines), LINE_ORDER, dry_run=True)
    return audit.frame().select("step", "action", "detail").withColumn("total", F.lit(same.count()).cast("long"))


@query(
    "parse_fenced_json",
    "select event_id, (props->>'k')::bigint as k, 'json' as fence from events union all"
    " select event_id, (props->>'k')::bigint, 'plain' from events union all"
    " select event_id, (props->>'k')::bigint, 'none' from events union all select event_id, null, 'broken' from events",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    shapes = {
        "json": F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone")),
        "plain": F.concat(F.lit("```\n"), F.col("props"), F.lit("\n```")),
        "none": F.col("props"),
        "broken": F.concat(F.lit("```json\n{"), F.col("props"), F.lit("\n```")),
    }
    answers = events.select(
        "event_id",
        F.inline(F.array(*[F.struct(F.lit(n).alias("fence"), t.alias("answer")) for n, t in shapes.items()])),
    )
    return r.parse_fenced_json(answers, "answer", "k bigint").select("event_id", F.col("parsed.k").alias("k"), "fence")

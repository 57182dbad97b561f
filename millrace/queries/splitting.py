"""Split and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.split import split, split_distribution
from millrace.plans.ordered import global_ordinal
from millrace.queries.registry import query, table
from millrace.queries.views import LINE_KEY, LINE_ORDER

KEY = ", ".join(LINE_KEY)
_TEXT = (
    "l_orderkey::varchar || '|' || l_partkey::varchar || '|' || l_suppkey::varchar || '|' || l_linenumber::varchar || '|' ||"
    " strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"
)
_HASH = f"md5('42|' || {_TEXT})"


def _ordered(partition: str, order: str, ratios, columns: str) -> str:
    train, test, val = ratios
    rest = "'val'" if val > 0 else "null"
    return (
        f"select * from (select {columns}, case when i < floor(n * {train}::double) then 'train'"
        f" when i < floor(n * {train}::double) + floor(n * {test}::double) then 'test' else {rest} end as split from"
        f" (select *, row_number() over ({partition} order by {order}) - 1 as i, count(*) over ({partition}) as n"
        " from lineitem)) where split is not null"
    )


_RANDOM = _ordered("", f"{_HASH}, {KEY}", (0.7, 0.2, 0.1), KEY)
_STRATIFIED = _ordered("partition by l_returnflag", f"{_HASH}, {KEY}", (0.8, 0.2, 0.0), f"{KEY}, l_returnflag")


@query("split_random", _RANDOM)
def _(spark, sf):
    return split(table(spark, sf, "lineitem"), "random", LINE_KEY, ratios=(0.7, 0.2, 0.1)).select(*LINE_KEY, "split")


@query("split_random_fast", f"select {KEY}, case when {_HASH} < 'cccccccc' then 'train' else 'test' end as split from lineitem")
def _(spark, sf):
    return split(table(spark, sf, "lineitem"), "random", LINE_KEY, mode="fast").select(*LINE_KEY, "split")


@query("split_stratified", _STRATIFIED)
def _(spark, sf):
    labelled = split(table(spark, sf, "lineitem"), "STRATIFIED", LINE_KEY, target="l_returnflag")
    return labelled.select(*LINE_KEY, "l_returnflag", "split")


@query("split_temporal", _ordered("", ", ".join(LINE_ORDER), (0.7, 0.2, 0.1), KEY))
def _(spark, sf):
    labelled = split(table(spark, sf, "lineitem"), "temporal", order_by=LINE_ORDER, ratios=(0.7, 0.2, 0.1))
    return labelled.select(*LINE_KEY, "split")


@query(
    "split_distribution",
    f"select split, l_returnflag, count(*) as \"rows\", round(count(*) / sum(count(*)) over (partition by split), 4) as share"
    f" from ({_STRATIFIED}) group by 1, 2",
)
def _(spark, sf):
    return split_distribution(
        split(table(spark, sf, "lineitem"), "stratified", LINE_KEY, target="l_returnflag"), "l_returnflag"
    )


@query("global_ordinal", f"select {KEY}, row_number() over (order by {', '.join(LINE_ORDER)}) - 1 as ordinal from lineitem")
def _(spark, sf):
    return global_ordinal(table(spark, sf, "lineitem"), LINE_ORDER).select(*LINE_KEY, F.col("ordinal"))

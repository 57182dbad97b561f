"""Time the headline queries: one warm-up, then the median of three runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from millrace.operators import clean, web
from millrace.operators.licenses import detect_license
from millrace.operators.monitor import rolling_failure_rate
from millrace.operators.profile import column_profile
from millrace.operators.recipe import rule_recipe
from millrace.operators.split import split
from millrace.queries.registry import table
from millrace.queries.views import LINE_KEY, LINE_ORDER, dirty_lineitem, skewed_lineitem
from millrace.session import build_session, scratch_path
from millrace.sources.readers import spread
from millrace.sources.writers import export_split

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines = table(spark, SF, "lineitem")
    even_lines = spread(lines, "l_orderkey")
    dirty = dirty_lineitem(spark, SF)
    skewed = skewed_lineitem(spark, SF)
    events = table(spark, SF, "events").selectExpr("event_id", "user_id", "ts", "event_type = 'error' as fail")
    documents, pages = spread(table(spark, SF, "documents"), "doc_id"), spread(table(spark, SF, "pages"), "page_id")
    skewed_profile = column_profile(skewed).persist()
    recipe = rule_recipe(skewed_profile)
    gaps = {
        "price_null": {"type": "numeric", "null_percentage": 9.0},
        "flag_null": {"type": "categorical", "null_percentage": 5.0},
    }
    work = {
        "column_profile": lambda: consume(column_profile(lines, LINE_KEY)),
        "apply_recipe": lambda: consume(clean.apply_recipe(skewed, recipe, skewed_profile, LINE_ORDER)[0]),
        "smart_preprocess": lambda: consume(clean.smart_preprocess(spread(dirty, "l_orderkey"), LINE_ORDER)),
        "split_random": lambda: consume(split(even_lines, "random", LINE_KEY)),
        "split_random_fast": lambda: consume(split(even_lines, "random", LINE_KEY, mode="fast")),
        "split_stratified": lambda: consume(split(even_lines, "stratified", LINE_KEY, target="l_returnflag")),
        "split_temporal": lambda: consume(split(lines, "temporal", order_by=LINE_ORDER)),
        "impute_ffill": lambda: consume(clean.handle_missing(dirty, "mode", gaps, LINE_ORDER)),
        "impute_median": lambda: consume(clean.handle_missing(dirty, "median", gaps)),
        "license_detect": lambda: consume(detect_license(documents, "text")),
        "page_metadata": lambda: consume(web.page_metadata(pages)),
        "page_extract": lambda: consume(web.extract_pages(pages)),
        "rolling_failure_rate": lambda: consume(rolling_failure_rate(events, "user_id", ["ts", "event_id"], "fail")),
        "export_split": lambda: consume(
            export_split(split(even_lines, "random", LINE_KEY, mode="fast"), scratch_path(spark, "bench"), "lines")
        ),
    }
    wanted = sys.argv[1:]
    times = {}
    for name, run in work.items():
        if wanted and name not in wanted:
            continue
        run()
        measured = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured), 3)
    result = {
        "metric": "total of median seconds per query", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF.rsplit("sf", 1)[-1], "lineitem_rows": lines.count(),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

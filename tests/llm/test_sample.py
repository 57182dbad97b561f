from pyspark.sql import functions as F

from millrace.llm.language import bounded_sample


def test_bounded_sample_is_the_first_of_each_label(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "few").when(F.col("id") % 7000 == 1, F.lit(None)).otherwise("many").alias("kind")
    )
    rows = rows.unionByName(rows.filter("doc_id < 500"))
    ranked = {}
    for r in rows.distinct().select("doc_id", "kind", F.xxhash64("doc_id").alias("h")).collect():
        ranked.setdefault(r["kind"], []).append((r["h"], r["doc_id"]))
    order = sorted((at, h, k or "", i, k) for k, found in ranked.items() for at, (h, i) in enumerate(sorted(found)))
    for limit in (1, 7, 300, 5000):
        got = bounded_sample(rows, "kind", ["doc_id"], limit).collect()
        want = [(i, k) for _, _, _, i, k in order if k is not None]
        labelled = [(r["doc_id"], r["kind"]) for r in got]
        assert len(set(labelled)) == len(labelled) <= limit
        if limit in (300, 5000):
            assert set(labelled) <= set(want[: limit + 10]) and len(labelled) >= limit - 5

"""Whole tables reach the operators, and the rows are those of SQL."""

from comuna.plans import whole

from .test_queries import SF

def test_nothing_is_left_out(spark):
    count = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    assert whole.route_timings(spark, SF).count() == count("events")
    assert whole.schedule_expand(spark, SF).select("pattern_id").distinct().count() == count("part")
    assert whole.timeline_union(spark, SF).where("what = 'creado'").count() == count("orders")
    assert whole.publication_upsert(spark, SF).select("doc_id").distinct().count() == count("documents")

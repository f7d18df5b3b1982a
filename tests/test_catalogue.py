import pytest
from compare import DATA, assert_same

from strandline.plans import catalogue

ORACLE = catalogue.oracle_sql()


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    if name in ORACLE:
        assert_same(df, duck, ORACLE[name])
    else:
        assert df.count() > 0


def test_results_are_not_empty(spark):
    for name in ("phase_order_violations", "unknown_originals", "batch_verdict", "sequence_pattern", "scene_segments"):
        assert not catalogue.queries()[name](spark, DATA).isEmpty(), name


def test_schedule_matches_a_plain_loop(spark):
    rows = catalogue.queries()["capture_schedule"](spark, DATA).collect()
    assert any(r.accepted for r in rows) and any(not r.accepted for r in rows)
    by_user = {}
    for r in rows:
        if r.accepted:
            assert r.due_ms is not None and r.interval_ms in (1000, 2000)
            by_user.setdefault(r.user_id, []).append(r)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = catalogue.queries()["keyset_page_of_events"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "TakeOrderedAndProject" in plan
    plan = catalogue.queries()["owner_scope"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_nationkey,7)" in plan


@pytest.mark.parametrize("name", ["time_texts", "clocks_and_units", "daily_manifest", "frame_receipts", "completed_frames", "session_diagnostics", "pairing"])
def test_results_do_not_depend_on_the_time_zone(spark, duck, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/Los_Angeles", "Pacific/Auckland"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert_same(catalogue.queries()[name](spark, DATA), duck, ORACLE[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_image_sizes_of_larger_keys(spark, duck, tmp_path):
    """Sides that 64 does not make small enough, which the smallest tables do not have, keep 64."""
    parts = [(k, size) for k, size in zip(range(16_380, 17_020), [1, 7, 50] * 214)] + [(3, None)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert_same(catalogue.queries()["image_sizes"](spark, str(tmp_path)), con, ORACLE["image_sizes"])

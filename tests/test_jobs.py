from strandline.operators import jobs
from strandline.sources import sinks


def test_states_and_claims(spark):
    j = spark.createDataFrame([(k,) for k in range(6)], "job_id long")
    rows = [(0, 0, 5, True, 1), (0, 6, 7, False, 2), (1, 95, None, None, 1), (2, 0, None, None, 1), (3, 0, 1, False, 1), (3, 2, 3, False, 2), (3, 4, None, None, 3)]
    a = spark.createDataFrame(rows, "job_id long, started_ms long, ended_ms long, ok boolean, attempt_seq long")
    s = jobs.job_states(j, a, now_ms=100, lease_ms=10)
    assert {r.job_id: (r.state, r.tries) for r in s.collect()} == {0: ("done", 2), 1: ("running", 1), 2: ("ready", 1), 3: ("quarantined", 3), 4: ("ready", 0), 5: ("ready", 0)}
    assert [(r.job_id, r.attempt_seq) for r in jobs.claim(s, 2, 100).collect()] == [(2, 2), (4, 1)]
    assert tuple(jobs.facts(s).first()) == (3, 1, 1)
    assert [r.attempt_seq for r in jobs.first_success(a).collect()] == [1]


def test_months(spark, tmp_path):
    day = 86_400_000
    df = spark.createDataFrame([(k * day, k) for k in (0, 40, 70)], "t long, x long")
    path = str(tmp_path / "m")
    sinks.write_months(df, path, "t")
    sinks.replace_months(spark.createDataFrame([(41 * day, 9)], "t long, x long"), path, "t")
    got = spark.read.parquet(path)
    assert sorted(r.x for r in got.collect()) == [0, 9, 70]
    plan = got.filter("year_month = '1970-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan
    assert sinks.response_json(df.limit(1).selectExpr("x", "null AS y"), "x", "y").first().json in ('{"x":0,"y":null}', '{"x":40,"y":null}', '{"x":70,"y":null}')

import pytest
import scenario as S

from hydrosight.plans.job import build
from hydrosight.sources.schemas import DIAGNOSTIC_COLUMNS, SUMMARY_COLUMNS, week_columns
from hydrosight.sources.testdata import Sources


@pytest.fixture(scope="module")
def job(spark):
    from rows import BILL_SCHEMA, PERSON_SCHEMA, RAW_READ_SCHEMA
    src = Sources(bills=spark.createDataFrame(S.BILLS, BILL_SCHEMA),
                  person=spark.createDataFrame(S.PEOPLE, PERSON_SCHEMA),
                  reads=spark.createDataFrame(S.READS, RAW_READ_SCHEMA))
    return src, build(spark, src)


def test_diagnostics(job):
    _, r = job
    row = r.diagnostics.first().asDict()
    assert list(row) == DIAGNOSTIC_COLUMNS
    assert row == S.EXPECTED_DIAGNOSTICS


def test_panel_has_every_candidate_and_week_27_is_out(job):
    _, r = job
    panel = {x["SP_ID"]: x for x in r.panel.collect()}
    assert sorted(panel) == ["SP1", "SP2", "SP4"]                     # T12: SP2 has no person
    for sp, (cov, days, ints, weeks) in S.EXPECTED_METRICS.items():
        p = panel[sp]
        assert (p["summer_drc_coverage_days"], p["summer_drc_above_3x_days"],
                p["summer_drc_above_3x_intervals"]) == (cov, days, ints)
        for w in week_columns(26):
            assert p[w] == weeks.get(w, 0.0)
    assert all(panel["SP2"][c] == 0.0 for c in week_columns(26))
    p1 = panel["SP1"]
    assert sum(p1[w] for w in week_columns(26)) == p1["summer_drc_above_3x_days"] - 1   # T1


def test_summary(job):
    _, r = job
    rows = r.summary.collect()
    assert r.summary.columns == SUMMARY_COLUMNS
    assert sorted((x["SP_ID"], x["PER_ID"], x["PHONE"]) for x in rows) == [
        ("SP1", "P1", "555"), ("SP1", "P2", "777"), ("SP4", "P4", "555")]
    sp1 = [x for x in rows if x["SP_ID"] == "SP1"][0]
    daily = 30 * S.C / 60
    assert sp1["summer_billed_daily_avg_kgal"] == round(daily, 4)
    assert sp1["summer_triple_billed_daily_avg_kgal"] == round(3 * daily, 4)
    assert sp1["summer_mean_normalized_30day_kgal"] == round(15 * S.C, 2)
    assert (sp1["summer_drc_coverage_days"], sp1["summer_drc_above_3x_intervals"]) == (6.0, 3.0)
    assert sp1["Type"] == "W" and sp1["summer_bill_count"] == 2.0 and sp1["winter_bill_count"] == 1.0


def test_reads_without_threshold_count_when_not_reduced(spark, job):
    src, _ = job
    r = build(spark, src, candidates_only=False)
    d = r.diagnostics.first().asDict()
    assert d["summer_overlap_without_billed_threshold_sp_ids"] == 1     # SP3
    assert d["summer_overlap_with_billed_threshold_sp_ids"] == 2
    panel = {x["SP_ID"]: x for x in r.panel.collect()}
    assert sorted(panel) == ["SP1", "SP2", "SP3", "SP4"]
    assert panel["SP3"]["summer_triple_billed_daily_avg_kgal"] is None
    assert panel["SP3"]["summer_drc_coverage_days"] == 2.0


def test_outputs_are_built_on_demand_and_tables_go(spark, job):
    import os
    src, _ = job
    r = build(spark, src)
    assert r.tables == []
    r.panel.count()
    assert len(r.tables) == 3                       # bills, candidates, one row a meter: no contact data
    assert r.report.count() == 17
    paths = [t.removeprefix("file:") for t in r.tables]
    assert all(os.path.isdir(p) for p in paths)
    r.release()
    assert not any(os.path.exists(p) for p in paths)


def test_report_scans_no_source_again(spark, job):
    src, _ = job
    r = build(spark, src)
    got = {x["metric"]: x["value"] for x in r.report.collect()}
    assert (got["consumption_rows"], got["person_rows"], got["drc_rows"]) == (len(S.BILLS), len(S.PEOPLE), len(S.READS))
    # the sources are in memory here; what the report reads of them lies in the job's tables
    leaves = [x for x in r.report._jdf.queryExecution().optimizedPlan().toString().splitlines()
              if "LogicalRDD" in x or "LocalRelation" in x]
    assert not any(c in x for x in leaves for c in ("BSEG_ID", "PER_ID", "CONSUMPTION"))


def test_no_reads_gives_zero_panel(spark, job):
    src, _ = job
    r = build(spark, Sources(bills=src.bills, person=src.person, reads=None))
    panel = r.panel.collect()
    assert len(panel) == 3
    assert all(x[c] == 0.0 for x in panel for c in week_columns(26) + ["summer_drc_coverage_days"])
    d = r.diagnostics.first().asDict()
    assert d["raw_drc_rows"] == 0 and d["candidate_sp_ids"] == 3 and d["summary_sp_ids"] == 2


def test_result_unchanged_by_partitioning(spark, job):
    src, r = job
    src2 = Sources(bills=src.bills.repartition(5), person=src.person.repartition(3),
                   reads=src.reads.repartition(7))
    r2 = build(spark, src2)
    for a, b in ((r.summary, r2.summary), (r.panel, r2.panel), (r.diagnostics, r2.diagnostics)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))

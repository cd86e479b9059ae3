"""Events of a batch are dealt out once, repeats and all."""

from datetime import datetime

from reefline.streaming import job_state


def test_events_of_a_batch_are_dealt_out_once(spark, monkeypatch, tmp_path):
    plans = []
    durable = job_state.durable
    monkeypatch.setattr(job_state, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or durable(df))
    at = datetime(2024, 1, 1)
    rows = [(1, at, 1, "capture", True), (2, at, 2, "capture", True), (1, at, 1, "capture", True), (2, at, 3, "failure", True)]
    run = job_state.fold_batch_of_events(str(tmp_path))
    run(spark.createDataFrame(rows, job_state.EVENTS), 0)
    run(spark.createDataFrame(rows[1:], job_state.EVENTS), 1)
    found = {r["source_document_id"]: (r["status"], r["attempts"]) for r in job_state.current_jobs(spark, str(tmp_path)).collect()}
    assert found == {1: ("leased", 1), 2: ("retrying", 1)}
    dealt = [line for line in plans[0].splitlines() if "Exchange" in line and "event_id" in line]
    assert len(dealt) == 1 and "rangepartitioning" in dealt[0]

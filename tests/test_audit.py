"""The audit log under retried jobs."""

from __future__ import annotations

import pytest

from spinlog.operators import audit


def lines(spark, n, outcome="executed"):
    rows = [(f"list {i}", None if i % 2 else "x", outcome) for i in range(n)]
    return audit.audit_rows(spark.createDataFrame(rows, "list_id string, name string, outcome string").selectExpr(
        "*", "timestamp_ntz'2024-03-01 10:00:00' as edited_at"), "rename", ["list_id", "name"])


def test_a_job_that_fails_before_its_commit_and_runs_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert audit.read_batches(spark, path).count() == 0
    with monkeypatch.context() as m:
        m.setattr(audit, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            audit.append_batch(lines(spark, 5), path, "day 1/a b")
    assert len(list((tmp_path / "log" / "lines").iterdir())) == 1 and audit.read_batches(spark, path).count() == 0
    assert audit.append_batch(lines(spark, 5), path, "day 1/a b")
    assert not audit.append_batch(lines(spark, 5), path, "day 1/a b")
    assert audit.append_batch(lines(spark, 3, "dry_run"), path, "day 2")
    assert audit.append_batch(lines(spark, 2), path, "x=y")
    got = audit.read_batches(spark, path)
    assert {(r["batch"], r["n"]) for r in got.groupBy("batch").count().withColumnRenamed("count", "n").collect()} == {
        ("day 1/a b", 5), ("day 2", 3), ("x=y", 2)}
    assert sorted(map(tuple, got.where("batch = 'day 1/a b'").drop("batch").collect()), key=repr) == sorted(map(tuple, lines(spark, 5).collect()), key=repr)


def test_two_attempts_that_both_commit_count_once(spark, tmp_path):
    path = str(tmp_path / "log")
    audit.append_batch(lines(spark, 4), path, "b")
    lines(spark, 4).write.json(f"{path}/lines/batch=b/attempt=zz")
    audit._commit(spark, path, "b", "zz")
    assert audit.read_batches(spark, path).count() == 4

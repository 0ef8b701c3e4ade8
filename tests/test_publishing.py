"""Snapshots become visible only after they have passed the gate."""

from __future__ import annotations

from datetime import date

import pytest
from conftest import AS_OF

from rentgrain.operators import publishing, quality
from rentgrain.operators.rewrites import plan_text

SOUND = dict(units=[{"unit_status": "occupied"}], payments=[{}, {}])


def test_a_broken_version_is_never_visible(spark, make, tmp_path):
    folder = str(tmp_path / "portfolio")
    with pytest.raises(publishing.NothingPublishedError):
        publishing.load_published(spark, folder)
    orphan = make(**SOUND | {"payments": [{}, {"lease_id": 9}, {"lease_id": 9}]})
    with pytest.raises(quality.QualityGateError, match="orphan_payments = 2"):
        publishing.publish_or_raise(orphan, AS_OF, folder, "a")
    with pytest.raises(publishing.NothingPublishedError):
        publishing.load_published(spark, folder)
    publishing.publish_or_raise(make(**SOUND), AS_OF, folder, "b")
    publishing.publish(orphan, date(2024, 5, 16), folder, "c")
    crowded = make(**SOUND | {"properties": [{}, {"property_id": 1}]})
    assert publishing.publish(crowded, date(2024, 5, 17), folder, "d").first()["repeated_properties"] == 1
    stored = publishing.load_published(spark, folder)
    assert stored.payments.count() == 2 and stored.properties.count() == 1
    verdicts = {r.version: r.status for r in spark.read.json(f"{folder}/verdicts").collect()}
    assert verdicts == {"a": "FAIL", "b": "PASS", "c": "FAIL", "d": "FAIL"}
    with pytest.raises(Exception, match="already exists"):
        publishing.publish(make(**SOUND), AS_OF, folder, "b")


def test_figures_come_from_the_jobs_that_write(spark, make, tmp_path):
    t = make(**SOUND | {"payments": [{"lease_id": k % 5} for k in range(400)]})
    found = publishing.write_version(t, AS_OF, str(tmp_path), "v")
    assert found["orphan_payments"] == 320 and found["table_rows"] == 407
    expected = quality.gate_findings(t, AS_OF).first().asDict()
    assert {k: found[k] for k in expected} == expected


def test_whole_rows_are_written_where_they_are_read(spark, make, tmp_path, monkeypatch):
    seen = {}
    write = publishing._written

    def watched(rows, path, *more):
        seen[path.rsplit("/", 1)[1]] = plan_text(rows)
        return write(rows, path, *more)

    monkeypatch.setattr(publishing, "_written", watched)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = make(**SOUND | {"payments": [{"due_date": date(2024, 1, 1 + k * 7 % 28)} for k in range(60)]})
        assert publishing.write_version(t, AS_OF, str(tmp_path), "v")["table_rows"] == 67
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "Exchange" not in seen["payments"] and "Join" not in seen["payments"]
    for part in (tmp_path / "version=v" / "payments").glob("*.parquet"):
        dates = [r.due_date for r in spark.read.parquet(str(part)).collect()]
        assert dates == sorted(dates)


def test_charges_of_a_repeated_lease_come_once_for_each(spark, make, tmp_path):
    t = make(**SOUND | {"leases": [{"lease_id": 1}] * 2, "payments": [{"lease_id": 1}, {"lease_id": None}, {"lease_id": 9}]})
    found = publishing.write_version(t, AS_OF, str(tmp_path), "v")
    assert found["orphan_payments"] == 2
    assert spark.read.parquet(str(tmp_path / "version=v" / "payments")).count() == 4

"""A directory of CSV logs whose files differ in their headers."""

import pytest

from caseflow.sources import csv as CSV

SCHEMA = "case_id string, activity string, timestamp string, resource string, cost double"


def _write(folder, name, text):
    (folder / name).write_bytes(text.encode())


@pytest.fixture
def folder(tmp_path):
    _write(tmp_path, "a one.csv", "case_id,activity,timestamp,cost\nA,a1,2024-01-01 00:00:00,1.5\nA,a2,2024-01-02 00:00:00,nan\n")
    _write(tmp_path, "b%20.csv", "activity,case_id,timestamp,resource\r\nb1,B,2024-01-03 00:00:00,\"x, y\"\r\n")
    _write(tmp_path, "c.csv", "\n﻿\"case_id\",activity,case_id,note,timestamp\nC,c1,wrong,n,2024-01-04 00:00:00\n".lstrip("\n"))
    _write(tmp_path, "d.csv", "case_id,activity,timestamp,cost\nD,d1,2024-01-05 00:00:00,2\n")
    _write(tmp_path, "empty.csv", "")
    _write(tmp_path, "only_header.csv", "timestamp,case_id,activity\n")
    return tmp_path


def test_each_file_is_read_by_its_own_header(spark, folder):
    out = CSV.read_event_csv(spark, f"file://{folder}", SCHEMA)
    assert sorted((r["case_id"], r["activity"], str(r["timestamp"])[:10], r["resource"], r["cost"]) for r in out.collect()) == [
        ("A", "a1", "2024-01-01", None, 1.5), ("A", "a2", "2024-01-02", None, None), ("B", "b1", "2024-01-03", "x, y", None),
        ("C", "c1", "2024-01-04", None, None), ("D", "d1", "2024-01-05", None, 2.0)]


def test_files_of_one_header_are_read_together(spark, folder):
    groups = CSV.file_headers(spark, f"file://{folder}")
    assert sorted(len(f) for f in groups.values()) == [1, 1, 1, 2]


def test_directory_without_rows(spark, tmp_path):
    _write(tmp_path, "empty.csv", "")
    out = CSV.read_event_csv(spark, f"file://{tmp_path}", SCHEMA)
    assert out.count() == 0 and out.columns == ["case_id", "activity", "timestamp", "resource", "cost"]


def test_day_first_files(spark, tmp_path):
    _write(tmp_path, "a.csv", "id;ts\n1;31/12/2023 10:00\n")
    _write(tmp_path, "b.csv", "ts;id\n01/02/2024 11:12:13;2\n")
    out = CSV.read_dayfirst_csv(spark, f"file://{tmp_path}", "id bigint, ts string", time_cols=("ts",))
    assert sorted((r["id"], str(r["ts"])) for r in out.collect()) == [(1, "2023-12-31 10:00:00"), (2, "2024-02-01 11:12:13")]

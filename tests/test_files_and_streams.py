"""File sources on small written files, and the log stream against its batch twin."""

import json

from pyspark.sql import functions as F

from tidegauge.operators import labels, review
from tidegauge.sources import files
from tidegauge.streaming import logs


def test_series_csv_and_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,other,value\n2024-01-01 00:00:00,x,1.5\n2024-01-01 00:01:00,x,bad\n,x,3\n")
    got = files.series_csv(spark, f"{tmp_path}/*.csv").select("value").collect()
    assert sorted(r.value or 0 for r in got) == [0, 1.5]
    found = files.inventory(spark, str(tmp_path), "*.csv").collect()
    assert [(r.file_name, r.size_bytes > 0) for r in found] == [("a.csv", True)]


def test_each_series_file_has_its_own_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,other,value\n2024-01-01 00:00:00,x,1.5\n2024-01-01 00:01:00,x,bad\n,x,3\n")
    (tmp_path / "b.csv").write_text('name, level ,Time\n"p, q",7,2024-01-02\nr,8,2024-01-03\n\n')
    (tmp_path / "c.csv").write_text("stamp,first,second\n2024-01-05,4,5\n")
    (tmp_path / "d.csv").write_text("time\n2024-01-06\n")
    (tmp_path / "e.csv").write_text("time,value\n")
    (tmp_path / "f.csv").write_text("")

    def got(numeric):
        rows = files.series_files(spark, f"{tmp_path}/*.csv", numeric).collect()
        return list((r.file[-5:-4], r.ts.day, r.value, r.raw) for r in rows)

    fixed = [("a", 1, 1.5, "1.5"), ("a", 1, None, "bad"), ("c", 5, 4.0, "4"), ("d", 6, None, "2024-01-06")]
    order = lambda rows: sorted(rows, key=str)
    assert order(got(True)) == order([*fixed, ("b", 2, 7.0, "7"), ("b", 3, 8.0, "8")])
    assert order(got(False)) == order([*fixed, ("b", 2, None, "p, q"), ("b", 3, None, "r")])


def test_json_lines_leave_out_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"input":"a"}\n\nnot json\n{"input":"b"}\n')
    got = files.json_lines(spark, str(tmp_path / "a.jsonl"), "input string").where("input is not null").collect()
    assert sorted(r.input for r in got) == ["a", "b"]


def test_annotation_folder_keeps_bad_files_apart(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"filename": "x"}')
    (tmp_path / "bad.json").write_text('{"filename": ')
    got = files.annotation_folder(spark, str(tmp_path), "filename string").cache()
    assert got.where("_corrupt_record is null").count() == 1 and got.count() == 2


def test_log_stream_equals_batch(spark, tmp_path):
    rows = [{"run": r, "step": s, "loss": 1 / (s + 1)} for r in "ab" for s in range(5)]
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(x) for x in rows[k::2]))
    stream = logs.latest_stream(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("latest_log")
    q = stream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = logs.latest(spark.read.schema(logs.SCHEMA).json(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("latest_log").collect())) == sorted(map(tuple, batch.collect()))


def test_joined_objects_and_unreadable_text(spark):
    one = '{"status":"ok","detected_anomalies":[{"interval":[1,2],"type":"a","reason":"r"}]}'
    d = spark.createDataFrame([(f"{one},{one}",), ("{broken",), (None,)], "t string")
    assert sorted(r.n for r in d.select(F.size(labels.parsed_anomalies(F.col("t"))).alias("n")).collect()) == [0, 0, 2]


def test_exponential_mean(spark):
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 3, 2])], "run string, step long, loss double")
    got = [r.smooth for r in review.smoothed(d, "run", "step", "loss").orderBy("step").collect()]
    from math import exp

    w = 1.8 * (1 / (1 + exp(-0.15)) - 0.5)
    want = [1.0, w + (1 - w) * 3]
    want.append(want[1] * w + (1 - w) * 2)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_batches_merge_once(spark, tmp_path):
    table = logs.LatestTable(spark, f"file://{tmp_path}/table")
    assert table.read().count() == 0
    (tmp_path / "in").mkdir()
    lines = lambda rows: "\n".join(json.dumps(dict(zip(("run", "step", "loss"), r))) for r in rows)
    for k, rows in enumerate(([("a", 1, 0.5), ("a", 3, 0.3), ("b", 2, 0.9)], [("a", 2, 0.4), ("c", 1, 0.1)])):
        (tmp_path / "in" / f"{k}.json").write_text(lines(rows))
        table.follow(f"file://{tmp_path}/in", f"file://{tmp_path}/ck").awaitTermination(120)
    state = lambda: sorted(tuple(r) for r in table.read().collect())
    assert state() == [("a", 3, 0.3, 3), ("b", 2, 0.9, 1), ("c", 1, 0.1, 1)]
    again = spark.createDataFrame([("a", 2, 0.4), ("c", 1, 0.1)], logs.SCHEMA)
    table.merge(again, 1)  # the last batch once more
    assert state() == [("a", 3, 0.3, 3), ("b", 2, 0.9, 1), ("c", 1, 0.1, 1)]
    table.merge(spark.createDataFrame([("b", 7, 0.2)], logs.SCHEMA), 2)
    assert state()[1] == ("b", 7, 0.2, 2)

"""Scans of lines and of large arrays: order and numbers of rows, in batches and streams."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertloom.sources import ingest, json_array
from alertloom.sources.alerts import read_alert_array
from alertloom.streaming import jobs


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "5000"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def write(folder, rng):
    want = []
    for f in range(20):
        lines = [f"file {f} line {k} {'x' * rng.randint(0, 40)}|" for k in range(rng.choice([0, 1, 50, 2500]))]
        (folder / f"f{f:02d}.log").write_bytes("".join(f"  {line} {end}" for line, end in zip(lines, ["\n", "\r\n", "\n\n"] * 900)).encode())
        want += lines
    return want


def test_lines_in_order(spark, tmp_path, small_splits):
    want = write(tmp_path, random.Random(1))
    lines = ingest.read_log_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 8
    rows = lines.orderBy("seq").collect()
    assert [r.record for r in rows] == want and len({r.seq for r in rows}) == len(want)
    plan = ingest.read_log_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Aggregate" not in plan and "hashpartitioning" not in plan


def test_too_many_files(spark, tmp_path, monkeypatch):
    write(tmp_path, random.Random(1))
    monkeypatch.setattr(ingest, "MOST_FILES", 3)
    with pytest.raises(ValueError, match="merge small files"):
        ingest.read_log_lines(spark, str(tmp_path))


def test_rows_in_splits():
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"file": f, "start": s} for f, s in rows])
    batches = [batch(("a", 0), ("a", 0)), batch(("a", 0), ("b", 0), ("b", 9), ("b", 9)), batch(("b", 9)), batch(("c", 9), ("a", 0))]
    got = [b.column("row").to_pylist() for b in ingest._with_row_in_split(iter(batches))]
    assert got == [[0, 1], [2, 0, 0, 1], [2], [0, 0]]


def test_equal_lines_of_a_stream_stay_apart(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    for f in range(3):
        (tmp_path / "in" / f"{f}.log").write_text("Jan  5 10:00:00 host proc[1]: from 10.0.0.1 the same\n" * 1500 + "\n\n")
    stream = jobs.normalized_stream(jobs.read_lines(spark, str(tmp_path / "in")))
    rows = jobs.batch_of(stream, str(tmp_path / "run"))
    assert rows.agg(F.count("*"), F.count_distinct("seq"), F.count_distinct("id")).first() == (4500, 4500, 4500)


def arrays(folder, rng):
    """Arrays of objects with braces, quotes and backslashes in strings, nested values and any white space between."""
    want = []
    for f in range(6):
        rows = []
        for k in range(rng.choice([0, 1, 30, 1500])):
            text = rng.choice(["a}b", 'say \\"}{\\"', "\\\\", "]", "[{", "é" * rng.randint(0, 300), ""])
            rows.append(f'{{"id":"{f}-{k}",{rng.choice(["", " ", chr(10)])}"message":"{text}","x":{{"y":[{{}},[1,{{"z":"}}"}}]]}}}}')
        gap = lambda: rng.choice(["", " ", "\n  ", "\r\n"])
        inner = "".join(("," if k else "") + gap() + r + gap() for k, r in enumerate(rows))
        (folder / f"f{f}.json").write_text(f"{gap()}[{inner}{gap()}]{gap()}", encoding="utf-8", newline="")
        want += rows
    return want


def test_elements_of_large_arrays(spark, tmp_path, small_splits):
    want = arrays(tmp_path, random.Random(2))
    rows = json_array.read_array_elements(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.record for r in rows] == want and len({r.seq for r in rows}) == len(want) > 1000
    # a piece per task is far less than a file
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert pieces.rdd.getNumPartitions() >= 10


@pytest.mark.parametrize(
    "text",
    ["  \n", "{}", '{"a":1}', '[{"a":1}', '[{"a":1}]]', '[{"a":1}] x', "[1]", '[{"a":1},2]', '[{"a":1},,{"a":2}]', '[{"a":1} {"a":2}]',
     '[{"a":1},]', '["x"]', '[[{"a":1}]]', '[{"a":"}]', 'x[{"a":1}]', '[,{"a":1}]', "[null]"],
)
def test_no_arrays_of_objects(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        json_array.read_array_elements(spark, str(tmp_path)).collect()


def test_alert_fields_have_to_fit(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"1","severity":3},{"id":"2","severity":3.7}]')
    with pytest.raises(Exception):
        read_alert_array(spark, str(tmp_path)).collect()
    (tmp_path / "a.json").write_text('[{"id":"1","severity":3}]')
    assert [r.id for r in read_alert_array(spark, str(tmp_path)).collect()] == ["1"]


def test_files_of_blobs_share_folders(spark, tmp_path):
    """Each blob is a file of its own, files are in the order of the blobs' names, and folders are far fewer than files."""
    from pyspark.sql import functions as F

    from alertloom import fixtures
    from alertloom.sources.ingest import read_blobs

    names = spark.range(350).select(F.format_string("f%06d", "id").alias("file"), F.concat(F.lit("a\nb"), "id").alias("blob"))
    path = fixtures.write_files(names.repartition(5), str(tmp_path / "files"))
    got = read_blobs(spark, path).select("file_no", "blob").collect()
    assert sorted((r.file_no, r.blob.strip()) for r in got) == [(k, f"a\nb{k}") for k in range(350)]
    assert len([p for p in (tmp_path / "files").iterdir() if p.is_dir()]) == 4


def test_alert_files_take_as_many_tasks_as_the_session_deals(spark):
    """Files of the streams' input are in order of the alerts, and not of a fixed number."""
    from pyspark.sql import functions as F

    from alertloom import queries

    wanted = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        path = queries._alert_files(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name")).agg(F.min("seq"), F.max("seq")).orderBy("file_name").collect()
    assert len(files) == 7 and all(a[2] < b[1] for a, b in zip(files, files[1:]))

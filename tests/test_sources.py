import gzip
import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.sources import jsonl


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a"), (2, "b\n"), (3, None)], "id long, text string")


def schema(ddl):
    return StructType.fromDDL(ddl)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_what_is_written_is_read(spark, rows, tmp_path):
    path = f"{tmp_path}/out"
    assert jsonl.write_atomic(rows, path) == 3
    assert got(jsonl.read(spark, path, rows.schema)) == [(1, "a"), (2, "b\n"), (3, None)]
    jsonl.append(rows.limit(1), path)
    assert jsonl.read(spark, path, rows.schema).count() == 4
    with pytest.raises(FileExistsError):
        jsonl.write_atomic(rows, path)
    assert jsonl.write_atomic(rows.limit(2), path, overwrite=True) == 2
    assert jsonl.read(spark, path, rows.schema).count() == 2 and not (tmp_path / "out.old").exists()


@pytest.mark.parametrize("line", ["{not json", "[1]", "3", '{"id": "x"}'])
def test_a_malformed_line_raises_whatever_is_selected(spark, rows, tmp_path, line):
    (tmp_path / "in.jsonl").write_text('{"id": 1, "text": "a"}\n\n' + line + "\n")
    strict = jsonl.read(spark, f"{tmp_path}/in.jsonl", rows.schema)
    for df in (strict, strict.select("text"), strict.select("id"), strict.groupBy().agg(F.count("*"))):
        with pytest.raises(Exception, match="malformed record in in.jsonl"):
            df.collect()
    kept = jsonl.read(spark, f"{tmp_path}/in.jsonl", rows.schema, strict=False).collect()
    assert len(kept) == 2 and kept[0]["id"] == 1 and kept[1][jsonl.CORRUPT] == line


def test_a_failure_keeps_what_was_there(spark, rows, tmp_path, monkeypatch):
    path = f"{tmp_path}/out"
    jsonl.write_atomic(rows, path)
    with pytest.raises(Exception, match="broken"):
        jsonl.write_atomic(rows.withColumn("text", F.raise_error(F.lit("broken")).cast("string")), path, overwrite=True)
    assert jsonl.read(spark, path, rows.schema).count() == 3
    rename, calls = jsonl._rename, []

    def lost(fs, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise OSError("lost between the renames")
        rename(fs, source, target)

    monkeypatch.setattr(jsonl, "_rename", lost)
    with pytest.raises(OSError, match="lost"):
        jsonl.write_atomic(rows.limit(1), path, overwrite=True)
    assert got(jsonl.read(spark, path, rows.schema)) == [(1, "a"), (2, "b\n"), (3, None)]


@pytest.fixture
def split(spark):
    """Reads of many small blocks."""
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


RECORD = "id long, text string"


def folder(tmp_path, broken=()):
    """Three files (one gzip, odd names) with blank lines, long lines and a missing last line end."""
    top = tmp_path / "in put%"
    top.mkdir()
    every = []
    for f, name in enumerate(("b.jsonl", "a [1].jsonl", "c.jsonl.gz")):
        lines = []
        for i in range(400):
            text = "é" * (900 if i == 77 else i % 9)
            line = "  " if i % 7 == 3 else json.dumps({"id": f * 1000 + i, "text": text}, ensure_ascii=False)
            lines.append("{oops" if (name, i + 1) in broken else line)
        data = "\n".join(lines).encode()
        (top / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        every.append((name, lines))
    return str(top), sorted(every)


def test_lines_have_their_number_however_files_are_split(spark, split, tmp_path):
    path, every = folder(tmp_path)
    rows = jsonl.numbered(spark, path)
    assert rows.rdd.getNumPartitions() > 20
    found = rows.select(F.url_decode(F.element_at(F.split("file", "/"), -1)), "line", "value").collect()
    assert sorted(map(tuple, found)) == sorted((name, i, line) for name, lines in every for i, line in enumerate(lines, 1))
    tasks = jsonl._lines(spark, path).groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 20 and tasks.agg(F.max("count")).first()[0] <= 400  # only the gzip file is one block


@pytest.mark.parametrize(("name", "line"), [("b.jsonl", 1), ("b.jsonl", 400), ("a [1].jsonl", 222), ("c.jsonl.gz", 321)])
def test_a_malformed_line_is_named_with_file_and_line(spark, split, tmp_path, name, line):
    path, _ = folder(tmp_path, {(name, line)})
    for df in (jsonl.read(spark, path, schema(RECORD)), jsonl.read(spark, path, schema(RECORD)).select("text")):
        with pytest.raises(Exception, match=re.escape(f"malformed record in {name}:{line}: {{oops")):
            df.collect()
    with pytest.raises(Exception, match=re.escape(f"malformed record in {name}: {{oops")):
        jsonl.read(spark, path, schema(RECORD), numbers=False).collect()


@pytest.mark.parametrize("n", [0, 1, 5, 342, 343, 344, 700, 1029, 5000])
def test_the_first_records_equal_a_loop(spark, split, tmp_path, n):
    path, every = folder(tmp_path)
    want = [json.loads(x) for _, lines in every for x in lines if x.strip()][:n]
    rows = jsonl.first(spark, path, schema(RECORD), n)
    assert [tuple(r) for r in rows.orderBy("ordinal").collect()] == [(r["id"], r["text"], i) for i, r in enumerate(want)]
    opened = {f.rsplit("/", 1)[-1] for f in rows.inputFiles()}
    assert len(opened) == (0 if n == 0 else 1 if n <= 343 else 2 if n <= 686 else 3), opened


def test_what_lies_behind_the_first_records_is_not_parsed(spark, split, tmp_path):
    path, _ = folder(tmp_path, {("c.jsonl.gz", 1), ("b.jsonl", 300)})
    assert jsonl.first(spark, path, schema(RECORD), 500).count() == 500
    with pytest.raises(Exception, match="b.jsonl:300"):
        jsonl.first(spark, path, schema(RECORD), 650).collect()

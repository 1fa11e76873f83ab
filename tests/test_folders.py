"""Folders of documents as a data source: files opened under filters, bad documents, and the stream over restarts."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull
from pyspark.sql.types import StructType

from spindrift.sources import folders

SCHEMA = "name string, title string, seconds double, n long, stages string"


def put(base, name, value, file="manifest.json"):
    (base / name).mkdir(parents=True, exist_ok=True)
    (base / name / file).write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def read(spark, base, **options):
    folders.register(spark)
    reader = spark.read.format("document_folders").schema(SCHEMA).option("path", f"{base}").option("file", "manifest.json")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_documents(spark, tmp_path):
    put(tmp_path, "a1", {"title": "房價", "seconds": 3, "n": 4.0, "stages": {"s1": [1]}, "other": 1})
    put(tmp_path, "a2", "{broken")
    put(tmp_path, "a3", [1])
    put(tmp_path, "a4", {"n": 1.5})
    put(tmp_path, "b1", {"title": None})
    put(tmp_path, "b2", {"title": "unread"}, "other.json")
    (tmp_path / "file.json").write_text("{}")
    got = sorted(map(tuple, read(spark, tmp_path).collect()))
    assert got == [("a1", "房價", 3.0, 4, '{"s1": [1]}'), ("b1", None, None, None, None)]
    with pytest.raises(Exception, match="a[234]/manifest.json"):
        read(spark, tmp_path, strict="true").collect()
    assert read(spark, tmp_path / "none").count() == 0


def test_filters_on_the_folder_open_no_other(spark, tmp_path):
    for k in range(30):
        put(tmp_path, f"r{k:02}", {"title": str(k)} if k in (3, 4, 12) else "{broken")  # opening another one is an error
    whole = read(spark, tmp_path, strict="true", files_of_task="2")
    assert [r.title for r in whole.where("name = 'r03'").collect()] == ["3"]
    assert sorted(r.title for r in whole.where("name IN ('r03', 'r12', 'zz') AND title > '1'").collect()) == ["12", "3"]
    assert sorted(r.title for r in whole.where("name >= 'r03' AND name < 'r05'").collect()) == ["3", "4"]
    assert whole.where(F.col("name").startswith("r1") & F.col("name").isin("r12")).count() == 1
    with pytest.raises(Exception, match="manifest.json"):
        whole.where("title = '3'").collect()
    reader = folders.FolderReader({"path": str(tmp_path), "file": "manifest.json", "files_of_task": "1"}, StructType.fromDDL(SCHEMA))
    left = IsNotNull(("name",))
    assert list(reader.pushFilters([left, In(("name",), ("r03", "r04", "r12")), EqualTo(("title",), "x")]))[0] is left
    assert [p.files[0][0] for p in reader.partitions()] == ["r03", "r04", "r12"]  # a file to a task


def test_stream_takes_each_file_once(spark, tmp_path):
    base, out = tmp_path / "in", f"{tmp_path}/out"
    folders.register(spark)

    def run():
        stream = spark.readStream.format("document_folders").schema(SCHEMA).option("path", str(base)).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start().awaitTermination()
        return sorted(r.title for r in spark.read.parquet(out).collect())

    put(base, "x", {"title": "one"})
    put(base, "y", {"title": "two"})
    assert run() == ["one", "two"]
    put(base, "x", {"title": "three"}, "later.json")
    assert run() == ["one", "three", "two"]
    assert run() == ["one", "three", "two"]

"""The pretty document: whole or not there, by case, and read again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from orrery.sources import json_document as j

SCHEMA = "id long, text string, parts array<struct<a: long, b: string>>"


def rows(spark, ids):
    made = [(i, f"text é {i}" if i % 3 else None, [(i, "x"), (None, "y")]) for i in ids]
    return spark.createDataFrame(made, SCHEMA).repartition(3, "id")


def test_one_pretty_document_read_again(spark, tmp_path):
    path, df = str(tmp_path / "out"), rows(spark, range(20))
    assert j.read_document(spark, path, SCHEMA).count() == 0
    j.sink_document(df, path)
    text = open(f"{path}/document.json", encoding="utf-8").read()
    held = json.loads(text)
    assert text == json.dumps(held, ensure_ascii=False, indent=2) + "\n" and "é" in text
    assert sorted(r["id"] for r in held) == list(range(20)) and next(r for r in held if r["id"] == 4)["parts"] == [{"a": 4, "b": "x"}, {"a": None, "b": "y"}]
    got = j.read_document(spark, path, "id long, text string").orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [(r.id, r.text) for r in df.orderBy("id").collect()]
    j.sink_document(rows(spark, range(3)), path)  # in place of what was there
    assert j.read_document(spark, path, "id long").count() == 3 and len(json.load(open(f"{path}/document.json"))) == 3
    j.sink_document(rows(spark, []), path)
    assert open(f"{path}/document.json").read() == "[]\n" and j.read_document(spark, path, "id long").count() == 0


def test_cases_stand_side_by_side(spark, tmp_path):
    path = str(tmp_path / "out")
    for case, ids in (("a", [1, 2]), ("b", [3]), ("a", [4])):
        j.sink_document(rows(spark, ids), path, case)
    assert sorted(r["id"] for r in json.load(open(f"{path}/document.json"))) == [3, 4]
    assert sorted(r.id for r in j.read_document(spark, path, "id long").collect()) == [3, 4]
    assert len(os.listdir(f"{path}/parts")) == len(json.load(open(f"{path}/manifest.json")))


def test_a_failed_attempt_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "out")
    j.sink_document(rows(spark, [1, 2]), path)
    before = {n: open(f"{path}/{n}").read() for n in ("document.json", "manifest.json")}
    bad = rows(spark, range(30)).withColumn("id", F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        j.sink_document(bad, path)
    assert {n: open(f"{path}/{n}").read() for n in before} == before
    assert sorted(r.id for r in j.read_document(spark, path, "id long").collect()) == [1, 2]
    assert len(os.listdir(f"{path}/parts")) == len(json.loads(before["manifest.json"]))

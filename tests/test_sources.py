"""Readers and writers on temporary folders."""

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers as R
from weftline.sources import writers as K
from weftline.streaming import sessions as S


def test_json_map_and_nan(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"b": {"x": NaN, "n": "NaN"}, "a": {"x": 2.5, "n": "é"}}')
    rows = R.json_map(spark, str(tmp_path / "m.json"), "struct<x: double, n: string>").orderBy("pos").collect()
    assert [(r.key, r.value.x, r.value.n) for r in rows] == [("b", None, "NaN"), ("a", 2.5, "é")]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": \n{"id": "2"}\n')
    assert R.processed_ids(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(Exception):
        R.jsonl(spark, str(tmp_path / "a.jsonl"), "id string").collect()
    assert R.json_array(spark, str(tmp_path / "none.json"), "id string").count() == 0


def test_numbered_sources(spark, tmp_path):
    for name, v in (("base.jsonl", 1), ("x_retry2.jsonl", 2), ("x_retry10.jsonl", 3)):
        (tmp_path / name).write_text(f'{{"id": "k", "v": {v}}}\n')
    rows = {r.v: r.source_rank for r in R.numbered(spark, str(tmp_path / "*.jsonl"), "id string, v int").collect()}
    assert rows == {1: 0, 2: 2, 3: 10}


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text('item_id,title\n1,"a, b"\n,x\n')
    assert [r.title for r in R.catalogue(spark, str(tmp_path / "c.csv")).collect()] == ["a, b"]
    with pytest.raises(ValueError):
        R.catalogue(spark, str(tmp_path / "c.csv"), "other")


def test_checkpoints(spark, tmp_path):
    for n in ("checkpoint-5", "checkpoint-10", "checkpoint-20", "other"):
        (tmp_path / n).mkdir()
    assert [r.step for r in R.checkpoints(spark, str(tmp_path), stride=10, high=20).collect()] == [10, 20]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    K.write_quarantined(df, "ok", str(tmp_path / "v"), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1
    K.write_quarantined(df.filter("ok"), "ok", str(tmp_path / "v"), str(tmp_path / "f"))
    assert not (tmp_path / "f").exists()
    assert [K.write_versioned(df, str(tmp_path / "w")) for _ in range(2)] == [1, 2]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.json").write_text("[]")
    (tmp_path / "e" / "b.json").write_text("[1]")
    (tmp_path / "e" / "c.json").write_text("")
    assert sorted(r.name for r in K.empty_artefacts(spark, str(tmp_path / "e"), remove=True).collect()) == ["a.json", "c.json"]
    assert not (tmp_path / "e" / "a.json").exists()
    K.write_partitioned(df.withColumn("variant", F.col("ok").cast("string")), str(tmp_path / "p"), "variant")
    assert (tmp_path / "p" / "variant=true").exists()


def test_streams(spark, tmp_path):
    events = S.event_stream(spark, "/root/testdata/sf0.001/events.parquet*")
    S.run_once(S.windowed_counts(events), "windows", "complete", str(tmp_path / "c"))
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert spark.table("windows").agg(F.sum("n")).first()[0] == batch.count()


def test_document_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("é", 1.5, None), ('q"', None, "x\ny"), ("z", float("nan"), "")], "k string, x double, t string").withColumn("v", F.struct("x", "t"))
    K.write_document(rows, str(tmp_path / "d"), "k", "v")
    back = R.json_map(spark, str(tmp_path / "d"), "struct<x: double, t: string>")
    assert {(r.key, r.value.x, r.value.t) for r in back.collect()} == {("é", 1.5, None), ('q"', None, "x\ny"), ("z", None, "")}
    K.write_document(rows.limit(0), str(tmp_path / "e"), "k", "v")
    assert R.json_map(spark, str(tmp_path / "e"), "struct<x: double, t: string>").count() == 0
    K.write_document(rows.select("k", F.lit(None).cast("string").alias("v")), str(tmp_path / "n"), "k", "v")
    assert R.json_map(spark, str(tmp_path / "n"), "string").filter("value is null").count() == 3


def test_report(spark):
    text = K.report(spark.createDataFrame([("a", 1)], "name string, n int"), "Counts")
    assert text.startswith("Counts") and "|a   |1  |" in text


def test_catalogue_skips_spelt_out_nulls(spark, tmp_path):
    (tmp_path / "c.csv").write_text("item_id,title\n1,a\n nan ,b\nNone,c\n2.0,d\n")
    assert [r.title for r in R.catalogue(spark, str(tmp_path / "c.csv")).collect()] == ["a", "d"]


def test_checkpoints_are_written_by_many_tasks(spark, tmp_path):
    """Few bytes in many folders: adaptive execution would have one task write them all."""
    rows = spark.range(60).select("id", F.concat(F.lit("checkpoint-"), F.col("id").cast("string")).alias("name"))
    K.write_checkpoints(rows, "name", str(tmp_path / "at"))
    found = R.checkpoints(spark, str(tmp_path / "at"))
    assert sorted(r.step for r in found.collect()) == list(range(60))
    assert sorted((r.step, r.id) for r in R.checkpoint_rows(spark, found, "id long").collect()) == [(k, k) for k in range(60)]
    writers = {p.name.split("-")[1] for p in (tmp_path / "at").glob("checkpoint-*/part-*")}
    assert len(writers) >= 4 and not (tmp_path / "at" / ".parts").exists()
    (tmp_path / "at" / "x,y").mkdir()
    assert len(R.children(spark, str(tmp_path / "at"))) == 61 and R.children(spark, str(tmp_path / "at" / "x,y")) == []


def orders_of(spark, path, customers):
    spark.createDataFrame([(i, c) for i, c in enumerate(customers)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_checkpoint_listing_reads_every_order(spark, tmp_path):
    """Customers off the stride of ten and below twenty count too."""
    from weftline.plans.catalog import QUERIES

    got = QUERIES["checkpoint_listing"](spark, orders_of(spark, tmp_path, [1, 7, 10, 20, 25, 25])).collect()
    assert sorted((r.step, r.n) for r in got) == [(1, 1), (7, 1), (10, 1), (20, 1), (25, 2)]


def test_checkpoint_listing_has_bounded_folders(spark, tmp_path, monkeypatch):
    """More customers than folders, with one missing and one below zero: no folder a customer, no order lost."""
    from weftline.plans import catalog_tables as C
    from weftline.plans.catalog import QUERIES

    monkeypatch.setattr(C.folds, "shared", lambda spark: str(tmp_path / "at"))
    customers = [*range(2 * C.CHECKPOINTS), -3, None, None]
    got = QUERIES["checkpoint_listing"](spark, orders_of(spark, tmp_path, customers)).collect()
    assert {r.step: r.n for r in got} == {**{c: 1 for c in range(2 * C.CHECKPOINTS)}, -3: 1, None: 2} and len(got) == 2 * C.CHECKPOINTS + 2
    assert len(list((tmp_path / "at").glob("checkpoint-*[0-9]"))) == C.CHECKPOINTS

"""Exactly-once ingestion and pipeline stages."""

import base64
import json

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tallybook.operators.stages import ChatMessages, CompletionContent, FlattenUpdates
from tallybook.streaming import once


def body(n):
    text = json.dumps({"Step": n, "Type": "PAYMENT", "Amount": n / 2, "NameOrig": f"C{n}"})
    return base64.b64encode((text + " " * (2 - len(text) % 3)).encode()) if n % 4 == 1 else text.encode()


BAD = [b"broken {", b"", None, b'{"Step": "not a number"}', b"[1, 2", "é\x00".encode()]


@pytest.fixture
def folders(spark, tmp_path):
    names = ("in", "good", "bad", "state")
    paths = {n: str(tmp_path / n) for n in names}
    rows = [(bytearray(body(n)),) for n in range(40)] + [(None if b is None else bytearray(b),) for b in BAD]
    spark.createDataFrame(rows, "body binary").repartition(8).write.parquet(paths["in"])
    return paths


def run(spark, f, **how):
    query = once.ingest_once(spark, f["in"], f["good"], f["bad"], f["state"], max_files=2, **how)
    query.awaitTermination()


def check(spark, f, expected=tuple(range(40))):
    good, bad = spark.read.parquet(f["good"]), spark.read.parquet(f["bad"])
    assert sorted(r.Step for r in good.collect()) == sorted(expected)
    assert sorted(str(r.body) for r in bad.collect()) == sorted(str(None if b is None else b.decode()) for b in BAD)
    assert bad.select("source_file", "source_row").distinct().count() == len(BAD) and bad.where("reason is null").count() == 0


def test_every_row_once(spark, folders):
    run(spark, folders)
    check(spark, folders)
    run(spark, folders)
    check(spark, folders)


@pytest.mark.parametrize("stopped_at", [0, 2])
def test_stop_between_write_and_commit(spark, folders, stopped_at):
    def stop(batch_id):
        if batch_id == stopped_at:
            raise RuntimeError("stopped here")

    with pytest.raises(Exception, match="stopped here"):
        run(spark, folders, after_write=stop)
    written = spark.read.parquet(folders["good"]).count()
    assert written > 0
    run(spark, folders)
    check(spark, folders)


def test_half_written_batch_is_replaced(spark, folders, monkeypatch):
    """The query stops after the rejected bodies of a batch, before its events."""
    real = once.replace

    def half(rows, root, query_id, batch_id):
        if root == folders["good"] and batch_id == 1:
            raise RuntimeError("disk gone")
        real(rows, root, query_id, batch_id)

    monkeypatch.setattr(once, "replace", half)
    with pytest.raises(Exception, match="disk gone"):
        run(spark, folders)
    monkeypatch.setattr(once, "replace", real)
    run(spark, folders)
    check(spark, folders)


def test_new_query_does_not_touch_older_batches(spark, folders, tmp_path):
    run(spark, folders)
    more = folders | {"in": str(tmp_path / "more"), "state": str(tmp_path / "state2")}
    spark.createDataFrame([(bytearray(body(100)),)], "body binary").write.parquet(more["in"])
    run(spark, more)
    check(spark, folders, [*range(40), 100])


def test_stages_save_and_load(spark, tmp_path):
    rows = spark.createDataFrame([(1, "some text", "kept"), (2, None, "kept")], "id int, body string, `odd name` string")
    pipeline = Pipeline(stages=[ChatMessages(inputCol="body", outputCol="m", instruction="Say it."), ChatMessages(inputCol="odd name", outputCol="n", instruction="Again.")])
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    model = Pipeline.load(str(tmp_path / "pipeline")).fit(rows)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    first, second = (m.transform(rows).orderBy("id").collect() for m in (model, again))
    assert first == second and [x.content for x in first[0].m] == ["Say it.", "some text"] and [x.content for x in first[1].m] == ["Say it.", None]
    assert [x.role for x in first[0].n] == ["system", "user"] and model.transform(rows).columns == ["id", "body", "odd name", "m", "n"]
    stage = ChatMessages.load(str(save(ChatMessages(instruction="x"), tmp_path)))
    assert (stage.getInputCol(), stage.getOutputCol(), stage.getOrDefault("instruction")) == ("text", "messages", "x")


def save(stage, folder):
    stage.write().overwrite().save(str(folder / "stage"))
    return folder / "stage"


def test_stages_chain_to_rows(spark):
    content = '{"date": "May",\n "updates": [{"item": "a", "n": 1}, {"item": "b", "n": null}]}'
    choices = F.struct(F.array(F.struct(F.struct(F.lit(content).alias("content")).alias("message"))).alias("choices"))
    rows = spark.range(1).select("id", choices.alias("completions"))
    read = CompletionContent(schema="date string, updates array<struct<item: string, n: int>>").transform(rows)
    flat = FlattenUpdates().transform(read.select("id", "content.updates"))
    assert [tuple(r) for r in flat.collect()] == [(0, "a", 1), (0, "b", None)]


def test_stages_say_what_is_wrong(spark):
    rows = spark.createDataFrame([(1, "t")], "id int, text string")
    for stage in (ChatMessages(inputCol="none"), ChatMessages(outputCol="id"), FlattenUpdates(inputCol="text")):
        with pytest.raises(ValueError):
            stage.transform(rows)
    clash = rows.select("id", F.array(F.struct(F.lit(1).alias("id"))).alias("updates"))
    with pytest.raises(ValueError):
        FlattenUpdates().transform(clash)

"""Ingestion with statuses: a broken file, a restart in the middle of a batch, and a retry."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from forestflux.streaming import granules as G

SCHEMA = "record long, value double"


def put(folder, name, first, n=3):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"record": pa.array(range(first, first + n)), "value": [0.5] * n}), folder / name)


@pytest.fixture
def place(tmp_path):
    return {"source": str(tmp_path / "in"), "target": str(tmp_path / "out"), "status": str(tmp_path / "status")}, tmp_path


def run(spark, place, tmp_path, **more):
    G.ingest(spark, **place, checkpoint=str(tmp_path / "checkpoint"), schema=SCHEMA, **more).awaitTermination()


def outcome(spark, place):
    told = sorted((r.path.rsplit("/", 1)[1], r.status, r.run) for r in G.statuses(spark, place["status"]).collect())
    return told, sorted(r.record for r in G.converted(spark, place["target"], place["status"], SCHEMA).collect())


def test_broken_file_and_retry(spark, place):
    place, tmp = place
    put(tmp / "in", "a.parquet", 0)
    put(tmp / "in", "b.parquet", 10)
    (tmp / "in" / "broken.parquet").write_bytes(b"no parquet")
    (tmp / "in" / "notes.xml").write_text("not a granule")
    run(spark, place, tmp)
    told, rows = outcome(spark, place)
    assert told == [("a.parquet", "converted", "batch-0"), ("b.parquet", "converted", "batch-0"), ("broken.parquet", "failed", "batch-0")] and rows == [0, 1, 2, 10, 11, 12]
    assert G.statuses(spark, place["status"]).where("status = 'failed'").first().message
    put(tmp / "in", "c.parquet", 20)
    run(spark, place, tmp)  # the new one only
    assert outcome(spark, place)[0][-1] == ("c.parquet", "converted", "batch-1") and len(outcome(spark, place)[1]) == 9
    assert G.retry_failed(spark, place["target"], place["status"], SCHEMA) == 1  # still broken
    put(tmp / "in", "broken.parquet", 30)
    assert G.retry_failed(spark, place["target"], place["status"], SCHEMA) == 1
    assert G.retry_failed(spark, place["target"], place["status"], SCHEMA) == 0
    assert outcome(spark, place)[1] == [0, 1, 2, 10, 11, 12, 20, 21, 22, 30, 31, 32]


def test_restart_in_the_middle_of_a_batch(spark, place, monkeypatch):
    """The first try dies when its rows are written and its statuses are not."""
    place, tmp = place
    put(tmp / "in", "a.parquet", 0)
    whole = G.convert

    def dies(files, run, target, status, *rest):
        whole(files, run, target, str(tmp / "elsewhere"), *rest)
        raise RuntimeError("lost")

    monkeypatch.setattr(G, "convert", dies)
    with pytest.raises(Exception, match="lost"):
        run(spark, place, tmp)
    assert outcome(spark, place) == ([], [])
    monkeypatch.setattr(G, "convert", whole)
    run(spark, place, tmp)
    assert outcome(spark, place) == ([("a.parquet", "converted", "batch-0")], [0, 1, 2])


def test_files_that_are_there_already_are_skipped(spark, place):
    place, tmp = place
    put(tmp / "in", "a.parquet", 0)
    run(spark, place, tmp)
    G.ingest(spark, **place, checkpoint=str(tmp / "other"), schema=SCHEMA).awaitTermination()  # a stream that has forgotten; same run name, same batch
    files = spark.read.format("binaryFile").load(place["source"])
    G.convert(files, "again", place["target"], place["status"], SCHEMA)
    told, rows = outcome(spark, place)
    assert ("a.parquet", "skipped", "again") in told and rows == [0, 1, 2]

"""Streams against batch reads of the same files; model boundaries with models made up here."""

import json

import pytest
from pyspark.sql import functions as F

from docsafe.operators import engines
from docsafe.sources import files
from docsafe.streaming import jobs

SHAPE = "ts timestamp, stage string, ms double, fingerprint string"


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    at = lambda h, m, stage, ms: f'{{"ts": "2024-01-01T{h:02}:{m:02}:00", "stage": "{stage}", "ms": {ms}, "fingerprint": "f"}}'
    (folder / "a.log").write_text("\n".join([at(1, 0, "read", 1.0), at(1, 10, "read", 3.0), "", "text", "{bad", at(1, 50, "write", 5.0)]))
    (folder / "b.log").write_text("\n".join([at(9, 0, "read", 7.0), "[1]"]))
    return str(folder)


def drained(stream, tmp_path, name):
    out = str(tmp_path / name)
    jobs.start(stream, out, name, str(tmp_path / "cp"), once=True).awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_log_lines(spark, logs, tmp_path):
    got = drained(jobs.log_events(spark, logs, SHAPE), tmp_path, "events")
    want = files.log_events(spark, logs, SHAPE)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 4


def test_windows_close_behind_the_watermark(spark, logs, tmp_path):
    stats = drained(jobs.stage_stats(jobs.log_events(spark, logs, SHAPE, 1)), tmp_path, "stats")
    assert sorted((r["stage"], r["n"], r["total"]) for r in stats.collect()) == [("read", 2, 4.0), ("write", 1, 5.0)]
    runs = drained(jobs.sessions(jobs.log_events(spark, logs, SHAPE, 1), "fingerprint"), tmp_path, "runs")
    assert sorted((r["n"], r["total"]) for r in runs.collect()) == [(1, 5.0), (2, 4.0)]


def test_a_stream_needs_a_checkpoint(spark, logs, tmp_path):
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            jobs.start(jobs.log_events(spark, logs, SHAPE), str(tmp_path / "x"), "x")


class Length:
    def read(self, images):
        if any(i == b"bad" for i in images):
            raise RuntimeError
        return [(f"{len(i)}", 0.5) for i in images]

    def detect(self, image):
        return {"dt_polys": [[[0, 0], [1, 0], [1, 1], [0, 1]]], "dt_scores": []}


def test_recognisers(spark):
    crops = spark.createDataFrame([("p0-0", b"abc"), ("p0-1", b"abc"), ("p0-2", b"bad"), ("p0-3", None)], "crop_id string, image binary")
    got = {r["crop_id"]: (r["text"], r["confidence"], r["error_code"]) for r in engines.recognise(crops, Length).collect()}
    assert got == {"p0-0": ("3", 0.5, None), "p0-1": ("3", 0.5, None), "p0-2": ("", 0.0, "recognition_failed:RuntimeError"), "p0-3": ("", 0.0, "empty_image")}
    v = engines.variants(crops.where("crop_id = 'p0-0'"), lambda w: Length).first()["variants"]
    assert [(x["text"], x["width"]) for x in v] == [("3", 288), ("3", 320), ("3", 384)]


def test_detectors_and_verifiers(spark):
    pages = spark.createDataFrame([(0, b"x")], "page_index long, image binary")
    assert files.detector_polygons(engines.detect(pages, Length)).select("polygon", "score").first()[:] == (0, 1.0)
    assert engines.verify(pages, ["cat"]).first()[:] == (0, "x", None)
    assert engines.verify(pages, ["no-such-command"]).first()["error_code"] == "tesseract_unavailable" and engines.verify(pages, ["false"]).first()["error_code"] == "tesseract_failed"


def test_payloads(spark):
    p = spark.createDataFrame([("a", '{"res": {"rec_text": " x  y ", "rec_score": 0.5}}'), ("b", '{"rec_text": "z"}'), ("c", "bad")], "crop_id string, payload string")
    assert [tuple(r) for r in files.secondary_readings(p).orderBy("crop_id").collect()] == [("a", "x y", 0.5), ("b", "z", 0.0), ("c", "", 0.0)]
    assert files.secondary_readings(p).where(F.col("text") == "").count() == 1


class Traces:
    def trace(self, images):
        if len(images) > 1:
            raise MemoryError
        if images[0] == b"bad":
            return [{"text": "ab", "p": [0.5], "c": [0.1, 0.2], "s": [1, 1]}]
        text = images[0].decode()
        return [{"text": text, "p": [0.5] * len(text), "c": [0.1] * len(text), "s": [1.0] * len(text), "gain": None}]


class Pages:
    def pages(self, content):
        return content.decode().split("|")


def test_traces_pages_and_assets(spark, tmp_path):
    crops = spark.createDataFrame([("a", b"xy"), ("b", b"bad"), ("c", None), ("d", b"")], "crop_id string, image binary")
    got = {r["crop_id"]: r for r in engines.trace(crops.coalesce(1), Traces).collect()}
    assert (got["a"]["text"], got["a"]["p"], got["a"]["gain"], got["a"]["error"]) == ("xy", [0.5, 0.5], [], None)
    assert got["b"]["error"].startswith("ValueError:") and got["c"]["error"].startswith("AttributeError:") and got["b"]["p"] == []
    assert (got["d"]["text"], got["d"]["error"]) == ("", None)
    books = spark.createDataFrame([("a", b"one||two"), ("b", b"\xff")], "path string, content binary")
    read = sorted((r["path"], r["page_index"], r["markdown"], (r["failure"] or "").split(":")[0]) for r in engines.native_pages(books, Pages).collect())
    assert read == [("a", 0, "one", ""), ("a", 1, "", ""), ("a", 2, "two", ""), ("b", None, None, "UnicodeDecodeError")]
    config, weights = tmp_path / "m.json", tmp_path / "m.bin"
    load = lambda p: json.loads(p.read_text())
    with pytest.raises(FileNotFoundError, match="m.json.*m.bin"):
        engines.checked_assets(config, weights, 32, load)
    config.write_text('{"dataset": {"image_height": 32}}')
    weights.write_bytes(b"w")
    assert engines.checked_assets(config, weights, 32, load)["weights"] == str(weights)
    with pytest.raises(ValueError, match="32"):
        engines.checked_assets(config, weights, 48, load)

"""Dropped folders as a stream: files that grow, rest, vanish and return, over restarts."""

from __future__ import annotations

import pytest

from corpuslens.streaming import drops

SHAPE = "folder string, file string, size long, digest string, gone boolean, seen timestamp"


class Watch:
    """A stream over a folder of changes that is stopped after each round and started again from its checkpoint."""

    def __init__(self, spark, place) -> None:
        self.spark, self.place, self.n = spark, place, 0

    def go(self, *rows) -> list[tuple]:
        """The folders told after these changes (folder, file, size, second, gone), each second of one day."""
        given = [(f, x, size, f"{x}:{size}", gone, f"2024-05-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}") for f, x, size, s, gone in rows]
        df = self.spark.createDataFrame(given, "folder string, file string, size long, digest string, gone boolean, t string")
        df.selectExpr("folder", "file", "size", "digest", "gone", "cast(t as timestamp) as seen").coalesce(1).write.mode("append").parquet(f"{self.place}/in")
        self.n += 1
        out = []
        stream = self.spark.readStream.schema(SHAPE).parquet(f"{self.place}/in")
        put = lambda batch, number: out.extend((r["folder"], r["files"], r["recordings"], r["fingerprint"], r["ready"].strftime("%H:%M:%S")) for r in batch.collect())
        query = drops.ready_folders(stream, late="0 seconds").writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{self.place}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(out)


def test_folders_are_told_once_they_rest(spark, tmp_path):
    w = Watch(spark, tmp_path)
    seen = lambda rows: [(r[0], r[1], r[2], r[4]) for r in rows]
    tick = lambda s: ("clock", "x", s, s, False)
    # a grows and then rests; b has a part file; c has no recording
    assert seen(w.go(("a", "talk.mp3", 1, 10, False), ("a", "talk.mp3", 5, 60, False), ("a", "talk.mp3", 9, 100, False), ("b", "t.wav", 3, 20, False), ("b", "t2.wav.part", 3, 20, False), ("c", "notes.txt", 1, 5, False), tick(150))) == []
    first = w.go(tick(300))
    assert seen(first) == [("a", 1, 1, "00:03:40")]
    # over a restart: told once; a row that says nothing new doesn't start again; b's copy ends
    assert w.go(("a", "talk.mp3", 9, 310, False), ("b", "t2.wav.part", 0, 320, True), ("b", "t2.wav", 7, 320, False), tick(400)) == []
    assert seen(w.go(tick(600))) == [("b", 2, 2, "00:07:20")]
    # a file vanishes and returns within the wait: the content is the one that was told; another file makes it new
    assert w.go(("a", "talk.mp3", 0, 700, True), ("a", "talk.mp3", 9, 760, False), tick(900), tick(1000)) == []
    again = w.go(("a", "intake.md", 2, 1100, False), tick(1500)) + w.go(tick(1700))
    assert seen(again) == [("a", 2, 1, "00:20:20")] and again[0][3] != first[0][3]
    # gone for longer than the wait: an empty folder is nothing
    assert w.go(("b", "t.wav", 0, 1800, True), ("b", "t2.wav", 0, 1800, True), tick(2200), tick(2400)) == []


def test_rests_inside_one_batch(spark, tmp_path):
    """Changes far apart that arrive together: the content of each rest is told."""
    w = Watch(spark, tmp_path)
    rows = w.go(("a", "t.mp3", 1, 10, False), ("a", "t.mp3", 2, 500, False), ("a", ".hidden", 2, 650, False), ("clock", "x", 1, 2000, False))
    rows += w.go(("clock", "x", 2, 3000, False))
    assert [(r[0], r[1], r[4]) for r in sorted(rows, key=lambda r: r[4])] == [("a", 1, "00:02:10"), ("a", 1, "00:10:20")]


@pytest.mark.parametrize(("files", "ok"), [({"a.mp3": [1, "x"]}, True), ({"a.MP3": [1, "x"], "n.txt": [1, "y"]}, True), ({"a.mp3": [1, "x"], "b.part": [1, "y"]}, False), ({"n.txt": [1, "y"]}, False), ({}, False), ({".a.mp3": [1, "x"]}, False), ({"a.mp3": [1, "x"], ".b.crdownload": [1, "z"]}, False)])
def test_rested(files, ok):
    assert drops.rested(files) == ok


def test_changes():
    files: dict = {}
    assert drops.changed(files, ("a", 1, "d", False)) and not drops.changed(files, ("a", 1, "d", False)) and drops.changed(files, ("a", 2, None, False))
    assert files == {"a": [2, "2"]} and drops.changed(files, ("a", 0, None, True)) and not drops.changed(files, ("a", 0, None, True)) and files == {}

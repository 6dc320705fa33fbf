"""The numbered stream against the batch scan of the same folder."""

import os
import time

import pytest

from siftlog.sources import line_stream as L
from siftlog.sources.readers import number_lines, scan_text
from siftlog.streaming.multiline import merge_stream


def _batch(spark, folder):
    rows = number_lines(scan_text(spark, folder)).collect()
    return sorted((r["source"], r["line_no"], r["value"]) for r in rows)


def _run(spark, df, sink, checkpoint):
    q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start(sink)
    q.processAllAvailable()
    q.stop()
    return sorted((r["source"], r["line_no"], r["value"]) for r in spark.read.parquet(sink).collect())


def _write(path, data):
    with open(path, "ab") as f:
        f.write(data)
    os.utime(path, (time.time() - 3600,) * 2)


TEXTS = {
    "a.log": b"".join(b"line %d of a\n" % i for i in range(300)),
    "b.log": b"\xef\xbb\xbffirst\r\n\r\nthird\rfourth\n\n\xff\xfe bad bytes\nlast without end",
    "c.log": b"",
    "d.log": b"x" * 5000 + b"\ny\n",
    "e.log": b"only CR\rin this\rfile\r",
    "_skipped": b"no\n",
}


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    folder, sink, cp, state = (str(tmp_path / n) for n in ("in", "out", "cp", "state"))
    os.mkdir(folder)
    for name, data in TEXTS.items():
        _write(f"{folder}/{name}", data)
    stream = lambda: L.stream_lines(spark, folder, state, max_files=2, file_bytes=700, block_bytes=100, quiet_seconds=1)
    assert _run(spark, stream(), sink, cp) == _batch(spark, folder)
    # growth and a new file after a restart; the noted counts are gone for one file
    _write(f"{folder}/a.log", b"".join(b"more %d\n" % i for i in range(200)))
    _write(f"{folder}/c.log", b"now\nfull\n")
    _write(f"{folder}/f.log", b"new\n")
    for name in os.listdir(state):
        if name.startswith(L.count_name(f"{folder}/a.log", 0)[:38]):
            os.remove(f"{state}/{name}")
    assert _run(spark, stream(), sink, cp) == _batch(spark, folder)


def test_line_without_end_waits(spark, tmp_path):
    folder, sink, cp, state = (str(tmp_path / n) for n in ("in", "out", "cp", "state"))
    os.mkdir(folder)
    with open(f"{folder}/a.log", "wb") as f:
        f.write(b"whole\nhal")
    stream = lambda quiet: L.stream_lines(spark, folder, state, quiet_seconds=quiet)
    assert [r[1:] for r in _run(spark, stream(3600), sink, cp)] == [(0, "whole")]
    with open(f"{folder}/a.log", "ab") as f:
        f.write(b"f\nopen")
    assert [r[1:] for r in _run(spark, stream(3600), sink, cp)] == [(0, "whole"), (1, "half")]
    time.sleep(1.1)
    want = [(0, "whole"), (1, "half"), (2, "open")]
    assert [r[1:] for r in _run(spark, stream(1), sink, cp)] == want
    with open(f"{folder}/a.log", "ab") as f:        # an end that was taken is not joined again
        f.write(b"ed\nnext\n")
    assert [r[1:] for r in _run(spark, stream(3600), sink, cp)] == [*want, (3, "ed"), (4, "next")]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
@pytest.mark.parametrize("name", ["a.log", "b.log", "d.log", "e.log"])
def test_blocks_cover_every_line_once(tmp_path, name, block):
    path, data = str(tmp_path / name), TEXTS[name][:900]
    _write(path, data)
    os.mkdir(tmp_path / "state")
    reader = L.LineReader({"path": str(tmp_path), "state": str(tmp_path / "state"), "blockbytes": str(block), "quietseconds": "0"})
    got = []
    for part in reader.partitions({}, {path: [len(data), 0]}):
        for b in reader.read(part):
            got += list(zip(b["line_no"].to_pylist(), b["value"].to_pylist()))
    want = [t.decode("utf-8", "replace") for t in data.removeprefix(L.BOM).splitlines()]
    assert got == list(enumerate(want))


def test_numbered_stream_feeds_the_multiline_join(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    _write(f"{folder}/a.log", b"2024 start\n  at a.b.C\nCaused by: x\nnext\n")
    entries = merge_stream(L.stream_lines(spark, folder, str(tmp_path / "state"), block_bytes=8, quiet_seconds=0), 600_000)
    q = entries.writeStream.format("memory").queryName("numbered").outputMode("append").trigger(processingTime="1 second").start()
    end = time.time() + 40
    while time.time() < end and not spark.table("numbered").count():
        time.sleep(0.5)
    q.stop()
    row = spark.table("numbered").first()
    assert (row["line_no"], row["value"], list(row["more"])) == (0, "2024 start", ["at a.b.C", "Caused by: x"])

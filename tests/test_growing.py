"""Logs that grow: byte ranges, lines cut anywhere by the writer, restarts."""

import random

import pytest
from helpers import seconds

from skirmish.operators.parse import parse_lines
from skirmish.sources.growing import Folder, Follow, follow_logs, scan_logs


def whole(data):
    """(offset, line) of a file, also of a last line without an end."""
    at, out = 0, []
    for line in data.split(b"\n"):
        out.append((at, line.decode("latin-1")))
        at += len(line) + 1
    return out if out[-1][1] else out[:-1]


def read(folder, ranges):
    got = []
    for part in ranges:
        for batch in folder.lines(part):
            got += list(zip(batch.column("ord").to_pylist(), batch.column("raw").to_pylist(), strict=True))
    return got


@pytest.mark.parametrize("seed", range(4))
def test_ranges_of_any_size_give_every_line_once(tmp_path, monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr("skirmish.sources.growing.READ_BYTES", rnd.choice([1, 3, 7, 64]))
    data = b"".join(bytes(rnd.choices(b"ab\xe9\r", k=rnd.choice([0, 0, 1, 5, 40]))) + b"\n" for _ in range(60)) + rnd.choice([b"", b"tail"])
    (tmp_path / "x.txt").write_bytes(data)
    for split in (1, 2, 5, 33, 1000, 10_000):
        folder = Folder({"path": str(tmp_path), "splitbytes": split})
        assert read(folder, folder.ranges({}, folder.sizes())) == whole(data), split


@pytest.mark.parametrize("seed", range(4))
def test_a_writer_may_stop_anywhere(tmp_path, monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr("skirmish.sources.growing.READ_BYTES", 16)
    data = b"".join(bytes(rnd.choices(b"abc", k=rnd.randint(0, 30))) + b"\n" for _ in range(50)) + b"never ended"
    folder = Folder({"path": str(tmp_path), "glob": "*.txt", "splitbytes": 20})
    (tmp_path / "other.log").write_bytes(b"not mine\n")
    follow, start, got, at = Follow(folder, False), {}, [], 0
    while at < len(data):
        more = rnd.randint(1, 90)
        with (tmp_path / "x.txt").open("ab") as f:
            f.write(data[at : at + more])
        at += more
        if rnd.random() < 0.3:  # a restart knows the checkpoint's offset only
            follow = Follow(folder, False)
        end = follow.latestOffset()
        assert end["x.txt"] >= start.get("x.txt", 0) and set(end) == {"x.txt"}
        got += read(folder, follow.partitions(start, end))
        start = end
    assert got == whole(data)[:-1]
    (tmp_path / "x.txt").write_bytes(b"a\n")
    with pytest.raises(ValueError, match="shorter"):
        follow.latestOffset()
    with pytest.raises(ValueError, match="shorter"):
        folder.ranges(start, {"x.txt": 2})


def test_scan_and_stream(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    stamp = "[Mon Apr 14 19:00:{:02d} 2025] "
    lines = [stamp.format(i) + f"You slash Boss for {i + 1} points of damage.\r\n" for i in range(40)]
    data = "".join(lines).encode("latin-1")
    assert scan_logs(spark, str(logs)).count() == 0

    def run():
        stream = follow_logs(spark, str(logs), splitBytes=300)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(out)).trigger(availableNow=True)
        q.start().awaitTermination()

    for a, b in ((0, 100), (100, 101), (101, 1000), (1000, len(data))):
        with (logs / "eqlog_A_north.txt").open("ab") as f:
            f.write(data[a:b])
        (logs / "eqlog_B_north.txt").write_bytes(data[:b])
        run()
    scanned = scan_logs(spark, str(logs), splitBytes=250)
    view = lambda df: sorted((r.log_id, r.ord, r.raw) for r in df.collect())
    assert view(spark.read.parquet(str(out))) == view(scanned)
    events = parse_lines(scanned).where("log_id = 'eqlog_A_north.txt'").orderBy("ord").collect()
    assert [(seconds(e.ts), e.amount) for e in events] == [(i, i + 1) for i in range(40)]


def test_a_new_stream_can_start_at_the_end(tmp_path):
    (tmp_path / "x").write_bytes(b"old\nha")
    follow = Follow(Folder({"path": str(tmp_path)}), True)
    start = follow.initialOffset()
    (tmp_path / "x").write_bytes(b"old\nhalf\nnew\n")
    folder = follow.folder
    assert [x for _, x in read(folder, follow.partitions(start, follow.latestOffset()))] == ["half", "new"]
    with pytest.raises(ValueError, match="path"):
        Folder({})


def test_many_short_logs_share_tasks(tmp_path):
    for i in range(2_000):
        (tmp_path / f"log{i:04}.txt").write_bytes(b"".join(b"%d %d\n" % (i, n) for n in range(i % 4)))
    folder = Folder({"path": str(tmp_path), "splitbytes": 1 << 16})
    parts = Follow(folder, False).partitions({}, folder.sizes())
    assert len(parts) < 600
    assert read(folder, parts) == [line for i in range(2_000) for line in whole(b"".join(b"%d %d\n" % (i, n) for n in range(i % 4)))]


def test_a_share_stays_bounded_and_a_large_log_is_cut(tmp_path, monkeypatch):
    monkeypatch.setattr("skirmish.sources.growing.SPLIT_BYTES", 100)
    (tmp_path / "x.txt").write_bytes(b"0123456\n" * 10_000)
    folder = Folder({"path": str(tmp_path), "splitbytes": 40})
    parts = Follow(folder, False).partitions({}, folder.sizes())
    assert {sum(r.stop - r.start for r in p.ranges) for p in parts} == {80}
    assert read(folder, parts) == whole(b"0123456\n" * 10_000)

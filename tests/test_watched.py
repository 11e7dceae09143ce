"""A folder watched: what the driver goes through and holds, and what tasks give."""

import os
import tracemalloc

import pytest

from verilake.sources import scratch, watched
from verilake.streaming import live


def put(root, *names, content=b"x"):
    for name in names:
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)


def given(reader, start, end):
    return sorted(os.path.relpath(p.as_py().removeprefix("file:"), reader.root) for x in reader.partitions(start, end) for batch in reader.read(x) for p in batch.column(0))


def taken(spark, root, checkpoint, looks=None):
    """What a stream that is started on the checkpoint gives until all is taken."""
    found = []
    q = live.catalog(spark, str(root), looks=looks).writeStream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).foreachBatch(lambda rows, _: found.extend(map(tuple, rows.collect()))).start()
    q.awaitTermination()
    return sorted(found)


def test_names(tmp_path):
    put(tmp_path, "a.flac", "B.FLAC", "c.mp3", ".hidden.flac", "_own/d.flac", "_k=1/e.flac", "deep/er/ä b.flac", "folder.flac/f.flac", "g.flac._COPYING_", "new\nline.flac")
    (tmp_path / "other").symlink_to(tmp_path / "deep")
    (tmp_path / "deep" / "back").symlink_to(tmp_path)
    (tmp_path / "deep" / "self").symlink_to(tmp_path / "deep" / "self")
    (tmp_path / "linked.flac").symlink_to(tmp_path / "a.flac")
    (tmp_path / "broken.flac").symlink_to(tmp_path / "gone")
    want = ["a.flac", "B.FLAC", "_k=1/e.flac", "deep/er/ä b.flac", "other/er/ä b.flac", "folder.flac/f.flac", "linked.flac", "new\nline.flac"]
    assert sorted(watched.names(str(tmp_path), "flac")) == sorted(want)
    assert list(watched.names(str(tmp_path / "nothing"), "flac")) == []


def test_a_look_holds_no_folder(tmp_path, monkeypatch):
    """what the driver holds does not grow with the files."""
    reader = watched.Looks(str(tmp_path), "flac", str(tmp_path / "_looks"))
    peaks = []
    for n in (20_000, 200_000):
        monkeypatch.setattr(watched, "names", lambda *_, n=n: (f"lib/r{i % 5}/{i}.flac" for i in range(n)))
        tracemalloc.start()
        assert reader.latestOffset()["files"] == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(reader.partitions(reader.initialOffset(), reader.last)) == n // watched._NAMES
    assert peaks[1] < 1.2 * peaks[0]


def test_the_same_names_are_no_news(tmp_path):
    root = tmp_path / "root"
    put(root, "a.flac", "b.flac")
    reader = watched.Looks(str(root), "flac", str(tmp_path / "looks"))
    first = reader.latestOffset()
    put(root, "a.flac", "c.txt", content=b"more")
    assert reader.latestOffset() == first == watched.Looks(str(root), "flac", str(tmp_path / "looks")).latestOffset()
    (root / "a.flac").rename(root / "d.flac")
    assert reader.latestOffset() != first
    assert watched.Looks(str(tmp_path / "none"), "flac", str(tmp_path / "looks")).latestOffset() == reader.initialOffset()


def test_a_batch_that_is_run_again_takes_the_same_names(tmp_path):
    root, looks = tmp_path / "root", str(tmp_path / "looks")
    put(root, "a.flac", "b.flac")
    reader = watched.Looks(str(root), "flac", looks)
    start, first = reader.initialOffset(), reader.latestOffset()
    put(root, "c.flac")
    assert given(watched.Looks(str(root), "flac", looks), start, first) == ["a.flac", "b.flac"]
    second = reader.latestOffset()
    reader.commit(first)
    assert len(os.listdir(looks)) == 1 and given(reader, first, second) == ["a.flac", "b.flac", "c.flac"]
    assert given(watched.Looks(str(root), "flac", str(tmp_path / "others")), start, first) == ["a.flac", "b.flac", "c.flac"]  # no lists: what is there
    (root / "a.flac").unlink()
    assert given(reader, first, second) == ["b.flac", "c.flac"]


@pytest.mark.parametrize("kept", [False, True])
def test_files_are_given_once_and_lie_on_no_driver(spark, tmp_path, kept):
    """paths are in the state, not in the source's log, which the driver holds; old files that come later are given too."""
    root, checkpoint = tmp_path / "root", tmp_path / "checkpoint"
    looks = str(tmp_path / "looks") if kept else None
    put(root, *(f"r{i % 3}/{i}.flac" for i in range(40)))
    put(root, "empty.flac", content=b"")
    assert [x[1] for x in taken(spark, root, checkpoint, looks)] == sorted((f"{i}.flac" for i in range(40)), key=lambda x: (int(x.split(".")[0]) % 3, x))
    put(root, "empty.flac", "r0/0.flac", content=b"more")
    put(root, "old.flac", content=b"12345")
    os.utime(root / "old.flac", (1, 1))
    (root / "r1" / "1.flac").unlink()
    assert taken(spark, root, checkpoint, looks) == [(f"file:{root}/old.flac", "old.flac", 5)]
    assert taken(spark, root, checkpoint, looks) == []
    said = b"".join(f.read_bytes() for d in ("offsets", "sources", "commits") for f in (checkpoint / d).rglob("*") if f.is_file())
    assert said and b".flac" not in said


def test_a_folder_that_is_emptied(spark, tmp_path):
    root, checkpoint = tmp_path / "root", tmp_path / "checkpoint"
    root.mkdir()
    assert taken(spark, root, checkpoint) == []
    put(root, "a.flac")
    assert [x[1] for x in taken(spark, root, checkpoint)] == ["a.flac"]
    (root / "a.flac").unlink()
    assert taken(spark, root, checkpoint) == []
    put(root, "a.flac", "b.flac")
    assert [x[1] for x in taken(spark, root, checkpoint)] == ["b.flac"]  # a path is given once


def test_patterns_go_by_sparks_own_source(spark, tmp_path):
    put(tmp_path, "r1/a.flac", "r2/b.flac", "s/c.flac")
    assert [x[1] for x in taken(spark, tmp_path / "r*", tmp_path / "checkpoint")] == ["a.flac", "b.flac"]


def test_delete_follows_no_link(spark, tmp_path):
    put(tmp_path, "kept/a.flac", *(f"table/r{i % 3}/{i}" for i in range(50)))
    (tmp_path / "table" / "link").symlink_to(tmp_path / "kept")
    (tmp_path / "alias").symlink_to(tmp_path / "kept")
    for name in ("table", "alias", "nothing"):
        scratch.delete(spark, f"file:{tmp_path}/{name}")
    assert sorted(os.listdir(tmp_path)) == ["kept"] and os.listdir(tmp_path / "kept") == ["a.flac"]

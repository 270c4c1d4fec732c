"""The frame source, route by route."""

from __future__ import annotations

import zipfile

import pytest

from quillon.sources import media
from quillon.streaming import runs

JPEG = b"\xff\xd8\xff\xe0picture %d\xff\xd9"


@pytest.fixture(scope="module")
def source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(media.FrameSource)
    return spark.read.format("quillon_frames")


def frames(df) -> list[tuple]:
    return sorted((r.route, r.frame, bytes(r.content) if r.content is not None else None) for r in df.collect())


@pytest.fixture()
def folder(tmp_path):
    at = tmp_path / "clip"
    at.mkdir()
    for i in (10, 9, 200):
        (at / f"{i}.jpg").write_bytes(JPEG % i)
    (at / "notes.txt").write_text("no image")
    return at


@pytest.mark.parametrize("name", ["test_video.mp4", "test_video.mov", "abc123def456", "video.xyz"])
def test_videos(source, tmp_path, name):
    """Known, unknown and no suffixes are tried as videos."""
    (tmp_path / name).write_bytes(b"head" + JPEG % 0 + b"gap" + JPEG % 1)
    assert frames(source.load(f"{tmp_path}/{name}")) == [("video", 0, JPEG % 0), ("video", 1, JPEG % 1)]
    assert frames(source.load(f"file://{tmp_path}/{name}").where("frame = 1")) == [("video", 1, JPEG % 1)]


@pytest.mark.parametrize("made", [True, False])
def test_unreadable_video(source, tmp_path, made):
    at = tmp_path / "corrupted"
    if made:
        at.write_bytes(b"nothing that is a picture")
    with pytest.raises(Exception, match="failed to load .*corrupted"):
        source.load(str(at)).collect()


def test_folder_in_order_of_numbers(source, folder):
    assert frames(source.load(str(folder))) == [("folder", i, JPEG % i) for i in (9, 10, 200)]
    (folder / "cover.png").write_bytes(b"p")  # now names decide
    assert [(r.frame, r.name) for r in source.load(str(folder)).orderBy("frame").collect()] == [(0, "10.jpg"), (1, "200.jpg"), (2, "9.jpg"), (3, "cover.png")]


def test_image_archive_and_synthetic(source, tmp_path, folder):
    assert frames(source.load(f"{folder}/9.jpg")) == [("image", 0, JPEG % 9)]
    with zipfile.ZipFile(tmp_path / "clip.zip", "w") as z:
        for i in range(70):
            z.writestr(f"a/{i:03}.png", b"x" * i)
        z.writestr("a/readme.md", b"no image")
    got = source.load(f"{tmp_path}/clip.zip")
    assert got.count() == 70 and got.rdd.getNumPartitions() == 2
    assert [(r.frame, r.length) for r in got.where("frame in (3, 69)").orderBy("frame").collect()] == [(3, 3), (69, 69)]
    assert source.load("<load-dummy-video-5>").count() == 5 and source.load("<load-zero-video>").count() == 60


def test_filters_choose_files(source, folder):
    """A file that no filter wants isn't opened: here one that can't be."""
    (folder / "11.jpg").symlink_to(folder / "gone.jpg")
    df = source.load(str(folder))
    assert frames(df.where("frame > 9 AND frame <= 10")) == [("folder", 10, JPEG % 10)]
    assert frames(df.where("frame >= 12")) == [("folder", 200, JPEG % 200)] and df.where("frame < 0").count() == 0
    assert df.where("frame = 9 AND name = 'x'").count() == 0


def test_content_is_optional(spark, folder):
    rows = spark.read.format("quillon_frames").option("content", "false").load(str(folder)).collect()
    assert all(r.content is None and r.length > 0 for r in rows) and len(rows) == 3


def test_folder_as_a_stream(spark, source, folder, tmp_path):
    stream = spark.readStream.format("quillon_frames").load(str(folder))
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"

    def step():
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start().awaitTermination()
        return sorted(r.frame for r in spark.read.parquet(out).collect())

    assert step() == [9, 10, 200]
    (folder / "300.jpg").write_bytes(JPEG % 300)
    (folder / "11.jpg").write_bytes(JPEG % 11)  # behind what was given out
    assert step() == [9, 10, 200, 300]


def test_only_folders_stream(spark, source, tmp_path):
    with pytest.raises(Exception, match="only folders grow"):
        runs.run_available(spark.readStream.format("quillon_frames").load(f"{tmp_path}/x.mp4"), "x")

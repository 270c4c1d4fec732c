"""Frames of videos, image folders, archives and synthetic clips as a data source, in batches and as a stream.

    spark.dataSource.register(FrameSource)
    spark.read.format("quillon_frames").load("/data/clip")           # path, route, frame, name, length, content
    spark.readStream.format("quillon_frames").load("/data/growing")  # new files of a folder

By its path a clip takes one route: a synthetic name, a folder of numbered
images, an image, an archive of images, or else a video; what has no known
suffix is tried as a video, and it is an error if that can't be read.  A
partition is some files, some members of an archive, or a video.  Filters on
`frame` choose files and members before anything is opened.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fixed values.
IMAGES = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")
ARCHIVES = ("zip",)
SYNTHETIC = re.compile(r"<load-(?:dummy|zero)-video(?:-(\d+))?>?")
SYNTHETIC_FRAMES = 60
#: Files or members of a partition.
PER_PARTITION = 64

SCHEMA = "path string, route string, frame bigint, name string, length bigint, content binary"


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def route(path: str) -> str:
    """synthetic, folder, image, archive or video."""
    if SYNTHETIC.match(path):
        return "synthetic"
    fs, at = _located(path)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        return "folder"
    return "image" if _suffix(path) in IMAGES else "archive" if _suffix(path) in ARCHIVES else "video"


def numbered(names: Iterable[str]) -> list[tuple[int, str]]:
    """(frame, name) of the images: by the numbers of their stems where all are numbers, else by place in the order of names."""
    images = sorted(n for n in names if _suffix(n) in IMAGES)
    stems = [n.rsplit("/", 1)[-1].rsplit(".", 1)[0] for n in images]
    if all(s.isdigit() for s in stems):
        return sorted((int(s), n) for s, n in zip(stems, images))
    return list(enumerate(images))


def motion_frames(data: bytes) -> Iterator[bytes]:
    """The pictures of a motion JPEG stream, from their start marks to their end marks."""
    at = data.find(b"\xff\xd8\xff")
    while at >= 0:
        end = data.find(b"\xff\xd9", at)
        if end < 0:
            return
        yield data[at : end + 2]
        at = data.find(b"\xff\xd8\xff", end + 2)


@dataclass
class Clip(InputPartition):
    """What one task reads: frames with their names, or a whole video."""

    path: str
    route: str
    frames: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(None)


class Bounds:
    """What filters leave of the frames."""

    def __init__(self) -> None:
        self.low, self.high, self.among = float("-inf"), float("inf"), None

    def add(self, f: Filter) -> bool:
        """Takes the filter in, if it is one on the frame's number."""
        if getattr(f, "attribute", None) != ("frame",):
            return False
        if isinstance(f, (EqualTo, In)):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.among = wanted if self.among is None else self.among & wanted
        elif isinstance(f, GreaterThan):
            self.low = max(self.low, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.low = max(self.low, f.value)
        elif isinstance(f, LessThan):
            self.high = min(self.high, f.value - 1)
        elif isinstance(f, LessThanOrEqual):
            self.high = min(self.high, f.value)
        else:
            return False
        return True

    def holds(self, frame: int) -> bool:
        return self.low <= frame <= self.high and (self.among is None or frame in self.among)


def _listed(path: str, how: str) -> list[tuple[int, str]]:
    fs, at = _located(path)
    if how == "folder":
        return numbered(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File)
    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        return numbered(n for n in z.namelist() if not n.endswith("/"))


def _cut(path: str, how: str, frames: list[tuple[int, str]]) -> list[Clip]:
    return [Clip(path, how, frames[i : i + PER_PARTITION]) for i in range(0, len(frames), PER_PARTITION)]


def _read(clip: Clip, bounds: Bounds, content: bool) -> Iterator[tuple]:
    row = lambda frame, name, data: (clip.path, clip.route, frame, name, len(data), data if content else None)
    if clip.route == "synthetic":
        for n, name in clip.frames:
            yield clip.path, clip.route, n, name, 0, None
        return
    fs, at = _located(clip.path)
    if clip.route == "archive":
        with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            for n, name in clip.frames:
                yield row(n, name, z.read(name)) if content else (clip.path, clip.route, n, name, z.getinfo(name).file_size, None)
    elif clip.route == "video":
        try:
            with fs.open_input_stream(at) as f:
                pictures = list(motion_frames(f.read()))
        except OSError as e:
            raise NotImplementedError(f"failed to load {clip.path}: {e}") from e
        if not pictures:
            raise NotImplementedError(f"failed to load {clip.path}: no frames that can be decoded")
        yield from (row(n, at.rsplit("/", 1)[-1], p) for n, p in enumerate(pictures) if bounds.holds(n))
    else:
        for n, name in clip.frames:
            if not content:
                yield clip.path, clip.route, n, name.rsplit("/", 1)[-1], fs.get_file_info(name).size, None
            else:
                with fs.open_input_stream(name) as f:
                    yield row(n, name.rsplit("/", 1)[-1], f.read())


class FrameReader(DataSourceReader):
    def __init__(self, path: str, content: bool):
        self.path, self.content, self.bounds = path, content, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.bounds.add(f)]

    def partitions(self) -> list[Clip]:
        how = route(self.path)
        if how == "synthetic":
            n = int(SYNTHETIC.match(self.path)[1] or SYNTHETIC_FRAMES)
            frames = [(i, f"{i}") for i in range(n)]
        elif how == "image":
            frames = [(0, _located(self.path)[1])]
        elif how == "video":
            return [Clip(self.path, how)]
        else:
            frames = _listed(self.path, how)
        return _cut(self.path, how, [x for x in frames if self.bounds.holds(x[0])]) or [Clip(self.path, "synthetic")]

    def read(self, partition: Clip) -> Iterator[tuple]:
        return _read(partition, self.bounds, self.content)


class FrameStream(DataSourceStreamReader):
    """A folder's images in the order of their numbers; the offset is the last number given out, so one that comes behind it isn't read."""

    def __init__(self, path: str, content: bool):
        self.path, self.content = path, content

    def initialOffset(self) -> dict:
        return {"frame": -1}

    def latestOffset(self) -> dict:
        return {"frame": max((n for n, _ in _listed(self.path, "folder")), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Clip]:
        return _cut(self.path, "folder", [x for x in _listed(self.path, "folder") if start["frame"] < x[0] <= end["frame"]])

    def read(self, partition: Clip) -> Iterator[tuple]:
        return _read(partition, Bounds(), self.content)

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """Options: path; content ("false" leaves the bytes out)."""

    @classmethod
    def name(cls) -> str:
        return "quillon_frames"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, bool]:
        return self.options["path"], self.options.get("content", "true").lower() != "false"

    def reader(self, schema) -> FrameReader:
        return FrameReader(*self._given())

    def streamReader(self, schema) -> FrameStream:
        path, content = self._given()
        if route(path) != "folder":
            raise ValueError(f"{path} is no folder: only folders grow")
        return FrameStream(path, content)

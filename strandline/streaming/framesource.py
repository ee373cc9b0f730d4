"""Decoded frames as a Spark data source: ``spark.read.format("frames")`` and ``spark.readStream.format("frames")``.

The files of a folder are tracks in the order of their names; their frames are one sequence that rolls
over from track to track. A batch read deals the frames of every file out over tasks by its offset
table. A stream hands over so many frames a micro-batch, which is a pull: its offset is the number of
frames taken, so a restart goes on where the checkpoint says. The stub kind makes its frames itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "track int, frame long, place long, first_sample long, roll boolean, left array<int>, right array<int>"


@dataclass
class Span(InputPartition):
    """Frames first to last of a track; place is the first one's number in the whole sequence."""

    track: int
    first: int
    last: int
    place: int

    def __post_init__(self):
        self.value = (self.track, self.first, self.last)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Frames:
    """The tracks of the options: where their frames lie, and how one is decoded."""

    def __init__(self, options: dict[str, str]):
        self.kind = options.get("kind", "gafp")
        self.skip = int(options.get("skip", "0"))  # samples at the begin of the first track that are silenced
        if self.kind == "stub":
            self.block = int(options.get("block", "64"))
            self.counts = [int(n) for n in options.get("frames", "10").split(",")]
            return
        if self.kind not in ("gafp", "flac"):
            raise ValueError(f"kind {self.kind}")
        from pyarrow import fs

        where, base = _open(options["path"])
        found = where.get_file_info(fs.FileSelector(base)) if where.get_file_info(base).type == fs.FileType.Directory else [where.get_file_info(base)]
        self.where, self.paths = where, sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        self.sizes: list[int] = []  # samples of a track's frames but the last
        self.counts = [len(self.offsets(t)[0]) for t in range(len(self.paths))]

    def _bytes(self, track: int, at: int = 0, n: int | None = None) -> bytes:
        with self.where.open_input_file(self.paths[track]) as f:
            f.seek(at)
            return f.read(n) if n is not None else f.read()

    def offsets(self, track: int) -> tuple[list[int], list[int], object]:
        """Begin and end of each frame's bytes, and what its header refers to."""
        from strandline.sources import containers, flac

        if self.kind == "flac":
            data = self._bytes(track)
            rows = list(flac.walk(data))
            self.sizes.append(flac.facts(data)[0].most_block)
            return [r["offset"] for r in rows], [r["offset"] + r["bytes"] for r in rows], flac.facts(data)[0]
        head = self._bytes(track, 0, 28)
        n = int.from_bytes(head[22:24], "little")
        size = self.where.get_file_info(self.paths[track]).size
        m = containers.parse_gafp_head(self._bytes(track, 0, 28 + 4 * n), size)
        self.sizes.append(m["block"])
        return m["offsets"], [*m["offsets"][1:], size], flac.StreamInfo(16, 65535, None, None, m["rate"], m["channels"], m["bits"], m["samples"], None)

    def rows(self, span: Span) -> Iterator[tuple]:
        from strandline.sources import flac

        begins, ends, info = ([], [], None) if self.kind == "stub" else self.offsets(span.track)
        data = b"" if self.kind == "stub" or span.first >= span.last else self._bytes(span.track, begins[span.first], ends[span.last - 1] - begins[span.first])
        size = self.block if self.kind == "stub" else self.sizes[span.track]
        for i in range(span.first, span.last):
            if self.kind == "stub":
                left = [((span.track * 7919 + i * self.block + k) * 40503) % 65536 - 32768 for k in range(self.block)]
                right = [-1 - v for v in left]
            else:
                _, slots, _, _ = flac.frame(data, begins[i] - begins[span.first], info)
                left, right = slots[0], slots[-1]
            start = i * size
            if span.track == 0 and start < self.skip:
                n = min(len(left), self.skip - start)
                left, right = [0] * n + left[n:], [0] * n + right[n:]
            yield span.track, i, span.place + i - span.first, start, i == 0, left, right

    def spans(self, first: int, last: int, most: int) -> list[Span]:
        """Spans of at most so many frames that cover the places first to last of the sequence."""
        out, base = [], 0
        for track, n in enumerate(self.counts):
            a, b = max(first, base), min(last, base + n)
            for at in range(a, b, most):
                out.append(Span(track, at - base, min(at + most, b) - base, at))
            base += n
        return out


class FrameSource(DataSource):
    """Options: path, kind (gafp, flac or stub), per_task and per_batch frames, skip samples; for stubs frames (a list) and block."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 (Spark's name)
        return _Stream(dict(self.options))


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Span]:
        frames = Frames(self.options)
        return frames.spans(0, sum(frames.counts), int(self.options.get("per_task", "256")))

    def read(self, partition: Span) -> Iterator[tuple]:
        return Frames(self.options).rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.given = options, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"place": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.given = min(sum(Frames(self.options).counts), self.given + int(self.options.get("per_batch", "4")))
        return {"place": self.given}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.given = max(self.given, end["place"])
        return Frames(self.options).spans(start["place"], end["place"], int(self.options.get("per_task", "256")))

    def read(self, partition: Span) -> Iterator[tuple]:
        return Frames(self.options).rows(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)

"""Archives read in place: a ZIP's directory is read once, and its members are dealt to tasks that read only theirs."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASK_BYTES = 64 << 20
META = "array<struct<image_path:string,image_metadata:map<string,string>>>"


class Seekable:
    """A file of Arrow's whose places out of bounds are errors of input, as ZIP readers expect."""

    def __init__(self, file):
        self.file = file

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.file.seek(at, whence)
        except ValueError as e:
            raise OSError(str(e)) from e

    def __getattr__(self, name):
        return getattr(self.file, name)


def opened(path: str) -> zipfile.ZipFile:
    """A ZIP anywhere that Arrow's file systems reach; members are read by seeking."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(Seekable(system.open_input_file(at)))


def dealt(members: list[zipfile.ZipInfo], most: int = TASK_BYTES) -> Iterator[list[str]]:
    """Members in the order of their places, in runs of about `most` compressed bytes, so that a task reads forwards."""
    run, size = [], 0
    for m in sorted(members, key=lambda m: m.header_offset):
        if run and size + m.compress_size > most:
            yield run
            run, size = [], 0
        run.append(m.filename)
        size += m.compress_size
    if run:
        yield run


class Members(InputPartition):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names


class Archives(DataSource):
    """`paths` (one a line) and, if wanted, `prefix` and `suffix` of the members. Columns: archive, place (in the directory),
    member, size, content."""

    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return "archive string, place long, member string, size long, content binary"

    def reader(self, schema):
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _wanted(self, member: zipfile.ZipInfo) -> bool:
        name = member.filename
        return not member.is_dir() and name.startswith(self.options.get("prefix", "")) and name.lower().endswith(self.options.get("suffix", "").lower())

    def partitions(self):
        out = []
        for path in filter(None, self.options["paths"].split("\n")):
            with opened(path) as archive:
                out += [Members(path, names) for names in dealt([m for m in archive.infolist() if self._wanted(m)])]
        return out

    def read(self, partition):
        with opened(partition.path) as archive:
            place = {m.filename: k for k, m in enumerate(archive.infolist())}
            for name in partition.names:
                data = archive.read(name)  # checked against the directory's CRC
                yield (partition.path, place[name], name, len(data), data)


def members(spark: SparkSession, paths: list[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """(archive, place, member, size, content) of the members of ZIP files; a lost executor costs a run of members."""
    spark.dataSource.register(Archives)
    return spark.read.format("zip_members").option("paths", "\n".join(paths)).option("prefix", prefix).option("suffix", suffix).load()


def pool(spark: SparkSession, paths: list[str], base: str = "", images: str = "images/", notes: str = "annotations/", suffix: str = ".png") -> DataFrame:
    """(archive, member, id, number, size, metadata) of the images of archives, numbered by name within each. Metadata come
    from lists in JSON members; of an image's several, the first in the archive's order counts. Images aren't carried along."""
    from pyspark.sql import Window

    pictures = members(spark, paths, base + images, suffix).select("archive", "member", "size")
    lists = members(spark, paths, base + notes, ".json").select("archive", "place", F.posexplode(F.from_json(F.col("content").cast("string"), META)).alias("row", "note"))
    bare = F.regexp_replace(F.coalesce("note.image_path", F.lit("")), r"^\./", "")
    told = lists.select("archive", F.when((bare != "") & ~bare.startswith(base or "\x00"), F.concat(F.lit(base), bare)).otherwise(bare).alias("member"), "place", "row", F.coalesce("note.image_metadata", F.create_map().cast("map<string,string>")).alias("m"))
    first = told.groupBy("archive", "member").agg(F.min_by("m", F.struct("place", "row")).alias("metadata"))
    stem = F.regexp_extract("member", r"([^/]*)\.[^./]*$", 1)
    number = F.row_number().over(Window.partitionBy("archive").orderBy("member"))
    return pictures.join(first, ["archive", "member"], "left").select("archive", "member", stem.alias("id"), number.alias("number"), "size", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))

"""A folder of files of many kinds as a Spark data source, with parsers by suffix that a user may add to.

Documents come through a Python data source: its partitions are groups of files of about equal size, and a file
that cannot be read or parsed is a row with an error, never a failed job. CSV and JSON hold records, not documents: Spark's own
readers take them, line by line and split like any other input.
"""

from __future__ import annotations

import html.parser
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clausegrid.sources.files import PARSERS as BUILT_IN
from clausegrid.sources.files import SUFFIXES

Parser = Callable[[bytes], str]
SCHEMA = "path string, size long, parser string, text string, error string"
#: Suffixes that Spark's own readers take.
RECORDS = {"csv": (".csv",), "json": (".json", ".jsonl", ".ndjson")}


class _Text(html.parser.HTMLParser):
    """The text of a page, but for scripts and styles; the ends of blocks are line ends."""

    HIDDEN = ("script", "style", "template")
    BLOCKS = ("p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "title", "table")

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(data: bytes) -> str:
    page = _Text()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    lines = (" ".join(line.split()) for line in "".join(page.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def parsers(more: Mapping[str, Parser] | None = None) -> dict[str, tuple[str, Parser]]:
    """Parser by suffix, each with its name: those that come with the library, then `more` (suffix to function), which go first."""
    found = {s: (name, BUILT_IN[name]) for name, suffixes in SUFFIXES.items() for s in suffixes}
    found |= {s: ("html", html_text) for s in (".html", ".htm")}
    return found | {s.lower(): (getattr(f, "__name__", "parser"), f) for s, f in (more or {}).items()}


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[tuple[str, int]]


class FolderReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], by_suffix: Mapping[str, tuple[str, Parser]]) -> None:
        if not (path := options.get("path")):
            raise ValueError("a folder to read is needed")
        self.path, self.by_suffix = path, by_suffix
        self.most = int(options.get("partitionbytes", 64 << 20))
        self.largest = int(options.get("largestfile", 256 << 20))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        """Files in groups of `partitionbytes`, the largest first, so that all groups take about as long. Records are left to Spark's readers."""
        from pyarrow import fs

        store, root = self._store()
        skipped = tuple(s for suffixes in RECORDS.values() for s in suffixes)
        names = [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_")) and not f.base_name.lower().endswith(skipped)]
        groups: list[Files] = []
        room = 0
        for path, size in sorted(names, key=lambda f: (-f[1], f[0])):
            if not groups or size > room:
                groups.append(Files([]))
                room = self.most
            groups[-1].paths.append((path, size))
            room -= size
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for path, size in partition.paths:
            name, parse = self.by_suffix.get("." + path.rpartition("/")[2].lower().rpartition(".")[2], (None, None))
            text = error = None
            try:
                if parse is None:
                    raise ValueError("no parser takes this file")
                if size > self.largest:
                    raise ValueError(f"{size} bytes are more than the {self.largest} of largestfile")
                with store.open_input_stream(path) as stream:
                    text = parse(stream.read())
                if not text.strip():
                    text, error = None, "the file has no text"
            except Exception as problem:  # a fault in one file is a row
                error = str(problem) or type(problem).__name__
            yield (path, size, name, text, error)


def register(spark: SparkSession, name: str = "clausegrid", more: Mapping[str, Parser] | None = None) -> None:
    """Makes spark.read.format(name).load(folder) read documents, with `more` parsers by suffix beside the library's.

    The parsers travel with the data source, so functions of a notebook will do.
    """
    by_suffix = parsers(more)

    class FolderSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> FolderReader:
            return FolderReader(self.options, by_suffix)

    spark.dataSource.register(FolderSource)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind and record (JSON) of every row of the CSV files, which have a header, and every object of the JSON files of a folder.

    Each file may have columns of its own. A line that is no JSON is a record of null.
    """
    out = None
    for kind, suffixes in RECORDS.items():
        for suffix in suffixes:
            reader = spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").option("singleVariantColumn", "row")
            rows = reader.option("header", "true").load(folder) if kind == "csv" else reader.load(folder)
            rows = rows.select(F.col("_metadata.file_path").alias("path"), F.lit(kind).alias("kind"), F.to_json("row").alias("record"))
            out = rows if out is None else out.unionByName(rows)
    return out

"""A Spark data source of remote catalogues, read from their stored answers: ``spark.read.format("catalogue")``.

A catalogue is a folder with one folder ``page=N`` for each answer, which holds the answer's body as text.  Three styles
tell how answers follow one another, as the services ask for them: ``page`` (numbered, asked by POST with a body or by a
query string), ``offset`` (from, count) and ``cursor`` (each answer names the next).  Numbered answers are dealt to
partitions in ranges; a chain of cursors is one partition, since only an answer tells what comes next.

Each record of an answer is a row; fields that a service lacks are null.  A page that cannot be read is one row that holds
its error.  A record whose detail page was refused (401, 403) keeps what its listing said, marked ``listing_only``; one
whose detail failed otherwise has an error.  Filters on ``page`` are taken by the reader, and only those pages are opened.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "catalogue string, page int, request string, external_id string, url string, title string, summary string, organisation string, status int, listing_only boolean, error string"
#: Answers of a partition.
PAGES_PER_PARTITION = 16
REFUSED = (401, 403)


@dataclass
class Pages(InputPartition):
    """Numbers of the answers that a task reads; of a chain the first one."""

    numbers: tuple[int, ...]
    chained: bool = False


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.style, self.post = options["path"].rstrip("/"), options.get("style", "page"), options.get("method", "get") == "post"
        self.size, self.name = int(options.get("size", 25)), options.get("catalogue", options["path"].rstrip("/").rsplit("/", 1)[-1])
        self.base, self.each = options.get("url", f"https://{self.name}.example"), int(options.get("pages_per_partition", PAGES_PER_PARTITION))
        if self.style not in ("page", "offset", "cursor"):
            raise ValueError(f"style is page, offset or cursor, not {self.style}")
        self.first, self.last = int(options.get("first_page", 1)), int(options["last_page"]) if "last_page" in options else None

    def _kept(self, page: int) -> bool:
        return self.first <= page and (self.last is None or page <= self.last)

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if re.match(r"\w+:", self.folder) else f"file://{self.folder}")

    def partitions(self):
        from pyarrow import fs

        files, root = self._fs()
        if self.style == "cursor":
            return [Pages((1,), True)]
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        numbers = sorted(int(m[1]) for f in found if (m := re.fullmatch(r"page=(\d+)", f.base_name)) and self._kept(int(m[1])))
        return [Pages(tuple(numbers[i : i + self.each])) for i in range(0, len(numbers), self.each)] or [Pages(())]

    def request(self, page: int) -> str:
        """What the service was asked for an answer."""
        if self.post:
            return json.dumps({"pagination": {"page": page, "size": self.size}, "url": f"{self.base}/search"})
        if self.style == "offset":
            return f"{self.base}/search?from={(page - 1) * self.size}&count={self.size}"
        return f"{self.base}/search?{'p' if self.style == 'page' else 'cursor'}={page}&num={self.size}"

    def _body(self, page: int) -> str:
        from pyarrow import fs

        files, root = self._fs()
        parts = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/page={page}")) if f.is_file and not f.base_name.startswith(("_", "."))]
        return "".join(files.open_input_file(p).read().decode() for p in sorted(parts))

    def read(self, partition: Pages) -> Iterator[tuple]:
        numbers, seen = list(partition.numbers), set()
        while numbers:
            page = numbers.pop(0)
            seen.add(page)
            try:
                answer = json.loads(self._body(page))
                if not isinstance(answer, dict):
                    raise ValueError("answer is no object")
            except (OSError, ValueError) as e:
                yield (self.name, page, self.request(page), *[None] * 5, None, False, f"unreadable page: {type(e).__name__}")
                continue
            for record in answer.get("items") or []:
                yield self.row(page, record)
            after = answer.get("next")
            if partition.chained and after is not None and int(after) not in seen:  # a chain that turns back ends
                numbers.append(int(after))

    def row(self, page: int, record: dict) -> tuple:
        text = lambda *names: next((" ".join(str(record[n]).split()) for n in names if record.get(n) is not None and str(record[n]).strip()), None)
        key, title, status = text("id", "rcn"), text("title"), int(record.get("detail_status") or 200)
        refused = status in REFUSED
        error = f"HTTP {status}" if status >= 400 and not refused else None if title else "record has no title"
        return (self.name, page, self.request(page), key, f"{self.base}/{key}", title, text("description", "summary", "objective", "title"), text("company", "acronym"), status, refused, error)


class CatalogueSource(DataSource):
    """Options: path, style (page, offset, cursor), method (get, post), size, catalogue, url, first_page, last_page, pages_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(dict(self.options))


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The records of a catalogue's stored answers."""
    spark.dataSource.register(CatalogueSource)
    return spark.read.format("catalogue").options(**{k: str(v) for k, v in options.items()}).load(folder)

"""A data source for object-centric XML (versions 1.0 and 2.0) that reads files by byte ranges.

A task owns the records whose start tag begins in its range and reads on to their end, so one file, even one without line breaks, is
read by many tasks.  Records are the event, object, event-type and object-type elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RELATED = "array<struct<id: string, qualifier: string>>"
RECORDS = f"kind string, id string, type string, time string, attributes array<struct<name: string, time: string, value: string>>, objects {RELATED}, events {RELATED}"
START = re.compile(rb"<(event-type|object-type|event|object)(?=[\s>/])")
CHUNK, SLACK = 1 << 20, 64


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class ObjectXml(DataSource):
    """spark.read.format("object_xml").load(path), a file or a folder; option splitbytes: the size of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "object_xml"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return ObjectXmlReader(self.options["path"], int(self.options.get("splitbytes", 64 << 20)))


class ObjectXmlReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        store, path = _store(self.path)
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, a, min(a + self.split, f.size)) for f in files for a in range(0, f.size, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as file:
            for raw in records(file, partition.start, partition.end):
                row = parsed(raw)
                if row is not None:
                    yield row


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path; one without a scheme is local."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", path) else path)


def records(file, start: int, end: int) -> Iterator[bytes]:
    """Whole elements whose start tag begins in [start, end); what is cut off by the end of the file is left out."""
    file.seek(start)
    data, begin, at, done = b"", start, 0, False

    def more() -> bool:
        nonlocal data, done
        chunk = file.read(CHUNK)
        data, done = data + chunk, not chunk
        return not done

    while True:
        found = START.search(data, at)
        if found is None or (found.end() + SLACK > len(data) and not done):
            keep = found.start() if found else max(at, len(data) - SLACK)
            data, begin, at = data[keep:], begin + keep, 0
            if begin >= end or (not more() and found is None):
                return
            continue
        if begin + found.start() >= end:
            return
        stop = _element_end(data, found)
        while stop is None and more():
            stop = _element_end(data, found)
        if stop is None:
            return
        yield data[found.start() : stop]
        data, begin, at = data[stop:], begin + stop, 0


def _element_end(data: bytes, found: re.Match) -> int | None:
    """Where the element ends, also with elements of its own name inside; None if that is not in data."""
    name = re.escape(found[1])
    depth = 0
    for tag in re.compile(rb"<(/?)" + name + rb"(?=[\s>/])[^>]*?(/?)>").finditer(data, found.start()):
        depth += 0 if tag[2] else -1 if tag[1] else 1
        if depth == 0:
            return tag.end()
    return None


def _related(parent: ElementTree.Element | None, key: str) -> list[tuple]:
    return [(x.get(key), x.get("qualifier")) for x in parent if x.get(key) is not None] if parent is not None else []


def parsed(raw: bytes) -> tuple | None:
    """A record as a row; None for elements that only stand for a relation."""
    element = ElementTree.fromstring(raw.decode("utf-8", "replace"))
    inside = lambda tag: element.find(tag) if element.find(tag) is not None else ()
    if element.tag.endswith("-type"):
        return (element.tag, None, element.get("name"), None, [(x.get("name"), None, x.get("type")) for x in inside("attributes")], [], [])
    if element.get("id") is not None:
        attributes = [(x.get("name"), x.get("time"), x.text or "") for x in inside("attributes")]
        return (element.tag, element.get("id"), element.get("type"), element.get("time"), attributes, _related(element.find("objects"), "object-id"), _related(element.find("events"), "event-id"))
    fields = {x.get("key"): x for x in element if x.get("key") is not None}
    if "id" not in fields:
        return None
    value = lambda key: fields[key].get("value") if key in fields else None
    attributes = [(x.get("key"), None, x.get("value")) for x in fields.get("vmap", fields.get("ovmap", ()))]
    return (element.tag, value("id"), value("activity") or value("type"), value("timestamp"), attributes, [(x.get("value"), None) for x in fields.get("omap", ())], [])

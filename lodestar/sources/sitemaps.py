"""Sitemaps: URLs, video and news entries of whole or cut XML documents."""

from __future__ import annotations

import gzip
import xml.sax
import xml.sax.handler
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

_NEWS = {"name": "publication_name", "language": "language", "publication_date": "publication_date", "title": "title"}
_VIDEO = {"title": "title", "description": "description", "thumbnail_loc": "thumbnail_url", "content_loc": "content_url", "player_loc": "player_url"}


class _Reader(xml.sax.handler.ContentHandler):
    """Collects entries; an entry counts once it is closed, so that one cut short doesn't."""

    def __init__(self) -> None:
        super().__init__()
        self.path: list[str] = []
        self.text: list[str] = []
        self.urls: list[str] = []
        self.sitemaps: list[str] = []
        self.video: list[dict[str, Any]] = []
        self.news: list[dict[str, Any]] = []
        self.entry: dict[str, Any] | None = None

    def startElement(self, name: str, attrs: Any) -> None:  # noqa: N802
        self.path.append(name)
        self.text = []
        depth, local = len(self.path), name.rpartition(":")[2]
        if depth == 2 and name in ("url", "sitemap"):
            self.entry = {"locs": [], "video": [], "news": []}
        elif depth == 3 and self.entry is not None and local in ("video", "news"):
            self.entry[local].append({})

    def characters(self, content: str) -> None:
        self.text.append(content)

    def endElement(self, name: str) -> None:  # noqa: N802
        depth, local = len(self.path), name.rpartition(":")[2]
        value = " ".join("".join(self.text).split())
        self.text = []
        if self.entry is not None:
            if depth == 3 and name == "loc" and value:
                self.entry["locs"].append(value)
            elif depth >= 4 and value:
                kind = self.path[2].rpartition(":")[2]
                names = _VIDEO if kind == "video" else _NEWS if kind == "news" else {}
                if local in names and self.entry[kind]:
                    self.entry[kind][-1][names[local]] = value
            elif depth == 2:
                self._close(name)
        self.path.pop()

    def _close(self, name: str) -> None:
        locs = self.entry["locs"]
        if name == "sitemap":
            self.sitemaps += locs
        else:
            self.urls += locs
            for kind, out in (("video", self.video), ("news", self.news)):
                out += [{"loc": locs[0], **fields} for fields in self.entry[kind]] if locs else []
        self.entry = None


def parse(document: bytes) -> dict[str, Any]:
    """urls, sitemaps, video, news and whether the document was cut or broken."""
    if document[:2] == b"\x1f\x8b":
        try:
            document = gzip.decompress(document)
        except (EOFError, OSError, zlib.error):
            document = zlib.decompressobj(31).decompress(document)
    reader = _Reader()
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setContentHandler(reader)
    cut = False
    try:
        parser.feed(document)
        parser.close()
    except xml.sax.SAXException:
        cut = True
    return {"urls": reader.urls, "sitemaps": reader.sitemaps, "video": reader.video, "news": reader.news, "cut": cut}


_SCHEMA = (
    "urls array<string>, sitemaps array<string>, "
    "video array<struct<loc:string,title:string,description:string,thumbnail_url:string,content_url:string,player_url:string>>, "
    "news array<struct<loc:string,publication_name:string,language:string,publication_date:string,title:string>>, cut boolean"
)


def parsed(documents: DataFrame, body: str = "body") -> DataFrame:
    """``documents`` (with a binary or text body) with what their sitemaps say."""
    at = documents.columns.index(body)
    kinds = pa.schema([
        ("urls", pa.list_(pa.string())), ("sitemaps", pa.list_(pa.string())),
        ("video", pa.list_(pa.struct([(n, pa.string()) for n in ("loc", *_VIDEO.values())]))), ("news", pa.list_(pa.struct([(n, pa.string()) for n in ("loc", *_NEWS.values())]))),
        ("cut", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [parse(b if isinstance(b, bytes) else (b or "").encode()) for b in batch.column(at).to_pylist()]
            found = pa.RecordBatch.from_pylist(said, kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns], names=[*batch.schema.names, *kinds.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(run, f"{fields}, {_SCHEMA}")

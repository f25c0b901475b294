"""Media columns: pages as interleaved sequences of text and media references, and the payloads they refer to.

HTML parsing yields an ordered array of structs. A media struct holds its reference, the digest in it if it has one, and
its caption; positions count all structs, so that text and media stay aligned when the references are exploded, joined
to the media table by digest and put together again. Payloads are stored as gray PNG images of 8-bit samples, 64 to a row.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_back, unused
from .common import slices, texts_of

WIDTH = 64
SCHEME = "media:sha256:"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
BREAKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "td", "th", "table", "section", "article", "nav", "header", "footer", "blockquote", "pre", "title", "figure", "body", "html"}
HIDDEN = {"script", "style", "template", "noscript"}
MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "", "embed": "image"}
#: Media elements that may have their references in `source` elements within.
HOLDERS = {"audio": "audio", "video": "video", "picture": "image"}
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
ITEM_DDL = "struct<position int, kind string, text string, ref string, digest string, caption string>"


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + b"\0" * (max(-(-len(data) // WIDTH), 1) * WIDTH - len(data))


def to_png(payload: bytes) -> bytes:
    """A gray image of 8-bit samples, 64 to a row; the payload's size is a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()  # filter 0 before each row

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 3)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of a stored image, row by row."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a stored image")
    at, data, shape = len(SIGNATURE), [], None
    while at < len(media):
        n, name = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + body):
            raise ValueError("broken chunk")
        if name == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
            shape = (height, width)
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Rows, sum of all samples, and a bit for each column: whether it is brighter than the mean."""
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = np.packbits(columns * samples.shape[1] > columns.sum()).tobytes().hex()
    return f"{samples.shape[0]}:{int(columns.sum())}:{bits}"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.hidden = 0
        self.holders: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] = []  # where the open figures' items begin

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.add(kind="text", text=text)

    def add(self, kind: str, text: str | None = None, ref: str | None = None, caption: str | None = None) -> None:
        digest = ref[len(SCHEME) :] if ref and ref.startswith(SCHEME) else None
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "ref": ref, "digest": digest, "caption": caption})

    def handle_starttag(self, tag, attrs):
        if tag in HOLDERS:
            self.holders.append(tag)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA:
            own = dict(attrs)
            if (ref := own.get("src")) and not self.hidden:
                self.flush()
                held_by = HOLDERS[self.holders[-1]] if self.holders else "image"
                self.add(MEDIA[tag] or (own["type"].split("/")[0] if own.get("type") else held_by), ref=ref, caption=own.get("alt") or own.get("title") or None)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure.append(len(self.items))

    def parse_marked_section(self, i, report=1):
        """`<![...]>` is a comment in HTML."""
        return self.parse_bogus_comment(i)

    def handle_endtag(self, tag):
        if tag in self.holders:
            self.holders.remove(tag)
        if tag in HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figure[-1] if self.figure else len(self.items) :]:
                if item["kind"] != "text" and text:
                    item["caption"] = text
        elif tag in BREAKS:
            self.flush()
            if tag == "figure" and self.figure:
                self.figure.pop()

    def handle_data(self, data):
        if not self.hidden:
            (self.buffer if self.caption is None else self.caption).append(data)


def parse_page(page: str | None) -> list[dict]:
    """The page's texts and media references in order; nothing for a null page. A figure's caption is its media's, not text."""
    if not page:
        return []
    parser = _Page()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.items


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(parse_page, batch.column(1).to_pylist()), pa.list_(ITEM))], [batch.schema.names[0], "items"])


def page_sequences(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, items: an interleaved sequence for each row; an empty one for a null page. Other columns are not read."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_sequences, f"page_id long, items array<{ITEM_DDL}>")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        payloads = [payload_of(t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array(map(to_png, payloads), pa.binary())], ["digest", "media"])


def media_table(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """digest (of the payload), media (its stored form) for each row's text; a null one counts as empty. Equal texts give equal rows."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_stored, "digest string, media binary")


def media_store(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """digest, media: the media table with one row a digest, as resolve() wants it."""
    return media_table(docs, text_col=text_col).groupBy("digest").agg(F.min("media").alias("media"))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for media in batch.column("media").to_pylist():
            samples = from_png(media)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


DESCRIBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe_media(media: DataFrame) -> DataFrame:
    """What is read back from the stored form, one row for each digest. The payloads themselves stay in their tasks."""
    rows = media.select("digest", "media").mapInArrow(_described, f"digest string, {DESCRIBED}")
    names = [c.split()[0] for c in DESCRIBED.split(", ")]
    return rows.groupBy("digest").agg(*(F.min(c).alias(c) for c in names))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each item of the sequences, with media's columns by digest; positions and captions are kept.

    sequences: page_id, items, and columns of their own. Items without a match, and texts, have nulls. media: one row a digest.
    """
    items = sequences.withColumn("item", F.explode_outer("items")).drop("items")
    own = [F.col(f"`{c}`") for c in items.columns if c != "item"]
    items = items.select(*own, "item.*")
    # Texts have no digest: each gets a key of its own that matches nothing, not one key for all.
    key = F.coalesce("digest", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    name = unused(items, "key")
    # A frequent digest's items are split.
    return join_back(items.withColumn(name, key), media.withColumnRenamed("digest", name), [name], "left").drop(name)


def reassemble(resolved: DataFrame, *columns: str) -> DataFrame:
    """page_id, items: the resolved items with the given columns, in order of position."""
    item = F.struct("position", "kind", "text", "ref", "digest", "caption", *columns)
    return resolved.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), item))).alias("items"))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        pages, sizes = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            digest = hashlib.sha256(payload_of(text)).hexdigest()
            lines = [f"<p>{html.escape(x, quote=False)}</p>" for x in text.split("\n")]
            half = len(lines) // 2
            caption = " ".join(m[0] for m in itertools.islice(re.finditer(r"[^\s<>&]+", text), 5))
            figure = f'<figure><img src="{SCHEME}{digest}"><figcaption>{html.escape(caption)}</figcaption></figure>'
            pages.append(f"<html><body><h1>Document {doc_id}</h1>{''.join(lines[:half])}{figure}{''.join(lines[half:])}</body></html>")
            sizes.append(len(text.encode()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], ["doc_id", "n_bytes", "html"])


def document_pages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, html: a page for each row. It has the text's lines as paragraphs, in the middle its payload as an image with its first words as caption."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pages, "doc_id long, n_bytes long, html string")


def document_sequences(docs: DataFrame) -> DataFrame:
    """page_id (doc_id), n_bytes, items: the document's page as an interleaved sequence, for each row of docs."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(map(parse_page, batch.column("html").to_pylist()), pa.list_(ITEM))], ["page_id", "n_bytes", "items"])

    return document_pages(docs).mapInArrow(parsed, f"page_id long, n_bytes long, items array<{ITEM_DDL}>")


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption for each row of docs.

    Through pages: each is parsed into a sequence, its reference is joined to the media table by digest. position and
    caption are those of the image in its page's sequence. Null texts count as empty (64 zero bytes). Repeated rows and
    null ids are kept as they are; other columns are not read.
    """
    found = resolve(document_sequences(docs), describe_media(media_table(docs))).where("kind = 'image'")
    return found.select(F.col("page_id").alias("doc_id"), "n_bytes", *(c.split()[0] for c in DESCRIBED.split(", ")), "position", "caption")

"""Media columns: interleaved documents of text and media references, and the payloads behind them.

`parse_sequences` turns HTML into one row per document with an ordered array of structs
(position, kind, text, digest, caption, source). A media reference is an element with a `data-digest`
attribute, a `digest:` source or any other source (its digest is null then); the caption is its figcaption,
else its alt text, and stays in the reference's own struct, so positions and captions remain aligned. A
figcaption of a figure without a reference is text. A figcaption that is never closed ends with its figure or
the document; outside a figure the tag is no more than a block of text.
`store_samples` puts payloads into 8-bit PCM WAV, reads the stored bytes back and describes them, one
row for each distinct digest. `resolve` joins the references of all documents with such a store by
digest, `gather` puts the results back in order; without `with_media` no payload is shuffled.

Defined cases: null or empty HTML gives an empty sequence; a null payload is empty and is padded to
64 zero bytes; references without a stored payload keep null payload columns; repeated references
and repeated rows each get the payload; equal payloads are one row of the store; broken markup is read as far
as html.parser reads it; very long pages and payloads are taken whole, each in one task; empty tables give
empty tables; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("source", pa.string())])
ITEM_DDL = "struct<position:int,kind:string,text:string,digest:string,caption:string,source:string>"
STORE_SCHEMA = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
SAMPLE_RATE = 8000
#: Elements whose content is no text of the document.
HIDDEN = {"script", "style", "template", "noscript"}
#: Elements that end a stretch of text.
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "section", "article", "figure", "figcaption", "blockquote", "pre", "header", "footer", "nav"}
MEDIA = {"img", "audio", "video", "source", "embed", "object"}


class SequenceParser(HTMLParser):
    """Collects text and media references in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.hidden = 0
        self.figures: list[list[int]] = []  # of open figures, the places of their references

    def flush(self) -> None:
        self.say(self.text)
        self.text = []

    def say(self, parts: list[str]) -> None:
        if said := " ".join("".join(parts).split()):
            self.items.append({"kind": "text", "text": said, "digest": None, "caption": None, "source": None})

    def end_caption(self) -> None:
        """What was said becomes the caption of the figure's references, or text where it has none."""
        parts, self.caption = self.caption, None
        if parts is None:
            return
        if self.figures and self.figures[-1]:
            said = " ".join("".join(parts).split())
            for k in self.figures[-1]:
                self.items[k]["caption"] = said or self.items[k]["caption"]
        else:
            self.say(parts)

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if self.caption is not None and tag in BLOCKS:
            self.caption.append(" ")
        elif tag in BLOCKS or tag in MEDIA:
            self.flush()
        if tag == "figure":
            self.end_caption()
            self.figures.append([])
        if tag == "figcaption" and self.figures:
            self.end_caption()
            self.caption = []
        if tag in MEDIA:
            at = dict(attrs)
            source = at.get("src") or at.get("data") or ""
            digest = at.get("data-digest") or (source[7:] if source.startswith("digest:") else "")
            if digest or source:
                self.items.append({"kind": "media", "text": None, "digest": digest or None, "caption": at.get("alt") or None, "source": source or None})
                if self.figures:
                    self.figures[-1].append(len(self.items) - 1)

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in ("figcaption", "figure"):
            self.end_caption()
        if tag == "figure" and self.figures:
            self.flush()
            self.figures.pop()
        elif tag in BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)

    def finish(self) -> None:
        self.close()
        self.end_caption()
        self.flush()


def parse_html(html: str | None) -> list[dict]:
    parser = SequenceParser()
    parser.feed(html or "")
    parser.finish()
    return [{"position": k} | x for k, x in enumerate(parser.items)]


def parse_sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and items, an array of ITEM_DDL in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = pa.array([parse_html(x) for x in b.column(1).to_pylist()], pa.list_(ITEM))
            yield pa.RecordBatch.from_arrays([b.column(0), items], [key, "items"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, items array<{ITEM_DDL}>")


def to_wav(payload: bytes) -> bytes:
    """payload as the samples of an 8-bit mono PCM WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def features(samples: bytes) -> str:
    """Level, energy, crossings of the middle line and a 16-step histogram, all in whole numbers."""
    x = np.frombuffer(samples, np.uint8)
    centred = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    steps = np.bincount(x >> 4, minlength=16) * 1000 // max(1, len(x))
    return f"n={len(x)};sum={int(centred.sum())};energy={int((centred * centred).sum())};crossings={crossings};levels={','.join(map(str, steps))}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded length, UTF-8 bytes padded with zeros to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def store_samples(texts: DataFrame, column: str = "text", with_media: bool = False) -> DataFrame:
    """STORE_SCHEMA (and the stored bytes as `media`), one row for each distinct digest, the SHA-256 of
    the unpadded payload. Equal payloads in different tasks meet as short rows only, unless with_media."""
    schema = STORE_SCHEMA + (", media binary" if with_media else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {}
            for text in b.column(0):
                n, payload = payload_of(text.as_py())
                digest = hashlib.sha256(memoryview(payload)[:n]).hexdigest()
                if digest in rows:
                    continue
                stored = to_wav(payload)
                back = from_wav(stored)
                row = (digest, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back))
                rows[digest] = row + (stored,) * with_media
            cols = list(zip(*rows.values(), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return texts.select(column).mapInArrow(run, schema).groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


def resolve(sequences: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """One row per media reference: key, position, caption, digest and the store's columns (null where
    the store lacks the digest). The join is on the digest; adaptive execution splits hot digests."""
    refs = sequences.select(key, F.explode("items").alias("item")).filter("item.kind = 'media'")
    return refs.select(key, "item.position", "item.caption", "item.digest").join(store, "digest", "left")


def gather(sequences: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Sequences with the resolved columns beside each item, in document order (key identifies a document)."""
    items = sequences.select(key, F.posexplode("items").alias("at", "item"))
    extra = [c for c in resolved.columns if c not in (key, "position", "caption", "digest")]
    one = resolved.dropDuplicates([key, "position"]).select(key, F.col("position").alias("at"), F.struct(*extra).alias("payload"))
    joined = items.join(one, [key, "at"], "left")
    return joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "item", "payload"))).alias("items"))

"""Media columns with baseline JPEG.

:func:`store_texts` keeps bytes losslessly in images whose 8 by 8 blocks are
flat, one per byte (a DC step of 8 makes the quantised DC coefficient the
sample itself). :func:`describe_media` reads any baseline JPEG column: it
parses markers, Huffman-decodes the scan, rebuilds the DC-only luminance
thumbnail and reports dimensions and hashes.

Defined cases: a null text is the empty text, whose payload is 576 bytes of
255; null media give null results; media that cannot be read give null results
and the reason in ``error`` (also where a scan ends before its image, or is too
short for the dimensions it claims); bytes after an image that start no other
one are ignored; payloads too long for one image are stored as a
sequence of images.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import crc_of, named, text_slices, texts_of
from .jpeg import JpegError, decode_luminance, encode_payloads, parse_all, thumbnail_hash

UNIT = 576
FILL = b"\xff"
SLICE = 1 << 20


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + FILL * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text as a JPEG."""

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch, limit=SLICE):
                texts = texts_of(batch, a, b)
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                media = encode_payloads([payload_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


MEDIA_FIELDS = "width int, height int, images int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _read(blobs: list[bytes | None]) -> list[tuple]:
    """The result fields of each column value."""
    frames, of, rows = [], [], []
    for k, blob in enumerate(blobs):
        if blob is None:
            rows.append((None,) * 10)
            continue
        try:
            found = parse_all(blob)
        except JpegError as e:
            rows.append((*(None,) * 6, len(blob), hashlib.sha256(blob).hexdigest(), None, str(e)))
            continue
        rows.append(found)
        frames += found
        of += [k] * len(found)
    thumbs: dict[int, list] = {}
    for k, thumb in zip(of, decode_luminance(frames), strict=True):
        thumbs.setdefault(k, []).append(thumb)
    for k, held in thumbs.items():
        blob, found = blobs[k], rows[k]
        base = (len(blob), hashlib.sha256(blob).hexdigest())
        wrong = next((t for t in held if isinstance(t, JpegError)), None)
        if wrong is not None:
            rows[k] = (*(None,) * 6, *base, None, str(wrong))
            continue
        feature = f"{found[0].width}x{found[0].height}:" + "-".join(map(thumbnail_hash, held))
        samples = b"".join(t.tobytes() for t in held)
        rows[k] = (found[0].width, found[0].height, len(found), len(samples), hashlib.sha256(samples).hexdigest(), crc_of(samples[-32:]), *base, feature, None)
    return rows


def describe_media(df: DataFrame, column: str = "media") -> DataFrame:
    """The columns of ``df`` without ``column``, and ``MEDIA_FIELDS`` for it.

    The payload is the thumbnail of component 0, a byte per block: its length,
    hash and the checksum of its last 32 bytes are taken where it is decoded. A
    field whose name ``df`` has already is called after the column,
    as ``media_width``.
    """
    others = [c for c in df.columns if c != column]
    names, kinds = [], []
    for name, kind in (f.split() for f in MEDIA_FIELDS.split(", ")):
        kinds.append(kind)
        while name in others or name in names:
            name = f"{column}_{name}"
        names.append(name)
    schema = T.StructType([*(df.schema[c] for c in others), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds, strict=True))])

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch, column, SLICE):
                rows = _read(texts_of(batch, a, b, column))
                kept = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in others]
                found = [pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=[*others, *names])

    return df.select(*[named(c) for c in (*others, column)]).mapInArrow(run, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text, read it back, and return the digests of what was read."""
    return describe_media(store_texts(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

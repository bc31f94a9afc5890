"""Media columns: interleaved documents whose media references are resolved by digest.

A page becomes an ordered sequence of structs (position, kind, text, digest,
caption).  Media live in a store keyed by the SHA-256 of their payload, written
once in the shared folder; a reference is joined to what the store holds under
its digest.  Positions and captions travel with the reference, so a sequence is
put together again in order.

Payload bytes never take part in a shuffle: the store is written and read back
by maps, and only digests and what was computed from the bytes read back (sizes,
hashes, features) are joined.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import shared, textbytes

#: Samples of a row of a stored image; payloads are padded to a multiple of it with FILL.
WIDTH, FILL = 576, 255
PREFIX = "sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(raw: bytes, width: int = WIDTH) -> bytes:
    return raw + bytes([FILL]) * (width * max(1, -(-len(raw) // width)) - len(raw))


def encode_image(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A greyscale PNG with one 8-bit sample for each byte."""
    rows = len(payload) // width
    lines = np.zeros((rows, width + 1), dtype=np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, width)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def decode_image(data: bytes) -> np.ndarray:
    """Samples (rows, width) of such an image; checks every chunk's CRC."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not an image")
    at, parts, shape = len(_SIGNATURE), [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IHDR":
            width, rows = struct.unpack_from(">II", body)
            shape = (rows, width + 1)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(shape)[:, 1:]


def image_feature(samples: np.ndarray) -> str:
    """Mean, spread, and a 64-bit difference hash of an 8 x 9 grid of means."""
    flat = samples.reshape(-1).astype(np.float64)
    edges = np.linspace(0, len(flat), 73).astype(np.int64)[:-1]
    grid = np.add.reduceat(flat, edges).reshape(8, 9) / np.diff(np.append(edges, len(flat))).reshape(8, 9)
    bits = (grid[:, 1:] > grid[:, :-1]).reshape(-1)
    return f"{flat.mean():.4f}:{flat.std():.4f}:{np.packbits(bits).tobytes().hex()}"


class _Interleaver(HTMLParser):
    """Text runs and media references in document order.

    A caption belongs to the media of its own figure, before it or after it, and of no
    other; figures may be nested, and captions are attached when a figure ends.
    """

    _BREAKS = frozenset("p div li h1 h2 h3 h4 h5 h6 br hr tr td th section article figure figcaption blockquote pre ul ol table".split())
    #: Elements whose text is no text of the page; the parser itself reads script and style as raw text.
    _SILENT = frozenset(("script", "style", "noscript", "template"))
    _MEDIA = frozenset(("img", "video", "audio", "source", "embed"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent: list[str] = []
        self.titled = False
        self.figures: list[tuple[list[int], list[str]]] = []  # open figures: items of their media, captions
        self.caption: list[str] | None = None

    def flush(self) -> None:
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.items.append({"kind": "text", "text": run, "digest": None, "url": None, "caption": None})

    def _close_caption(self) -> None:
        if self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if text and self.figures:
                self.figures[-1][1].append(text)
            elif text:  # outside a figure it is text like any other
                self.items.append({"kind": "text", "text": text, "digest": None, "url": None, "caption": None})

    def _close_figure(self) -> None:
        self._close_caption()
        media, captions = self.figures.pop()
        if captions:
            for k in media:
                self.items[k]["caption"] = " ".join(captions)

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (self.silent and tag in ("body", "article", "main")):
            self.silent = []
        if tag in self._BREAKS or tag == "body":
            self.titled = False  # a title that is never closed ends where the page begins
        if tag == "title" and not self.items:
            self.titled = True
        elif tag in self._SILENT:
            self.silent.append(tag)
        if tag == "figcaption":
            self._close_caption()
            self.flush()
            self.caption = []
        elif tag in self._BREAKS:
            self.flush()
        if tag == "figure":
            self._close_caption()
            self.figures.append(([], []))
        if tag in self._MEDIA and not self.silent:
            held = dict(attrs)
            if src := (held.get("src") or "").strip():
                self.flush()
                named = src.startswith(PREFIX)
                if self.figures:
                    self.figures[-1][0].append(len(self.items))
                self.items.append({"kind": "media", "text": None, "digest": src.removeprefix(PREFIX) if named else None, "url": None if named else src, "caption": held.get("alt")})

    def handle_endtag(self, tag):
        if tag == "title":
            self.titled = False
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        if tag in ("head", "body", "html") and self.silent:
            self.silent = []  # what was left open ends with its part of the page
        if tag == "figcaption":
            self._close_caption()
        elif tag in self._BREAKS:
            self.flush()
        if tag == "figure" and self.figures:
            self._close_figure()

    def handle_data(self, data):
        if not self.silent and not self.titled:
            (self.text if self.caption is None else self.caption).append(data)

    def done(self) -> list[dict]:
        self.close()
        while self.figures:
            self._close_figure()
        self._close_caption()
        self.flush()
        return self.items


def interleave(html: str) -> list[dict]:
    """Items of a page: position, kind, text, digest (of a reference by digest), url (of another one), caption."""
    parser = _Interleaver()
    parser.feed(html)
    return [{"position": k, **item} for k, item in enumerate(parser.done())]


ITEM = "struct<position:int,kind:string,text:string,digest:string,url:string,caption:string>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "digest", "url", "caption"))]))


def parse_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, items`` of every row: its ordered text and media-reference structs.

    Null or empty HTML: no items.  Unclosed and unknown tags are tolerated: a title
    ends where the page's text begins, a silent part with its head or body.  A
    reference by another address than a digest has its ``url`` and no digest.
    Repeated rows are parsed by themselves; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([interleave(h) for h in part.column(1).to_pylist()], _ITEM)], names=["page_id", "items"])

    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return read.mapInArrow(run, f"page_id long, items array<{ITEM}>")


def write_store(texts: DataFrame, path: str, *, text_col: str = "text", width: int = WIDTH) -> None:
    """Write ``digest, media`` rows: every payload as an image under the SHA-256 of the payload.

    Copies within a slice of rows are written once; copies elsewhere are harmless,
    readers take one row for each digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in textbytes.slices(batch.column(0)):
                raw, out = buf.tobytes(), {}
                for i, j in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    payload = payload_of(raw[i:j], width)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in out:
                        out[digest] = encode_image(payload, width)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.binary())], names=["digest", "media"])

    texts.select(shared.text_column(texts, text_col).alias("text")).mapInArrow(run, "digest string, media binary").write.parquet(path)


def describe_store(store: DataFrame) -> DataFrame:
    """One row for each digest, from the stored bytes: payload and media sizes, hashes and feature.

    Raises on an image that is damaged or whose payload is not what its digest says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                media = media.as_py()
                samples = decode_image(media)
                payload = samples.tobytes()
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"the store holds another payload under {digest}")
                rows.append((digest, len(payload), found, zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(samples)))
            cols = list(zip(*rows)) if rows else [()] * 7
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=list(DESCRIBED))

    described = store.select("digest", "media").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in DESCRIBED.items()))
    return described.dropDuplicates(["digest"])


DESCRIBED = {"digest": "string", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


#: A digest is hot if more references name it than this and than this share (1 / HOT_DIGESTS) of those of all such digests; its references are spread over SPREAD parts.
HOT_REFERENCES, HOT_DIGESTS, SPREAD = 1000, 2000, 16
ITEM_COLUMNS = ("page_id", "page", "position", "kind", "text", "digest", "url", "caption")


def hot_digests(parsed: DataFrame) -> list[str]:
    """At most HOT_DIGESTS digests, counted over all references; partitions combine before the shuffle."""
    named = parsed.select(F.explode(F.filter("items", lambda i: i["digest"].isNotNull())).alias("i")).groupBy(F.col("i.digest").alias("digest")).agg(F.count("*").alias("n"))
    often = shared.cut(named.where(F.col("n") > HOT_REFERENCES))
    if (total := often.agg(F.sum("n")).first()[0]) is None:
        return []
    return [r["digest"] for r in often.where(F.col("n") > total // HOT_DIGESTS).select("digest").collect()]


def resolve(parsed: DataFrame, store: DataFrame) -> DataFrame:
    """One row for each item: ``page_id, page, position, kind, text, digest, url, caption`` and the store's columns.

    ``page`` numbers the rows of ``parsed``, so pages that share an id stay apart.
    Text items, references by url and digests that the store lacks have nulls in the
    store's columns.  Store columns named like an item's are left out, others keep whatever name they have.  Equal
    references give equal rows; empty pages or an empty store give no items or nulls.  Items without
    a digest are dealt by their own place; references of a hot digest are spread over
    several parts, each of which has the store's row.
    """
    name = shared.fresh(parsed, "page")
    items = parsed.withColumn(name, F.monotonically_increasing_id()).select("page_id", F.col(name).alias("page"), F.explode("items").alias("i")).select("page_id", "page", "i.*")
    taken = {c.lower() for c in ITEM_COLUMNS}
    rest = [c for c in store.columns if c.lower() not in taken]
    key, part = (shared.fresh_of([*ITEM_COLUMNS, *rest], c) for c in ("item_key", "item_part"))
    own = F.coalesce("digest", F.concat_ws(":", F.lit("no digest"), "page", "position"))
    rows, kept = items.withColumn(key, own), store.select(F.col("digest").alias(key), *rest)
    on = [key]
    if hot := hot_digests(parsed):
        spread = F.col(key).isin(hot)
        rows = rows.withColumn(part, F.when(spread, F.pmod(F.xxhash64("page", "position"), F.lit(SPREAD))).otherwise(0).cast("int"))
        kept = kept.withColumn(part, F.explode(F.when(spread, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
        on = [key, part]
    return rows.join(kept, on, "left").select(*ITEM_COLUMNS, *rest)


def assemble(items: DataFrame) -> DataFrame:
    """``page_id, items``: each page's items in order again, payload columns included; a page without items has no row.

    Items come by position; pages that share an id stay apart; an empty table gives no rows.
    """
    rest = [c for c in items.columns if c not in ("page_id", "page", "position")]
    return items.groupBy("page_id", "page").agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias("items")).drop("page")


def store_path(spark) -> str:
    """A new folder inside the shared checkpoint folder."""
    shared.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/media-{uuid.uuid4().hex}"


def document_page(id_col, parts: list, caption):
    """HTML of a document as paragraphs and figures: ``parts`` are (before, digest) column pairs in order."""
    out = [F.lit("<article><h1>Document "), F.coalesce(id_col.cast("string"), F.lit("without id")), F.lit("</h1>")]
    for before, digest in parts:
        out += [F.lit("<p>"), before, F.lit(f'</p><figure><img src="{PREFIX}'), digest, F.lit('" alt="text as image"><figcaption>'), caption, F.lit("</figcaption></figure>")]
    return F.concat(*out, F.lit("</article>"))


def document_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, path: str | None = None) -> DataFrame:
    """Every document as a page of text and one image of its text, resolved through the store and put together again.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, position, caption, n_items``, read from the
    assembled sequence; raises if its media do not stand alone between their texts.

    Null or empty text: one row of fill.  Null document id: kept.  Repeated rows:
    one result each, one stored payload.  Empty table: no rows.  The store is
    written here, in ``path`` or a new folder of the checkpoint folder, and stays
    there for who reads the result; it belongs to the caller.
    """
    spark = docs.sparkSession
    text = shared.text_column(docs, text_col)
    path = path or store_path(spark)
    write_store(docs, path, text_col=text_col, width=width)
    n = F.octet_length(text).cast("long")
    rest = F.lit(width) * F.greatest(F.lit(1), F.ceil(n / width)) - n
    payload = F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit(f"{FILL:02x}"), rest.cast("int"))))
    page = document_page(F.col(id_col), [(F.lit("Its text:"), F.sha2(payload, 256))], F.concat(n.cast("string"), F.lit(" bytes")))
    pages = docs.select(F.col(id_col).cast("long").alias("page_id"), page.alias("html"))
    whole = assemble(resolve(parse_pages(pages), describe_store(spark.read.parquet(path))))
    media = F.filter("items", lambda i: i["kind"] == "media")
    fits = (F.size(media) == 1) & (F.size("items") == 3) & (media[0]["position"] == 2)
    out = whole.select("page_id", media[0].alias("m"), F.size("items").alias("n_items"), F.assert_true(fits, "a page's items are out of order").alias("checked")).where("checked is null")
    return out.select(F.col("page_id").alias("doc_id"), F.split("m.caption", " ")[0].cast("long").alias("n_bytes"), *(F.col(f"m.{c}").alias(c) for c in DESCRIBED if c != "digest"), "m.position", "m.caption", "n_items")

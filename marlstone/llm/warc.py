"""WARC archives in Zstandard: a writer, and a reader of dictionary frames and one frame per record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed or not; each
record is a frame of its own. The reader finds the frames by their block headers, decodes each with the dictionary,
whether or not it says its length, and checks version, headers, lengths and the payload's digest; a frame or record that
fails raises ValueError. Archives are kept as rows (archive, body) of a table in the shared folder, which any store of
Spark's can hold; files() reads .warc.zst files of others as such rows (each is held in memory, so up to 2 GB).

Archives of others: records that are neither response nor revisit (warcinfo, request, metadata, ...) are validated and passed over; ids that aren't of
pages stay text (record_id, refers_to_id, with page_id and refers_to null). A payload is checked against the digest its header declares, of the algorithm
it names, in base 32 or hex; one without a digest or of an algorithm not known here is only measured. Chunked bodies are joined. A body may be shorter
than its HTTP header says only where the record says WARC-Truncated. payload_digest is the SHA-256 of the payload, null for a revisit that declares another.

Defined cases: a null html is an empty payload; a null url leaves out the target header; line breaks in a url are
escaped; repeated rows with the same page_id and payload are all responses if that page_id is the smallest; a null
page_id comes after all others; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Payloads of fewer bytes are never replaced by a revisit record.
MIN_REVISIT = 100
#: The dictionary is fitted on this many pages at most, of so many bytes each at most.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 32_768, 65_536
#: An archive is closed when its records, before compression, exceed this.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from samples; too few or too small samples give their own bytes, and none an empty one."""
    samples = [s[:SAMPLE_BYTES] for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def opened(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its header and its blocks' headers."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut short")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut short")
    return at


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, checked."""
    data, at = memoryview(archive), 0
    decoder = zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("bytes after the last frame")
        magic, n = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at == 0 and magic == DICTIONARY_MAGIC:
                held = bytes(data[8 : 8 + n])
                if len(held) != n:
                    raise ValueError("the dictionary is cut short")
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = decoded(zstandard.ZstdDecompressor(), held)
                d = _dictionary(held)
                decoder = zstandard.ZstdDecompressor(dict_data=d) if d else decoder
            at += 8 + n
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        end = frame_end(data, at)
        yield parse(decoded(decoder, bytes(data[at:end])))
        at = end


def decoded(decoder: zstandard.ZstdDecompressor, frame: bytes) -> bytes:
    """One frame's content; writers that stream leave out its length."""
    try:
        out = decoder.decompressobj()
        raw = out.decompress(frame)
    except zstandard.ZstdError as e:
        raise ValueError(f"a frame can't be decoded: {e}") from e
    if not out.eof:
        raise ValueError("a frame is cut short")
    return raw


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record in the frame")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:  # a header that goes on in the next line
            headers[name] = f"{headers[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError(f"not a header: {line[:80]!r}")
        headers[name] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ValueError(f"headers are missing: {sorted(missing)}")
    n = length(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {n}")
    return headers, rest[:n]


def length(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"not a length: {text[:40]!r}")
    return int(text)


def http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of an HTTP message; a block that is none is all body."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}, body


def joined(body: bytes) -> bytes:
    """A chunked body's content."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("a chunked body is cut short")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunked body is cut short")
        out.append(body[at : at + n])
        at += n + 2


#: Digests that a header may declare, by name, with their sizes in bytes.
ALGORITHMS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def declared(text: str) -> tuple[str, bytes] | None:
    """Algorithm and value of a digest header; None if the algorithm isn't known here."""
    name, _, value = text.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ALGORITHMS:
        return None
    size, value = ALGORITHMS[name], value.strip()
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.rstrip("=").upper() + "=" * (-len(value.rstrip("=")) % 8))
    except ValueError as e:
        raise ValueError(f"not a digest: {text[:160]!r}") from e
    if len(raw) != size:
        raise ValueError(f"not a digest: {text[:160]!r}")
    return name, raw


def _number(identity: str | None) -> int | None:
    """N of <urn:page:N>; None of any other id."""
    of_page = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", identity or "")
    return int(of_page[1]) if of_page else None


def page(headers: dict[str, str], block: bytes) -> dict | None:
    """The fields of a page from its record, None from a record of another type; a response's payload is checked against its length and digest."""
    kind, identity = headers["warc-type"].lower(), headers["warc-record-id"]
    if kind not in ("response", "revisit"):
        return None
    fields, body = http(block)
    told = length(fields["content-length"]) if "content-length" in fields else None
    digest = declared(headers.get("warc-payload-digest", ""))
    sha256 = digest[1].hex() if digest and digest[0] == "sha256" else None
    payload = None
    if kind == "response":
        payload, right = body, digest is None or hashlib.new(digest[0], body).digest() == digest[1]
        if "chunked" in fields.get("transfer-encoding", "").lower():
            payload, told = joined(body), None  # writers take the digest of either form
            right = right or hashlib.new(digest[0], payload).digest() == digest[1]
        short = "warc-truncated" in headers and told is not None and len(payload) < told
        if not right or (told is not None and len(payload) != told and not short):
            raise ValueError(f"the payload of {identity} doesn't match its length or digest")
        told = len(payload)
        if sha256 is None or payload is not body:
            sha256 = hashlib.sha256(payload).hexdigest()
    refers = headers.get("warc-refers-to")
    return {
        "page_id": _number(identity), "url": headers.get("warc-target-uri"), "payload": payload, "payload_bytes": told, "payload_digest": sha256, "record_type": kind,
        "refers_to": _number(refers), "record_id": identity, "refers_to_id": refers,
    }


def plan(pages: DataFrame) -> DataFrame:
    """Which pages become responses and which revisit another; page ids per digest are reduced before they are joined."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.length("payload"))
    first = p.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "first")
    return p.join(first, "digest", "left").withColumn("revisit", F.expr(f"n >= {MIN_REVISIT} and first is not null and not (page_id <=> first)")).select(
        "page_id", "url", "payload", "digest", F.expr("case when revisit then 'revisit' else 'response' end").alias("kind"), F.expr("case when revisit then first end").alias("refers_to")
    )


def write(pages: DataFrame) -> DataFrame:
    """Archives (archive, body) of all pages, written to the shared folder."""
    ids = pages.filter("page_id is not null and html is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).collect()
    sample = pages.filter(F.col("page_id").isin([r["page_id"] for r in ids])).select(F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("b")).filter("b is not null").limit(SAMPLE_PAGES)
    dictionary = train(sorted(bytes(r["b"]) for r in sample.collect()))  # ids first: what tasks send is SAMPLE_PAGES numbers, then SAMPLE_PAGES rows of SAMPLE_BYTES in all
    start = opened(dictionary)

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = _dictionary(dictionary)
        packer = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True) if d else zstandard.ZstdCompressor(level=3, write_checksum=True)
        frames, size, name = [start], 0, None
        for pdf in batches:
            for page_id, url, payload, digest, kind, refers in pdf.itertuples(index=False, name=None):
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                raw = record(page_id, url, bytes(payload), digest, kind, refers)
                frames.append(packer.compress(raw))
                size += len(raw)
                name = name or f"{page_id}-{digest[:12]}"
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"archive": [f"{name}.warc.zst"], "body": [b"".join(frames)]})
                    frames, size, name = [start], 0, None
        if name:
            yield pd.DataFrame({"archive": [f"{name}.warc.zst"], "body": [b"".join(frames)]})

    return materialise(plan(pages).mapInPandas(archives, "archive string, body binary"), "warc")


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"


def read(archives: DataFrame) -> DataFrame:
    """All pages of archives, with payloads (null for revisits)."""
    columns = [c.split(" ")[0] for c in READ.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body in pdf["body"]:
                rows, size = [], 0
                for headers, block in records(bytes(body)):
                    found = page(headers, block)
                    if found is None:
                        continue
                    rows.append(found)
                    size += len(block)
                    if size > ARCHIVE_BYTES // 4:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    return archives.select("body").mapInPandas(pages, READ)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Archives (archive, body) of the files that a path or pattern names."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("body"))


def digest(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to FROM q
"""

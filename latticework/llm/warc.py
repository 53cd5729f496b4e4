"""WARC archives as Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, ship, shared_dir, stored

#: Magic numbers: the skippable frame that holds the dictionary, and a Zstandard frame.
SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: The dictionary is trained on up to SAMPLE_ROWS payloads, SAMPLE_BYTES of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 256, 16_384, 65_536
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
#: A writer starts another archive beyond this size, so an archive is read by one task in bounded memory.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3


#: A date as WARC/1.1 takes it: a year at least, up to fractions of a second in UTC.
DATE = re.compile(r"\d{4}(?:-\d\d(?:-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?Z)?)?)?")


class WarcError(ValueError):
    """An archive that is not as the format demands."""


def train(samples: list[bytes]) -> bytes:
    """A dictionary; empty if there is too little to train on."""
    import zstandard as z

    samples = [s for s in samples if s]
    if len(samples) < 8 or sum(map(len, samples)) < 20_000:
        return b""
    try:
        return z.train_dictionary(DICT_BYTES, samples).as_bytes()
    except z.ZstdError:
        return b""


def head(dictionary: bytes) -> bytes:
    """The leading skippable frame."""
    return struct.pack("<II", SKIP_MAGIC, len(dictionary)) + dictionary


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record. Values must hold no line ends."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record; raises WarcError unless version, header lines, mandatory fields, length and end all hold."""
    top, sep, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "strict").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or not k.strip():
            raise WarcError(f"bad header line {line!r}")
        k = k.strip().lower()
        if k in fields and k != "warc-concurrent-to":
            raise WarcError(f"{k} twice")
        fields[k] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise WarcError(f"no {k}")
    if not DATE.fullmatch(fields["warc-date"]):
        raise WarcError(f"bad date {fields['warc-date']!r}")
    n = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("the length does not hold")
    return fields, rest[:n]


def read_records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an open archive, one frame at a time, with no more than a frame and a piece of the file in memory."""
    import zstandard as z

    buf = f.read(8)
    if len(buf) < 8:
        raise WarcError("too short")
    magic, n = struct.unpack("<II", buf)
    if magic != SKIP_MAGIC:
        raise WarcError("no leading skippable frame")
    d = f.read(n)
    if len(d) != n:
        raise WarcError("the dictionary is cut off")
    if d[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
        d = z.ZstdDecompressor().decompressobj().decompress(d)
    ctx = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(d)) if d else z.ZstdDecompressor()
    rest = b""
    while True:
        one, parts = ctx.decompressobj(), []
        while not one.eof:
            rest = rest or f.read(1 << 20)
            if not rest:
                if parts:
                    raise WarcError("a frame is cut off")
                return
            try:
                parts.append(one.decompress(rest))
            except z.ZstdError as e:
                raise WarcError(f"a bad frame: {e}") from None
            rest = one.unused_data if one.eof else b""
        yield parse(b"".join(parts))


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_archives(records: DataFrame, dictionary: bytes, where: str, date: str) -> DataFrame:
    """Write rows (kind, id, url, digest, refers, frame) as archives below `where`; returns the manifest (path, records, bytes).

    frame: a compressed response record, used as it is; rows without one become revisit records. A task writes under a
    name of its own; only archives whose names are in the manifest count, so repeated tasks do no harm.
    """
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        ctx = z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(dictionary)) if dictionary else z.ZstdCompressor(level=LEVEL)
        fs, top = _fs(where)
        fs.create_dir(top, recursive=True)
        out, done = None, []

        def end():
            nonlocal out
            if out:
                out.close()
                out = None

        for b in batches:
            for r in b.to_pylist():
                if out is None or done[-1][2] > ARCHIVE_BYTES:
                    end()
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    out.write(head(dictionary))
                    done.append([f"{where}/{name}", 0, 8 + len(dictionary)])
                frame = r["frame"]
                if frame is None:
                    frame = ctx.compress(record("revisit", _fields(date, r["id"], r["url"], r["digest"], r["size"], r["refers"]), b""))
                out.write(frame)
                done[-1][1] += 1
                done[-1][2] += len(frame)
        end()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return stored(records.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def _fields(date, page, url, digest, size, refers=None) -> dict[str, str]:
    from urllib.parse import quote

    out = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date}
    if url is not None:
        out["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "")) if any(c in url for c in "\r\n") or not url.isascii() else url
    if page is not None:
        out["X-Page-ID"] = str(page)
    out |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Bytes": str(size)}
    if refers is not None:
        out |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": str(refers)}
    return out


NAMES = ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "url", "payload"]
SHAPE = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, payload binary"


def _read(manifest: DataFrame, payloads: bool) -> DataFrame:
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)
        for b in batches:
            for m in b.to_pylist():
                fs, path = _fs(m["path"])
                rows, n, held = [], 0, 0
                with fs.open_input_stream(path, compression=None) as f:
                    for h, block in read_records(f):
                        n += 1
                        own = h["warc-payload-digest"].removeprefix("sha256:")
                        size, kind = int(h["x-payload-bytes"]), h["warc-type"]
                        if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != own):
                            raise WarcError(f"{path}: the payload does not fit its digest or length")
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        if kind == "revisit" and (refers is None or block):
                            raise WarcError(f"{path}: a revisit names no response or has a payload")
                        rows.append((page and int(page), kind, own, size, refers and int(refers), h.get("warc-target-uri"), block if payloads and kind == "response" else None))
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                if n != m["records"]:
                    raise WarcError(f"{path}: {n} records, not {m['records']}")
                if rows:
                    yield batch(rows)

    tasks = max(1, manifest.count())
    return manifest.repartition(min(tasks, 100_000), "path").mapInArrow(run, SHAPE)


def read_index(manifest: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_digest, payload_bytes, refers_to, url) of every record of the archives in the manifest, stored.

    Each archive is streamed by one task; headers, lengths and the digests of responses are checked, and the number of
    records must be the manifest's. Then each revisit must name a response of its own digest and length. Errors raise.
    Repeated page_ids are records of their own; no archives give no rows.
    """
    index = stored(_read(manifest, False).drop("payload"), "warc-index")
    # Revisits of one response are one row before they meet the responses, however many they are.
    claimed = index.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    known = index.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    wrong = claimed.join(known, ["refers_to", "payload_digest", "payload_bytes"], "left_anti").head(1)
    if wrong:
        raise WarcError(f"a revisit names page {wrong[0]['refers_to']}, which is no response of its digest and length")
    return index


def read_archives(manifest: DataFrame) -> DataFrame:
    """read_index's rows, checked likewise, with payload (null for revisits)."""
    read_index(manifest)
    return _read(manifest, True)


def archive(pages: DataFrame, where: str | None = None, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Write one record per row of pages into archives below `where` (default: in the shared folder) and return the manifest.

    Payload: the html in UTF-8, empty for null. Of rows with equal payloads of MIN_REVISIT bytes or more, those with the
    smallest page_id are responses (rows that share it all are; null ids come last), the others revisit it.

    Responses are compressed where they are read, so the shuffle that tells revisits from responses moves frames and not
    pages; the smallest ids by digest are summed up before they are shuffled, and the join can split a hot digest.
    date (now, if not given) is every record's. An empty table gives an empty manifest; other columns do not matter.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark: SparkSession = pages.sparkSession
    ship(spark)
    where = where or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    html: Column = F.coalesce(col(html_col), F.lit(""))
    p = pages.select(col(page_col).cast("long").alias("id"), col(url_col).alias("url"), F.encode(html, "UTF-8").alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    sample = pages.select(F.substring(html, 1, SAMPLE_BYTES)).limit(SAMPLE_ROWS).collect()
    dictionary = train([r[0].encode() for r in sample])
    firsts = p.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where((F.col("n") > 1) & F.col("first").isNotNull()).select(F.col("digest").alias("d"), "first")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        ctx = z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(dictionary)) if dictionary else z.ZstdCompressor(level=LEVEL)
        for b in batches:
            frames = [ctx.compress(record("response", _fields(date, r["id"], r["url"], r["digest"], r["size"]), r["payload"])) for s in range(0, b.num_rows, 64) for r in b.slice(s, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), b.column("digest"), b.column("size"), pa.array(frames, pa.binary())], ["id", "url", "digest", "size", "frame"])

    frames = p.mapInArrow(squeeze, "id long, url string, digest string, size long, frame binary")
    joined = frames.join(firsts, F.col("digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = joined.select("id", "url", "digest", "size", F.when(again, F.col("first")).alias("refers"), F.when(~again, F.col("frame")).alias("frame"))
    return write_archives(rows, dictionary, where, date)

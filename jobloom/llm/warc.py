"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by a range of page ids; every task writes its range to files that roll by compressed size, each record a gzip
member of its own. A file is written under a name of its own attempt and renamed when whole; the names, sizes and digests that
the job returns are stored as a manifest, and only files in the manifest are read. A task that runs again writes the same bytes
under the same final names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

ROLL_BYTES = 8 << 20
MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str) -> str:
    """Header values end at the line: control characters and percent signs before hex are written as %XX."""
    return re.sub(r"[\x00-\x1f\x7f]|%(?=[0-9A-Fa-f]{2})", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, revisit: bool) -> bytes:
    """One WARC/1.1 record; headers and digests are made anew from the payload. A revisit leaves the payload out."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    lines += [] if url is None else [f"WARC-Target-URI: {_one_line(url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, n_ranges: int | None = None, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes (page_id, url, html) as WARC files under `folder` and returns the stored manifest.

    Of records with equal payloads of at least `min_bytes` bytes the one with the largest page_id is a response, the others
    revisit it; rows that repeat that page_id are responses too. Null html is an empty payload, a null url leaves its header
    out, null page_ids come first and revisit like others (alone with a payload they are responses). An empty table gives an
    empty manifest. Extra columns are not looked at.
    """
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    narrow = p.where(F.octet_length("html") >= min_bytes).select("page_id", F.unhex(F.sha1("html")).alias("sha"))
    # equal payloads meet as partial maxima; only payloads that occur twice go on
    groups = narrow.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").drop("n")
    # notes (page, digest, page to refer to) are sorted in before their page, so that payloads move once, for the sort
    notes = narrow.join(groups, "sha").where(~F.col("page_id").eqNullSafe(F.col("top"))).distinct().withColumn("kind", F.lit(0))
    both = p.withColumn("kind", F.lit(1)).unionByName(notes, allowMissingColumns=True)
    if n_ranges is None:
        n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = both.repartitionByRange(n_ranges, "page_id").sortWithinPartitions("page_id", "kind", "url", "html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, attempt, made = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], []
        buffer, count, first, last = io.BytesIO(), 0, None, None

        def close() -> None:
            nonlocal buffer, count
            if not count:
                return
            data, name = buffer.getvalue(), f"part-{part:05d}-{len(made):05d}.warc.gz"
            with store.open_output_stream(f"{base}/.{name}.{attempt}") as out:
                out.write(data)
            store.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            made.append((name, count, len(data), hashlib.sha256(data).hexdigest(), first, last))
            buffer, count = io.BytesIO(), 0

        noted: dict[bytes, int] = {}
        page: object = object()
        for b in batches:
            for page_id, url, html, kind, sha, top in zip(b["page_id"], b["url"], b["html"], b["kind"], b["sha"], b["top"], strict=True):
                key = None if pd.isna(page_id) else int(page_id)
                if key != page:
                    page, noted = key, {}
                if kind == 0:
                    noted[bytes(sha)] = int(top)
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                target = noted.get(hashlib.sha1(payload).digest()) if noted else None
                data = record(key, url, payload, target, date, target is not None)
                first = key if not count else first
                last = key
                buffer.write(gzip.compress(data, 6, mtime=0))
                count += 1
                if buffer.tell() >= roll_bytes:
                    close()
        close()
        out = pd.DataFrame(made, columns=[c.split()[0] for c in MANIFEST.split(", ")])
        yield out.astype({"first_id": "Int64", "last_id": "Int64"})

    path = f"{folder}/_manifest"
    sorted_.mapInPandas(run, MANIFEST).write.mode("overwrite").parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def parse_warc(data: bytes) -> Iterator[tuple]:
    """Records of one archive: gzip members one after another, so that one record is open at a time."""
    at = 0
    while at < len(data):
        d, pieces = zlib.decompressobj(31), []
        while not d.eof:  # in small steps: what is left over is copied
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            step = data[at : at + 32_768]
            pieces.append(d.decompress(step))
            at += len(step) - len(d.unused_data)
        raw = b"".join(pieces)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"{fields['WARC-Record-ID']}: its block does not match its digest")
        http, _, body = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        page = lambda s: None if s[10:-1] == "none" else int(s[10:-1])
        revisit = fields["WARC-Type"] == "revisit"
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and base32_sha1(body) != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: its payload does not match its digest")
        url = fields.get("WARC-Target-URI")
        url = url and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 32 or m[1] in ("7F", "25") else m[0], url)
        yield page(fields["WARC-Record-ID"]), url, size, digest, fields["WARC-Type"], page(fields["WARC-Refers-To"]) if revisit else None, None if revisit else body


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Records of the files that the manifest of `folder` names; a file whose size or digest differs is an error."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file", "bytes", "sha256")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = FIELDS if with_payload else FIELDS.rpartition(", ")[0]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, size, sha, content in zip(b["file"], b["bytes"], b["sha256"], b["content"], strict=True):
                if len(content) != size or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                rows = []
                for r in parse_warc(content):
                    rows.append(r[: len(names)])
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.join(manifest, "file").mapInPandas(run, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back; a null html is an empty payload, see `write_warc` for null and repeated ids."""
    folder = Scratch(spark, "warc").path("archive")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder)


QUERIES = {"op9_warc": op9_warc}
ORACLE_SQL: dict[str, str] = {}

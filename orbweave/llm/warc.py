"""WARC records in ZIP packages, read by range.

A package is a ZIP file with stored members: WARC files under archive/, each record a gzip
member of its own, and an index of their records under indexes/. The writer makes packages of bounded size, one task each. The reader parses the end of the central directory (ZIP64
too), locates members, reads the index and then each record by its offset, without unpacking anything. Both go
through a file system named by URI, so packages can lie in any store that the cluster shares.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import cut, scratch_path, table

#: Compressed record bytes that a package holds before the next one starts.
PACKAGE_BYTES = 16_000_000
GZIP_LEVEL = 3
#: Payloads below this size are always stored in full.
REVISIT_BYTES = 100
BATCH_ROWS = 500
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
INDEX, DATA = "indexes/index.cdxj", "archive/data.warc.gz"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- records


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit that keeps the HTTP head of the response but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record: type, id, url, digest, refers_to, payload (None for a revisit), payload_bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    sizes = [int(x.split(":")[1]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")]
    revisit = fields["warc-type"] == "revisit"

    def name(x):
        return x[len("<urn:page:") : -1] if x else None

    return {
        "record_type": fields["warc-type"],
        "page_id": name(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
        "refers_to": name(fields.get("warc-refers-to")),
        "payload": None if revisit else payload,
        "payload_bytes": sizes[0] if sizes else len(payload),
    }


# ---------------------------------------------------------------- packages


def write_package(uri: str, records: list[tuple[str, bytes]], zip64: bool = False) -> int:
    """Write a package whole and put it in place by renaming, so a task that runs twice leaves one good file."""
    index, data, at = [], [], 0
    for name, raw in records:
        index.append(json.dumps({"page": name, "offset": at, "length": len(raw), "filename": DATA}))
        data.append(raw)
        at += len(raw)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, body in ((DATA, b"".join(data)), (INDEX, "\n".join(index).encode())):
            with z.open(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as out:
                out.write(body)
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(buffer.getbuffer())
    fs.move(part, path)
    return buffer.tell()


def members(file) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the data, size, CRC) of each stored member of a ZIP file that can seek."""
    file.seek(0, 2)
    end = file.tell()
    tail_at = max(0, end - 65_557)
    file.seek(tail_at)
    tail = file.read(end - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    locator = at - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\6\7":
        (where,) = struct.unpack_from("<Q", tail, locator + 8)
        file.seek(where)
        entries, size, offset = struct.unpack_from("<QQQ", file.read(56), 32)
    elif 0xFFFFFFFF in (size, offset) or entries == 0xFFFF:
        raise ValueError("ZIP64 directory is missing")
    file.seek(offset)
    directory, found, p = file.read(size), {}, 0
    for _ in range(entries):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, crc, packed, full, n_name, n_extra, n_comment, local = struct.unpack_from("<10xH4xIIIHHH8xI", directory, p)
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + length
        p += 46 + n_name + n_extra + n_comment
        if method == 0:
            file.seek(local)
            n_name, n_extra = struct.unpack_from("<26xHH", file.read(30))
            found[name] = (local + 30 + n_name + n_extra, full, crc)
    return found


def read_index(packages: DataFrame) -> DataFrame:
    """package (URI), offset and length (bytes in the package) of each record of each package."""

    def run(frames):
        for pdf in frames:
            for uri in pdf["package"]:
                fs, path = _open(uri)
                rows = []
                with fs.open_input_file(path) as file:
                    at = members(file)
                    start, size, crc = at[INDEX]
                    file.seek(start)
                    raw = file.read(size)
                    if zlib.crc32(raw) != crc:
                        raise ValueError(f"damaged index in {uri}")
                    for line in raw.decode().split("\n") if raw else []:
                        x = json.loads(line)
                        rows.append((uri, at[x["filename"]][0] + x["offset"], x["length"]))
                yield pd.DataFrame(rows, columns=["package", "offset", "length"])

    return packages.select("package").mapInPandas(run, "package string, offset long, length long")


_RECORD = "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def read_records(index: DataFrame) -> DataFrame:
    """Each indexed record, by range reads; a response whose payload does not match its digest is an error."""
    def run(frames):
        for pdf in frames:
            for start in range(0, len(pdf), 100):
                rows = []
                for uri, own in pdf.iloc[start : start + 100].groupby("package", sort=False):
                    fs, path = _open(uri)
                    with fs.open_input_file(path) as file:
                        for offset, length in zip(own["offset"].tolist(), own["length"].tolist()):
                            file.seek(offset)
                            r = parse_record(gzip.decompress(file.read(length)))
                            if r["payload"] is not None and hashlib.sha256(r["payload"]).hexdigest() != r["payload_digest"]:
                                raise ValueError(f"payload of {r['page_id']} does not match its digest")
                            rows.append(r)
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in _RECORD.split(", ")])

    return index.mapInPandas(run, _RECORD)


def plan_records(pages: DataFrame) -> DataFrame:
    """pages with digest (of the UTF-8 html, null being empty) and refers_to: the smallest page_id of an equal payload
    of REVISIT_BYTES at least, unless that is the page itself."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"))
    shared = (
        pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
        .where(F.col("n") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    shared = cut(shared, "shared-payloads")  # a table, so that the join can split the rows of a very frequent payload
    return keyed.join(shared, "digest", "left").withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).drop("first")


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page to packages in folder; one row per package: package (URI), n_records, n_bytes.

    Null pages are empty payloads; repeated ids and rows each get a record, and long pages are stored whole. Columns
    but page_id, url and html are not read. No pages give no packages. The rows are kept in the shared folder, so a
    later stage never writes packages again, and name the packages of the attempts that were committed; those of others
    (lost executors, speculation) lie beside them and are never read.
    """
    def run(frames):
        # an attempt has packages of its own: another one may see its rows in another order and cut them elsewhere
        task, k, held, size = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", 0, [], 0

        def flush():
            uri = f"{folder}/pages-{task}-{k:05d}.wacz"
            return pd.DataFrame({"package": [uri], "n_records": [len(held)], "n_bytes": [write_package(uri, held)]})

        for pdf in frames:
            for page_id, url, html, digest, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["digest"], pdf["refers"]):
                raw = gzip.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers), GZIP_LEVEL, mtime=0)
                if held and size + len(raw) > PACKAGE_BYTES:
                    yield flush()
                    k, held, size = k + 1, [], 0
                held.append((str(page_id), raw))
                size += len(raw)
        if held:
            yield flush()

    named = plan_records(pages).select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers")
    )
    written = named.mapInPandas(run, "package string, n_records long, n_bytes long")
    return cut(written, "packages", BATCH_ROWS)


def op6_zip_packaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `pages` written to packages and read back: see write_packages for nulls, repeats and empty tables."""
    packages = write_packages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = read_index(packages.repartition(parts))
    return read_records(index).select(
        F.expr("try_cast(page_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f < page_id THEN f END AS refers_to
FROM q
"""

"""WARC archives written with an index, and read back by coalesced byte ranges.

``write`` puts every page into gzip-member WARC files in the shared folder and returns the index:
archive, offset, length, URL and digest per record. Of pages with equal payloads of at least
``min_bytes`` those with the largest page_id are responses; the others are revisits without
payload, which name the response. A lost task writes a new file when it is run again, and the index
names only files of tasks that ended well.

``read`` takes any selection of index rows, sorts it by archive and offset, joins ranges less than
``GAP`` bytes apart up to ``RANGE`` bytes, reads each range once and parses the records in it.

Defined results: a null html is an empty payload. Rows that repeat page_id and payload are all
responses if they hold the largest page_id. A group in which every page_id is null has responses
only. A null URL has no target header; control characters in one are percent-encoded in the header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, ship, stored

ship(__name__)

MIN_BYTES = 0
GAP, RANGE = 64 << 10, 8 << 20
TASK_BYTES = 16 << 20
ARCHIVE_BYTES = 1 << 30
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = ("page_id long, url string, archive string, offset long, length long, payload_digest string, "
         "payload_bytes long, record_type string, refers_to long")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
          "payload_bytes long, payload binary, intact boolean")


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: five hex digits are four base32 digits."""
    code = F.sha1(payload)
    signs = []
    for i in range(8):
        value = F.conv(F.substring(code, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            signs.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*signs)


def plan(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, refers_to): null for responses.

    Only payloads that several pages share are looked up, by digest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("page_id", "url", "payload", sha1_base32(F.col("payload")).alias("payload_digest"),
                       F.octet_length("payload").cast("long").alias("payload_bytes"))
    shared = (
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("payload_digest", "top")
    )
    shared = stored(shared, "shared-payloads")
    rows = rows.join(shared, "payload_digest", "left")
    again = F.col("page_id").isNull() | (F.col("page_id") < F.col("top"))
    return rows.withColumn("refers_to", F.when(again, F.col("top"))).drop("top")


def _name(page_id) -> str:
    return "<urn:x-page:none>" if page_id is None else f"<urn:x-page:{page_id}>"


def _target(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, ready to be compressed."""
    kind = "response" if refers_to is None else "revisit"
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_target(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for r in batch.itertuples(index=False):
                    page, refers = (None if pd.isna(v) else int(v) for v in (r.page_id, r.refers_to))
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    data = member(record(page, r.url, r.payload, r.payload_digest, refers))
                    out.write(data)
                    index.append((page, r.url, f"{folder}/{name}", at, len(data), r.payload_digest,
                                  r.payload_bytes, "response" if refers is None else "revisit", refers))
                    at += len(data)
                yield _frame(index, INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def write(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives and return their stored index."""
    folder = new_folder(pages.sparkSession, "archives")
    return stored(plan(pages, min_bytes).select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to"
    ).mapInPandas(_writer(folder), INDEX), "archive-index")


def parse(data: bytes) -> dict:
    """Headers of one record, with its payload and payload size."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [line.split(": ", 1)[1] for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")]
    return fields | {"payload": payload, "size": int(sizes[0])}


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(archive, begin, end, rows) of coalesced reads for (archive, offset, length) in order."""
    begin = end = 0
    archive, held = "", []
    for k, (name, offset, length) in enumerate(rows):
        if held and (name != archive or offset - end > GAP or offset + length - begin > RANGE):
            yield archive, begin, end, held
            held = []
        if not held:
            archive, begin, end = name, offset, offset
        end = max(end, offset + length)
        held.append(k)
    if held:
        yield archive, begin, end, held


def _page(name: str | None) -> int | None:
    return None if name is None or name == _name(None) else int(name.rpartition(":")[2][:-1])


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = list(zip(batch["archive"], batch["offset"].tolist(), batch["length"].tolist(), strict=True))
        for archive, begin, end, held in ranges(rows):
            system, path = fs.FileSystem.from_uri(archive)
            with system.open_input_file(path) as f:
                f.seek(begin)
                data = f.read(end - begin)
            out = []
            for k in held:
                at = rows[k][1] - begin
                found = parse(zlib.decompress(data[at:at + rows[k][2]], 31))
                digest = found["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = found["WARC-Type"] == "revisit"
                intact = revisit or base64.b32encode(hashlib.sha1(found["payload"]).digest()).decode() == digest
                out.append((_page(found["WARC-Record-ID"]), batch["url"].iloc[k], found["WARC-Type"],
                            _page(found.get("WARC-Refers-To")), digest, found["size"],
                            None if revisit else found["payload"], intact))
            if out:
                yield _frame(out, RECORD)


def read(selected: DataFrame) -> DataFrame:
    """Records of the selected index rows; payload is null for revisits, whose size and digest are
    those of the page they repeat."""
    rows = selected.select("archive", "offset", "length", "url").where("archive is not null")
    # Index rows are small and what they point at is not: tasks are counted by the bytes to read.
    size = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    rows = rows.repartitionByRange(int(size // TASK_BYTES) + 1, "archive", "offset")
    rows = rows.sortWithinPartitions("archive", "offset")
    return rows.mapInPandas(_reader, RECORD)

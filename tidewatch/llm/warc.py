"""WARC archives by way of a chunked record table.

A payload is a run of rows (record identifier, chunk number, bytes, digest of the payload so far): no task holds more of a record than a chunk. Writers turn the
rows of their partition into an archive in the shared folder, one gzip member for each record; readers turn archives into the same rows again. The shared folder
is opened through pyarrow's file systems; an archive is written under a name of its own attempt and counts only if its manifest row says so, so that a repeated task does no harm.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty
from tidewatch.session import checkpoint_dir

#: Bytes of a chunk, and of an archive before the next one begins.
CHUNK, ROLL = 64 << 10, 256 << 20
#: A payload of fewer bytes is always written out.
LEAST = 1000
CHUNKS = "record_id string, chunk_no int, chunk binary, running_sha1 string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string"
MANIFEST = "path string, records long, bytes long"


def decided(pages: DataFrame) -> DataFrame:
    """The pages with record_id, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of LEAST bytes and more the largest page_id is the response, and its rows if it is repeated; a null id is below all others, and alone among nulls is a
    response. The groups are found on digests; payloads are not shuffled by content.
    """
    text = text_or_empty("html")
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), text.alias("html"), F.octet_length(text).cast("long").alias("payload_bytes"), F.sha1(text.cast("binary")).alias("payload_digest"))
    groups = keyed.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("_copies"), F.max("page_id").alias("_last")).where("_copies > 1")
    ids = keyed.select("page_id", "payload_digest").join(groups, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("_last"))).select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "_last").distinct()
    same = keyed["page_id"].eqNullSafe(ids["_id"]) & (keyed["payload_digest"] == ids["_digest"])
    both = keyed.join(ids, same, "left")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    return both.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(F.col("_digest").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("_last").cast("string").alias("refers_to"), name.alias("record_id"))


def chunk_rows(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of the records, in order inside each partition; a revisit and an empty payload have one empty chunk. running() fills running_sha1."""
    body = F.when(F.col("record_type") == "response", F.col("html")).otherwise(F.lit("")).cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(body) / size).cast("int") - 1)
    cut = records.withColumn("_body", body).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    chunk = F.substring(F.col("_body"), F.col("chunk_no") * size + 1, F.lit(size))
    return cut.select("record_id", "chunk_no", chunk.alias("chunk"), F.lit(None).cast("string").alias("running_sha1"), "record_type", "refers_to", F.col("url").alias("target_uri"), "payload_bytes", "payload_digest")


def running(chunks: DataFrame) -> DataFrame:
    """The chunk rows with the digest of the payload up to each of them; only the digest's state is carried from chunk to chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = hashlib.sha1()
        for batch in batches:
            out = []
            for number, chunk in zip(batch["chunk_no"], batch["chunk"], strict=True):
                if number == 0:
                    state = hashlib.sha1()
                state.update(chunk)
                out.append(state.hexdigest())
            yield batch.assign(running_sha1=out)

    return chunks.mapInPandas(run, CHUNKS)


def header(row) -> bytes:
    uri = "".join(c for c in (row.target_uri or "") if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <{row.record_id}>", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{row.payload_digest}", f"X-Payload-Length: {row.payload_bytes}"]
    if row.record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row.refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {row.payload_bytes if row.record_type == 'response' else 0}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass")


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Archives of the chunk rows in folder; returns the stored manifest (path, records, bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out = gz = None
        path, records, size, done = "", 0, 0, []
        state, wanted = hashlib.sha1(), None

        def end() -> None:
            if gz:
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                if wanted and state.hexdigest() != wanted:
                    raise ValueError(f"{path}: the chunks of a record do not have its digest")

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk_no == 0:
                    end()
                    gz = None
                    if out is not None and size >= ROLL:
                        out.close()
                        done.append((path, records, size))
                        out = None
                    if out is None:
                        path, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(path)
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(gz.compress(header(row)))
                    records += 1
                    state, wanted = hashlib.sha1(), row.payload_digest if row.record_type == "response" else None
                state.update(row.chunk)
                out.write(gz.compress(row.chunk))
                size += len(row.chunk)
        if out is not None:
            end()
            out.close()
            done.append((path, records, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return stored(chunks.mapInPandas(run, MANIFEST))


class Member:
    """The bytes of a gzip file of many members, decoded as they are asked for."""

    def __init__(self, raw):
        self.raw, self.z, self.held, self.rest = raw, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        """Decodes a little more; False at the end."""
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.z.unconsumed_tail or self.rest or self.raw.read(CHUNK)
            self.rest = b""
            if not data:
                return False
            got = self.z.decompress(data, CHUNK)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        if len(out) < n:
            raise ValueError("archive ends inside a record")
        del self.held[:n]
        return out


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The chunk table of the archives in a manifest. A payload that does not have the digest of its header raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = pyarrow.fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                with files.open_input_stream(path) as raw:
                    archive, rows, held = Member(raw), [], 0
                    while (head := archive.until(b"\r\n\r\n")) is not None:
                        field = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
                        digest, left, number = hashlib.sha1(), int(field["Content-Length"]), 0
                        refers = field["WARC-Refers-To"][len("<urn:page:") : -1] if "WARC-Refers-To" in field else None
                        wanted = field["WARC-Payload-Digest"].removeprefix("sha1:")
                        while True:
                            chunk = archive.take(min(left, CHUNK))
                            left -= len(chunk)
                            digest.update(chunk)
                            rows.append((field["WARC-Record-ID"][1:-1], number, chunk, digest.hexdigest(), field["WARC-Type"], refers, field["WARC-Target-URI"], int(field["X-Payload-Length"]), wanted))
                            held, number = held + len(chunk), number + 1
                            if held >= 4 << 20 or len(rows) >= 2000:
                                yield pd.DataFrame(rows, columns=names)
                                rows, held = [], 0
                            if not left:
                                break
                        if field["WARC-Type"] == "response" and digest.hexdigest() != wanted:
                            raise ValueError(f"{path}: {field['WARC-Record-ID']} has another digest")
                        archive.take(4)
                    yield pd.DataFrame(rows, columns=names)

    return manifest.repartition(max(1, manifest.count())).mapInPandas(run, CHUNKS)


def archived(pages: DataFrame) -> tuple[DataFrame, str]:
    """Writes the pages; the stored manifest and the folder."""
    folder = f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return write(chunk_rows(decided(pages)), folder), folder


def digest(pages: DataFrame) -> DataFrame:
    """Per record of the archives, read back: page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks.

    A revisit has its response's length and digest; its own payload is empty. A null html is an empty payload; repeated rows are records of their own; a null page_id stays
    null. An empty table gives no rows.
    """
    kind = dict(pages.dtypes)["page_id"]
    chunks = read(*archived(pages))
    number = lambda c: F.when(c != "null", c).cast(kind)
    last = (F.col("chunk_no") + 1) * CHUNK >= F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    ends = chunks.where(last)
    body = F.when(F.col("record_type") == "response", F.col("running_sha1")).otherwise(F.col("payload_digest"))
    return ends.select(number(F.substring("record_id", len("urn:page:") + 1, 40)).alias("page_id"), "payload_bytes", body.alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"), (F.col("chunk_no") + 1).cast("long").alias("n_chunks"))

"""Content-addressed WARC archive: payload bytes are stored once, record headers apart, and records are joins of both.

An archive is a folder with two Parquet tables:

``payloads``: ``sha256`` (the address), ``payload`` (its bytes, once), ``response_id`` (largest page id that has it).
``headers``: ``page_id``, ``header`` (the exact header block of the record, without the payload) and ``sha256``.

Addresses are verified twice: while writing, all pages that share a SHA-256 must share SHA-1 and length; while reading,
both digests are computed again from the stored bytes. A payload that fails stops the job.

Defined cases: a null or empty html is a payload of no bytes; a null url gives a record without target; line ends in a
url are written as ``%0D`` and ``%0A``; a null page id never is the largest, and where a payload has only such pages all
of them are responses; rows that repeat the largest page id of a payload are all responses (its bytes are stored once
all the same); an empty table gives an empty archive; columns but ``page_id``, ``url`` and ``html`` are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelineage.llm.common import stored

#: Every record is dated alike, so that archives of the same pages are the same.
DATE = "1970-01-01T00:00:00Z"
RECORD_ID = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest of 160 bits given in hex. ``conv`` writes 40 bits as 8 digits 0-9A-V, which are renamed."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _same(what: str) -> Column:
    """The one value of a column in a group; an error if it has several."""
    return F.when(F.min(what) == F.max(what), F.min(what)).otherwise(F.raise_error(F.lit(f"payloads of one SHA-256 differ in {what}")).cast("string"))


def _header(min_bytes: int) -> Column:
    """The header block of a record, up to and with its empty line."""
    revisit = (F.col("n_bytes") >= min_bytes) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("response_id"))) & F.col("response_id").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    named = lambda key: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), named("page_id")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), named("response_id"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("n_bytes")).cast("string")),
        F.lit("\r\n"),
    ]
    return F.concat_ws("\r\n", *lines)  # leaves out nulls


def _sources(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the archive of ``pages`` (``page_id``, ``url``, ``html``) to the folder ``path``, which must not exist.

    Of records with equal payloads of at least ``min_bytes``, that with the largest page id is the response and others
    revisit it; records with smaller payloads are all responses.

    Each payload crosses the network once at most: copies within a task are merged before the shuffle, so a payload of a
    third of all pages leaves each task as one row. Headers need only digests, which are kept aside on the first pass.
    """
    rows = _sources(pages)
    light = stored(rows.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")))
    rows.groupBy("sha256").agg(F.any_value("payload").alias("payload"), F.max("page_id").alias("response_id")).write.parquet(f"{path}/payloads")
    groups = light.groupBy("sha256").agg(F.max("page_id").alias("response_id"), _same("sha1").alias("sha1"), _same("n_bytes").cast("long").alias("n_bytes"))
    records = light.select("page_id", "url", "sha256").join(groups, "sha256")
    records.select("page_id", _header(min_bytes).alias("header"), "sha256").write.parquet(f"{path}/headers")


def _field(name: str, pattern: str) -> Column:
    """A field of ``header``; null where the record has none. Fields stand on lines of their own."""
    found = F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def payload_facts(spark: SparkSession, path: str) -> DataFrame:
    """``sha256``, ``payload_bytes``, ``sha1`` (base32) of each stored payload, computed from its bytes; fails where the address is wrong."""
    stored_ = spark.read.parquet(f"{path}/payloads")
    right = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.octet_length("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its address")).cast("int"))
    return stored_.select("sha256", right.cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("sha1"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``: a row per record, read from headers and payload bytes.

    Each payload is read and verified once, whatever number of records share it; only its facts are joined.
    """
    headers = spark.read.parquet(f"{path}/headers").select(
        "sha256", _field("WARC-Record-ID", f"<{RECORD_ID}(-?[0-9]*)>").cast("long").alias("page_id"), _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", f"<{RECORD_ID}(-?[0-9]*)>").cast("long").alias("refers_to"), _field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"),
    )
    both = headers.join(payload_facts(spark, path), "sha256", "left")
    same = F.when(F.col("sha1") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload is missing or differs from its header")).cast("string"))
    return both.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``header``, ``payload`` (whole, for revisits as well) and ``record`` (bytes as a WARC file has them).

    A payload goes to every record that shares it; Spark splits the records of a payload that has many.
    """
    both = spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads").select("sha256", "payload"), "sha256")
    block = F.when(_field("WARC-Type", "([a-z]+)") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.select("page_id", "header", "payload", F.concat(F.encode("header", "utf-8"), block).alias("record"))


def export(spark: SparkSession, path: str, out: str, records_per_file: int = 10_000) -> None:
    """Write the archive as WARC files to the folder ``out``. Two line ends follow each record, which is what ``lineSep`` adds."""
    lines = records(spark, path).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(out)


def _parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header block and content of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        length = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield head, data[end : end + length]
        at = end + length + 4


def load(spark: SparkSession, path: str) -> DataFrame:
    """``header`` and ``content`` of every record in the WARC files of a folder. A file is read whole by one task: export bounds files."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = list(_parse(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([h.decode() for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], ["header", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "header string, content binary")

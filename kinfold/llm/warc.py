"""A content-addressed WARC archive: payload bytes once by strong digest, exact record headers apart, records rebuilt by joins.

An archive is a folder with two Parquet tables. `headers` holds for each record its exact header block (WARC fields and HTTP head)
and the SHA-256 of its payload; `payloads` holds the bytes of each payload once. Of records with equal payloads the one with
the largest page_id is a response, the others are revisits that refer to it. A writer raises if two payloads of one SHA-256 differ
in SHA-1 or length. A reader joins the two tables, verifies both digests of every payload, its address and the one that
the header states, and gets the original WARC bytes back.

Digests and header blocks are made by column expressions; only parsing needs Python.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checkpoints as scratch

#: Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: Column, sha256: Column) -> Column:
    h = F.sha2(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit("/"), sha256).cast("binary"), 256)
    at = lambda a, n: F.substring(h, a + 1, n)
    return F.concat(F.lit("<urn:uuid:"), at(0, 8), F.lit("-"), at(8, 4), F.lit("-5"), at(13, 3), F.lit("-8"), at(17, 3), F.lit("-"), at(20, 12), F.lit(">"))


def base32(hex_digest: Column) -> Column:
    """The base32 of 40 hexadecimal digits: of every five, four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        bits = F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def escaped_url(url: Column) -> Column:
    """A line end inside a URL would end the field: line ends are written %0D and %0A, and a % before 0D, 0A or 25 as %25."""
    return F.replace(F.replace(F.regexp_replace(F.coalesce(url, F.lit("")), "%(?=0D|0A|25)", "%25"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def unescaped_url(url: str) -> str:
    return re.sub("%(0D|0A|25(?=0D|0A|25))", lambda m: {"0D": "\r", "0A": "\n", "25": "%"}[m[1]], url)


def header_block() -> Column:
    """A record's text before its payload (WARC fields, an empty line, and the HTTP head), from columns page_id, url, kind, holder, size,
    sha1 and sha256."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("kind") == "revisit"
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    fields = [
        ("WARC-Type", F.col("kind")),
        ("WARC-Record-ID", record_id(F.col("page_id"), F.col("sha256"))),
        ("WARC-Target-URI", escaped_url(F.col("url"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("holder"), F.col("sha256")))),
        ("WARC-Refers-To-Page", F.when(revisit, F.col("holder").cast("string"))),
        ("WARC-Page-ID", F.col("page_id").cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields]
    return F.concat(F.lit(VERSION.decode()), *lines, F.lit("\r\n"), http)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record's bytes; raises if the lengths don't hold."""
    head, _, block = record.partition(END)
    if not head.startswith(VERSION) or not record.endswith(END):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in head[len(VERSION) :].decode().split("\r\n"))
    block = block[: -len(END)]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("the block's length differs from Content-Length")
    http, _, payload = block.partition(END)
    fields["HTTP-Length"] = http.decode().rsplit("Content-Length: ", 1)[1]
    return fields, payload


def sha1_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record for every row of pages (page_id, url, html) to an archive at path, a folder that Spark can write.

    Payloads are the html in UTF-8 (null: empty). Payloads of fewer than `least` bytes are all responses; rows with a null
    page_id too. Repeated rows (equal page_id and html) are records of their own of the same type, and their payload is stored once.
    Other columns are ignored; of an empty table an empty archive is made. Payloads of any length are kept whole.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload)
    digests = (F.octet_length("payload").cast("long").alias("size"), base32(F.sha1("payload")).alias("sha1"), F.sha2("payload", 256).alias("sha256"))
    with scratch.scope():
        marks = scratch.materialize(own.select("page_id", "url", *digests), "digests")
        each = marks.groupBy("sha256").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("sha1", "size") for n, f in (("lo", F.min), ("hi", F.max))))
        differ = F.when((F.col("lo_sha1") != F.col("hi_sha1")) | (F.col("lo_size") != F.col("hi_size")), F.raise_error("two payloads have one SHA-256"))
        groups = scratch.materialize(each.select("sha256", F.coalesce(differ.cast("long"), "holder").alias("holder"), "n"), "groups")
        # only payloads of several records need to be looked up, and those that one of very many has can be split
        shared = scratch.materialize(groups.where("n > 1").select("sha256", F.col("holder").alias("top")), "shared")
        holder = F.coalesce("top", "page_id")
        alone = F.col("page_id").isNull() | holder.isNull() | (F.col("size") < least) | (F.col("page_id") == holder)
        typed = marks.join(scratch.broadcast_if_small(shared), "sha256", "left").withColumn("holder", holder).withColumn("kind", F.when(alone, "response").otherwise("revisit"))
        headers = typed.select("page_id", "sha256", "kind", F.encode(header_block(), "UTF-8").alias("header"))
        headers.write.option("compression", "zstd").parquet(f"{path}/headers")

        holders = scratch.materialize(groups.where("holder is not null").select(F.col("holder").alias("page_id"), "sha256"), "holders")
        held = own.where("page_id is not null").join(scratch.broadcast_if_small(scratch.materialize(holders.select("page_id").distinct(), "ids")), "page_id", "left_semi")
        stored = held.select("page_id", "payload", F.sha2("payload", 256).alias("sha256"))
        # a holder's page_id may have come with other html too; and only rows with equal page_id and html can be stored twice
        twice = marks.where("page_id is not null").groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1")
        if twice.limit(1).count():
            stored = stored.join(holders, ["page_id", "sha256"], "left_semi").dropDuplicates(["sha256"])
        stored = stored.select("sha256", "payload")
        if marks.where("page_id is null").limit(1).count():
            unheld = own.where("page_id is null").select(F.sha2("payload", 256).alias("sha256"), "payload")
            stored = stored.unionByName(unheld.join(groups.where("holder is null").select("sha256"), "sha256", "left_semi").dropDuplicates(["sha256"]))
        stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, kind and the exact WARC bytes of every record: header, payload (responses only) and the closing line ends.

    Raises where a payload's SHA-256 isn't its address, or a response's payload isn't there."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a payload differs from its address "), "sha256")).cast("binary"))
    payloads = payloads.select("sha256", verified.alias("payload"))
    there = F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload of "), "sha256")).cast("binary"))
    full = headers.where("kind = 'response'").join(payloads, "sha256", "left").select("page_id", "kind", F.concat("header", there, F.lit(END)).alias("record"))
    short = headers.where("kind = 'revisit'").select("page_id", "kind", F.concat("header", F.lit(END)).alias("record"))
    return full.unionByName(short)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, parsed from its rebuilt bytes.

    Every response's payload is hashed again and must have the digest and length that its header states; a revisit gets those of
    the payload that it refers to, and must state the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(0):
                fields, payload = parse_record(x.as_py())
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size, refers = int(fields["HTTP-Length"]), fields.get("WARC-Refers-To-Page")
                if fields["WARC-Type"] == "response" and (len(payload) != size or sha1_text(payload) != digest):
                    raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
                page = fields.get("WARC-Page-ID")
                out.append((page and int(page), size, digest, fields["WARC-Type"], refers and int(refers)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )

    parsed = records(spark, path).select("record").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
    parsed = scratch.materialize(parsed, "parsed")  # the result is read from this table
    held = parsed.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("held"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")
    ).distinct()
    revisits = parsed.where("record_type = 'revisit'")
    same = (F.col("refers_to") == F.col("held")) & (F.col("payload_bytes") == F.col("b")) & (F.col("payload_digest") == F.col("d"))
    resolved = revisits.join(held, same, "left")
    known = F.when(F.col("held").isNotNull(), F.col("b")).otherwise(F.raise_error("a revisit refers to no such response"))
    return parsed.where("record_type = 'response'").unionByName(
        resolved.select("page_id", known.alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    )

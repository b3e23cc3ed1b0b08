"""WARC archives: writing with payload dedup, and reading with a verified boundary chain.

Writing: a record for each page; of equal payloads the page with the smallest id is a
response, the others are revisits that refer to it.  Spark's text writer puts CRLF CRLF
after every record, so the part files are WARC files.

Reading: the files are split at the version line anywhere it occurs, also inside payloads.
Every piece is a candidate record whose header gives the offset of its successor.  A record
is real only if it lies on the chain of successors from the start of its file.  Inside a
split of a file each candidate is linked straight to where its chain leaves the split; over
these links pointers jump, doubling their reach each round, from the start of the file to
the split's entries; walking from the entries marks the real records.  Payloads that hold
version lines are put together again from their pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written
from .textbytes import bounded_batches

# Fixed values of the format.
VERSION = "WARC/1.1\r\n"
MARK = VERSION.encode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Up to so many pages with a decision other than response are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Parts in which revisits of one response meet it.
SALTS = 32
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of a binary column's SHA-1, from expressions: 20 bits (5 hex digits, 4 letters) at a time."""
    hexed = F.sha1(data)
    quads = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", *, least_bytes: int = 0, records_per_file: int = 100_000, date: str = DATE) -> None:
    """Writes a record for each row of pages into files under ``path``.

    A null payload is empty.  Payloads of fewer than ``least_bytes`` bytes are always responses.  A null id
    has no number in its record and is a response only if no equal payload has an id.  Rows that
    share an id are alike: all responses or all revisits.  White space in a URI is escaped.
    """
    rows = pages.select(pages[id_col].cast("long").alias("id"), F.coalesce(F.regexp_replace(pages[uri_col].cast("string"), r"[\x00-\x20\x7F]", "%20"), F.lit("")).alias("uri"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"))
    body = F.col("payload").cast("binary")
    light = rows.where(F.octet_length("payload") >= least_bytes).select("id", base32_sha1(body).alias("digest"))
    first = light.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    revisits = written(light.join(first, "digest").where("NOT (id <=> first)").select(F.struct("id", "digest").alias("key"), "first").distinct(), "revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    keyed = rows.withColumn("digest", base32_sha1(body)).withColumn("key", F.struct("id", "digest"))
    marked = keyed.join(revisits, keyed["key"].eqNullSafe(revisits["key"]), "left").drop("key")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.lit(VERSION), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)
    marked.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).mode("errorifexists").text(path)


def parse_record(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """(header fields, length of the header, declared length of the block) of what follows a version line."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or "warc-type" not in fields:
        return None
    return fields, end + 4, int(length)


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block, for HTTP messages without their header."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


_FIELDS = "record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string"


def _described(fields: dict[str, str], payload: bytes | None) -> tuple:
    known = (fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"))
    return (*known, None, None) if payload is None else (*known, len(payload), _digest(payload))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the split), value: the bytes between version lines, in order within a split."""
    bounded_batches(spark)
    return spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, block, offset, successor (null: no header), size, whole, and the fields of whole records: a row for each piece."""
    names = ["file", "block", "place", "size", "length", "whole", *(x.split()[0] for x in _FIELDS.split(", "))]
    schema = "file string, block long, place long, size long, length long, whole boolean, " + _FIELDS
    kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("whole", pa.bool_()), *((n, pa.string()) for n in names[6:10]), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = None, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != (file, block):
                    at, place = (file, block), 0
                parsed = parse_record(value) if block or place else None  # what stands before the first version line is no record
                row = (None, False, *[None] * 6)
                if parsed:
                    fields, head, length = parsed
                    whole = len(value) >= head + length
                    row = (head + length, whole, *_described(fields, payload_of(fields, value[head : head + length]) if whole else None))
                rows.append((file, block, place, len(value), *row))
                place += len(value) + len(MARK)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    found = written(_pieces(spark, path).mapInArrow(scan, schema), "pieces")
    splits = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MARK)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    offset = F.col("base") + F.col("place") - len(MARK)
    successor = offset + len(MARK) + F.col("length") + 4
    return found.join(base, ["file", "block"]).withColumns({"offset": offset, "successor": successor}).drop("base", "length")


def real_offsets(pieces: DataFrame) -> DataFrame:
    """file, offset of the records on the chain from the start of each file."""
    nodes = written(pieces.where("successor IS NOT NULL").select("file", "block", "offset", "successor"), "nodes")

    def leave(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Where each candidate's chain leaves the split; rows of a split are bounded by its size."""
        rows = rows.sort_values("offset", ascending=False)
        ends: dict[int, int] = {}
        for offset, successor in zip(rows["offset"].tolist(), rows["successor"].tolist(), strict=True):
            ends[offset] = ends.get(successor, successor)
        return pd.DataFrame({"file": rows["file"], "offset": rows["offset"], "jump": [ends[x] for x in rows["offset"].tolist()]})

    jumps = written(nodes.groupBy("file", "block").applyInPandas(leave, "file string, offset long, jump long"), "jumps")
    splits = nodes.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    met = nodes.where("offset = 0").select("file", "offset")
    reach = 1
    while reach < splits:  # every round, pointers reach twice as far
        met = written(met.union(met.join(jumps, ["file", "offset"]).select("file", F.col("jump").alias("offset"))).distinct(), "met")
        reach *= 2
        if reach < splits:
            further = jumps.select("file", F.col("offset").alias("jump"), F.col("jump").alias("next"))
            jumps = written(jumps.join(further, ["file", "jump"], "left").select("file", "offset", F.coalesce("next", "jump").alias("jump")), "jumps")
    entries = nodes.join(met, ["file", "offset"]).groupBy("file", "block").agg(F.min("offset").alias("entry"))

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(rows["offset"].tolist(), rows["successor"].tolist(), strict=True))
        at, real = int(rows["entry"].iloc[0]), []
        while at in after:
            real.append(at)
            at = after[at]
        return pd.DataFrame({"file": key[0], "offset": real})

    return nodes.join(entries, ["file", "block"]).groupBy("file", "block").applyInPandas(walk, "file string, offset long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, record_type, record_id, refers_to, uri, payload_bytes, payload_digest of every real record under path.

    Bytes before a file's first version line, and whatever is not reached from its start, give no record.
    """
    pieces = written(candidates(spark, path), "candidates")
    real = written(real_offsets(pieces), "real")
    marked = pieces.join(real.withColumn("real", F.lit(True)), ["file", "offset"], "left")
    keep = ["file", "offset", *(x.split()[0] for x in _FIELDS.split(", "))]
    whole = marked.where("real AND whole").select(keep)
    # pieces of records whose payload holds version lines: each belongs to the last real record before it, in its split or an earlier one
    own = F.when(F.col("real"), F.struct("offset", "whole"))
    last = marked.groupBy("file", "block").agg(F.max(own).alias("last"))
    splits = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "block", F.last("last", ignorenulls=True).over(splits).alias("carried"))
    running = Window.partitionBy("file", "block").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.select("file", "block", "place", "offset", F.last(own, ignorenulls=True).over(running).alias("own")).join(carried, ["file", "block"]).withColumn("own", F.coalesce("own", "carried"))
    cut = written(owned.where("NOT own.whole").select("file", "block", "place", "offset", F.col("own.offset").alias("owner")), "cut")
    if cut.isEmpty():
        return whole

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, where = None, 0
        for batch in batches:
            places = []
            for file, block, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != (file, block):
                    at, where = (file, block), 0
                places.append(where)
                where += len(size) + len(MARK)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["file", "block", "value", "place"])

    parts = _pieces(spark, path).mapInArrow(place, "file string, block long, value binary, place long").join(cut, ["file", "block", "place"])
    gathered = parts.groupBy("file", F.col("owner").alias("offset")).agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("at"), "value"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, offset, values in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = MARK.join(values)
                fields, head, length = parse_record(data)
                if len(data) >= head + length:  # else the file is cut short
                    rows.append((file, offset, *_described(fields, payload_of(fields, data[head : head + length]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (1, 6) else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names=keep)

    whole_again = gathered.select("file", "offset", F.transform("parts", lambda x: x["value"]).alias("values")).mapInArrow(join, "file string, offset long, " + _FIELDS)
    return whole.union(whole_again)


def page_records(records: DataFrame, prefix: str = "<urn:page:") -> DataFrame:
    """page_id, payload_bytes, payload_digest (both of the full payload), record_type, refers_to, uri, file, offset.

    A revisit has the payload of the response it refers to; null if that is missing.
    """
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{prefix}([0-9-]+)>', 1) AS BIGINT)")
    rows = records.withColumns({"page_id": number("record_id"), "first": number("refers_to")})
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    responses = rows.where(~revisit).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first").alias("refers_to"), "uri", "file", "offset")
    # a response that many revisits refer to meets them in SALTS parts
    revisits = rows.where(revisit).drop("refers_to", "payload_bytes", "payload_digest").withColumn("salt", F.pmod(F.xxhash64("file", "offset"), F.lit(SALTS)).cast("int"))
    wanted = revisits.select("first").distinct()
    own = rows.where("record_type = 'response'").select(F.col("page_id").alias("first"), "payload_digest", "payload_bytes").join(wanted, "first", "left_semi")
    own = own.groupBy("first").agg(F.min(F.struct("payload_digest", "payload_bytes")).alias("own")).select("first", "own.*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    referred = revisits.join(own, ["first", "salt"], "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first").alias("refers_to"), "uri", "file", "offset")
    return responses.union(referred)

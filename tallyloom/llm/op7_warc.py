"""Content-addressed WARC archive.

An archive is two tables in the shared storage. `payloads` keeps each distinct payload once under its SHA-256. `records`
keeps each record's exact header blocks (WARC and HTTP) and the digest of its payload. Joining them on the digest
reconstructs every record, byte for byte: WARC header, HTTP header, payload (in a response), two line ends. A revisit
has the identical-payload-digest profile and no payload of its own; its payload comes through the same join.

Writing checks that rows of one SHA-256 agree in SHA-1 and length. Payloads are shuffled once, by keys that no two rows but equal
ones share. Reading recomputes the digest of every stored payload; parsing takes the reconstructed bytes apart again, and
both fail on a mismatch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, scratch_path, table

LINE = "\r\n"
DATE = "1970-01-01T00:00:00Z"  # where the pages have no time of capture
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * g, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*groups), _BASE32_HEX, _BASE32)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))


def _http_header() -> Column:
    """The header of an HTTP response with a payload of payload_bytes bytes, up to its empty line."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}"), _field("Content-Type", F.lit("text/html; charset=utf-8")), _field("Content-Length", F.col("payload_bytes").cast("string")), F.lit(LINE))


def _urn(page: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))


def _header(kind: Column, date: str) -> Column:
    """The WARC header of a record up to its empty line, from columns id, row, url, payload_digest, payload_bytes, http, first_id, first_row."""
    revisit = kind == "revisit"
    block = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", _urn(F.col("id"), F.col("row"))),
        _field("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), _field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A"))).otherwise(""),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_field("WARC-Refers-To", _urn(F.col("first_id"), F.col("first_row"))), _field("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block.cast("string")),
        F.lit(LINE),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, date: str = DATE) -> None:
    """Write the two tables of an archive under `path`.

    Of rows with equal payloads of at least `min_revisit_bytes` bytes, that with the smallest id (nulls last, then by
    url) becomes a response, the others revisits of it; smaller payloads are all responses. A null payload is empty; a
    null id is written as "none"; record ids are made unique by a row number; of fully equal rows one, any, is the response. An
    empty table gives an empty archive. Other columns aren't read; pages must give the same rows whenever they are read.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    key = [F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("digest")]
    rows = pages.select(*key, base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "warc-rows")  # fixes the row numbers
    check = F.struct("payload_digest", "payload_bytes")
    firsts = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "url", "row")).alias("f"), F.min(check).alias("least"), F.max(check).alias("most"))
    same = F.when(F.col("least") == F.col("most"), F.col("digest")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256")))
    firsts = materialise(firsts.select(same.alias("digest"), F.col("f.id").alias("first_id"), F.col("f.url").alias("first_url"), F.col("f.row").alias("first_row")), "warc-firsts")
    kind = F.when((F.col("row") == F.col("first_row")) | (F.col("payload_bytes") < min_revisit_bytes), "response").otherwise("revisit")
    records = rows.join(firsts, "digest").withColumn("http", _http_header()).withColumn("header", _header(kind, date))
    records.select("id", "digest", kind.alias("kind"), "header", "http").write.parquet(f"{path}/records")
    # the join's keys are the aggregation's, so payloads are dealt out once; rows that agree in id and url as well are equal
    who = lambda a, b: F.to_json(F.struct(F.col(a).alias("id"), F.col(b).alias("url"))).alias("who")
    stored = pages.select(*key, payload.alias("payload")).select("digest", who("id", "url"), "payload")
    wanted = firsts.select("digest", who("first_id", "first_url"))
    stored.join(wanted, ["digest", "who"], "left_semi").groupBy("digest", "who").agg(F.first("payload").alias("payload")).select("digest", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The reconstructed records of an archive: id, payload, record (all its bytes).

    Raises where a stored payload no longer has its digest, and where a record's payload is missing.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    verified = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest"))).alias("payload"))
    joined = spark.read.parquet(f"{path}/records").join(verified, "digest", "left")
    found = F.coalesce("payload", F.raise_error(F.concat(F.lit("missing payload "), "digest")).cast("binary"))
    block = F.when(F.col("kind") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("payload", found).select("id", "payload", F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), block, F.lit((LINE * 2).encode())).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """What the records' bytes say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The bytes are taken apart by the lengths and empty lines that they state themselves. A response's payload is what its
    HTTP message holds, a revisit's the stored one; its digest must be the header's. Raises on any disagreement.
    """
    # one character for each byte
    text = records.select(F.decode("record", "ISO-8859-1").alias("t"), "payload").withColumn("header", F.substring_index("t", LINE * 2, 1))
    value = lambda name, pattern: F.regexp_extract(F.concat("header", F.lit(LINE)), rf"\r\n{name}: {pattern}\r\n", 1)
    text = text.select("payload", "header", F.substring(F.col("t"), F.length("header") + 5, F.length("t")).alias("rest"), value("Content-Length", "([0-9]+)").try_cast("int").alias("n"), value("WARC-Type", "([a-z]+)").alias("kind"))
    text = text.withColumn("block", F.substring(F.col("rest"), F.lit(1), F.col("n"))).withColumn("http", F.substring_index("block", LINE * 2, 1))
    own = F.encode(F.substring(F.col("block"), F.length("http") + 5, F.length("block")), "ISO-8859-1")
    revisit = F.col("kind") == "revisit"
    text = text.withColumn("body", F.when(revisit, F.col("payload")).otherwise(own)).withColumn("digest", base32_sha1(F.col("body")))
    sound = (
        F.col("header").startswith("WARC/1.1") & (F.length("rest") == F.col("n") + 4) & F.col("rest").endswith(LINE * 2) & F.col("http").startswith("HTTP/1.1 ")
        & F.col("kind").isin("response", "revisit") & (~revisit | (F.octet_length(own) == 0)) & (value("WARC-Date", "([0-9T:Z-]+)") != "")
        & (value("WARC-Payload-Digest", "sha1:([A-Z2-7]+)") == F.col("digest")) & (F.regexp_extract("http", r"\r\nContent-Length: ([0-9]+)", 1) == F.octet_length("body").cast("string"))
    )
    page = lambda name: F.regexp_extract(F.concat("header", F.lit(LINE)), rf"\r\n{name}: <urn:x-page:(-?[0-9]+):[0-9]+>\r\n", 1).try_cast("long")
    return text.select(
        page("WARC-Record-ID").alias("page_id"),
        F.when(F.coalesce(sound, F.lit(False)), F.octet_length("body").cast("long")).otherwise(F.raise_error(F.lit("a record's bytes disagree with themselves or with its payload")).cast("long")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
    )


def op7_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written to a content-addressed archive and read back from it."""
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return parse_records(read_archive(spark, path))


OP7_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) payload_bytes, sha1(coalesce(html, '')) h FROM pages),
d AS (SELECT page_id, payload_bytes, translate({" || ".join(f"to_base(CAST('0x' || substr(h, {1 + 10 * g}, 10) AS BIGINT), 32, 8)" for g in range(4))}, '{_BASE32_HEX}', '{_BASE32}') payload_digest, h FROM p),
f AS (SELECT h, min(page_id) first_id FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END refers_to FROM d JOIN f USING (h)"""

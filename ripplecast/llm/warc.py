"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart.

An archive is a folder in the shared storage with two tables:

``payloads``  a row per distinct payload: SHA-256, length, bytes
``headers``   a row per record: its id, the exact bytes of its WARC header block and of its HTTP
              header, and the SHA-256 of its payload

Reading joins them: the bytes of a record are the header block, the HTTP header, the payload
(of a response; a revisit holds none) and two line ends. Payloads are checked against their
digest when they are stored and again when they are read.

Edge cases: a null page is an empty payload, and empty payloads are equal like others; of records
that repeat a page id and a payload, all with the smallest id are responses and share the payload;
a null id is larger than any other, so its records refer to a known page where there is one; a
null address leaves the header line out; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.llm.common import stored
from ripplecast.session import scratch_path

_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: RFC 4648
_END = "\r\n"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: 32 digits for 160 bits, 8 for every 40 bits."""
    code = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(code, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _urn(page: Column) -> Column:
    """A record id that follows from the page id."""
    code = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("none"))))
    parts = [F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field that is null is left out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value, F.lit(_END)) for name, value in fields])


def write_archive(
    pages: DataFrame,
    path: str | None = None,
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> str:
    """Write a record per page and return the archive's path, by default one in the shared folder.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id
    is a response and the others revisit it; all smaller ones are responses. Payloads are reduced
    to one per digest before and after their shuffle; the digests alone decide the record types.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archive")
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    records = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        body.alias("payload"),
    ).withColumns({"sha256": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})

    store = records.select("sha256", "n", "payload").dropDuplicates(["sha256"])
    sound = F.sha2("payload", 256) == F.col("sha256")
    store.select(
        "sha256", "n", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("payload changed"))).alias("payload")
    ).write.option("compression", "zstd").parquet(f"{path}/payloads")

    narrow = stored(
        records.select("page_id", "url", "sha256", "n", sha1_base32(F.col("payload")).alias("sha1")),
        "records",
    )
    firsts = narrow.groupBy("sha256").agg(F.min("page_id").alias("first_id"))
    typed = narrow.join(firsts, "sha256").withColumn(
        "revisit",
        (F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")),
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("n").cast("string"),
        F.lit(_END + _END),
    )
    block = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("n"))
    sha1 = F.concat(F.lit("sha1:"), F.col("sha1"))
    only_revisit = lambda value: F.when(F.col("revisit"), value)
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _lines(
            ("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", _urn(F.col("page_id"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "%0A")),
            ("WARC-Payload-Digest", sha1),
            ("WARC-Profile", only_revisit(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", only_revisit(_urn(F.col("first_id")))),
            ("X-Refers-To-Page", only_revisit(F.col("first_id").cast("string"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", block.cast("string")),
        ),
        F.lit(_END),
    )
    typed.select(
        "page_id", header.cast("binary").alias("header"), http.cast("binary").alias("http"), "sha256"
    ).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, http, payload, record): every record put together from both tables.

    A missing payload or one that does not match its digest is an error. A payload that very many
    records share is a skewed join key, which AQE splits on the records' side.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    joined = headers.join(payloads, "sha256", "left")
    sound = F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False))
    payload = F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload lost or changed: "), F.col("sha256")))
    )
    revisit = F.col("header").cast("string").contains(f"{_END}WARC-Type: revisit{_END}")
    held = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.select("page_id", "header", "http", payload.alias("payload")).select(
        "*", F.concat("header", "http", held, F.lit(_END + _END).cast("binary")).alias("record")
    )


def parsed(records: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from records read back.

    Types, digests and references come from the record's own header lines; the payload must have
    the digest that its header states.
    """
    head = F.substring_index(F.col("record").cast("string"), _END + _END, 1)

    def field(name: str) -> Column:
        found = F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)", 1)
        return F.when(found != "", found)

    stated, actual = field("WARC-Payload-Digest"), sha1_base32(F.col("payload"))
    digest = F.when(stated == F.concat(F.lit("sha1:"), actual), actual).otherwise(
        F.raise_error(F.lit("payload does not match its header"))
    )
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page").cast(id_type).alias("refers_to"),
    )

"""All pages written to seekable WARC bundles and read back."""

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm.warc import archive_pages
from quotemill.session import load

NAME = "op3_warc_bundles"
ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     k AS (SELECT b, max(page_id) AS keeper FROM p WHERE octet_length(b) >= 1000 GROUP BY b)
SELECT p.page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, sha1(p.b) AS payload_digest,
       CASE WHEN p.page_id < k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < k.keeper THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.b = k.b
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _, _ = archive_pages(load(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Merkle manifest of all documents, a tree per source; of a fifth, an altered text is presented for verification."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.merkle import leaf_digest, merkle_manifest
from quotemill.session import load

NAME = "op13_merkle_manifest"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _levels(name: str, first: str, depth: int) -> str:
    """CTEs of the levels of trees over ``first`` (g, idx, n, h): siblings before and after each node, and its parent."""
    parts = [f"{name}0 AS ({first})"]
    for k in range(depth):
        w = "PARTITION BY g, idx // 16 ORDER BY idx"
        parts.append(f"""{name}{k}s AS (SELECT *, n > 1 AS inner_node,
            coalesce(string_agg(h, '') OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
            coalesce(string_agg(h, '') OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {name}{k})""")
        parts.append(f"""{name}{k + 1} AS (SELECT g, idx // 16 AS idx, (min(n) + 15) // 16 AS n,
            CASE WHEN min(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{k} GROUP BY g, idx // 16)""")
    return ",\n".join(parts)


def _field(x: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]),
    lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"""
_D, _T = 6, 4
_STEPS = [("s", k) for k in range(_D)] + [("t", k) for k in range(_T)]


def _folded() -> str:
    """CTEs that fold what is presented, level by level."""
    parts = [f"f0 AS (SELECT l.*, t.idx AS top_idx, CASE WHEN {_CRC} % 5 = 0 THEN altered ELSE leaf END AS x, '' AS proof FROM leaves l JOIN t0 t ON t.src IS NOT DISTINCT FROM l.source)"]
    for i, (name, k) in enumerate(_STEPS):
        place, same = ("f.idx", "s.g IS NOT DISTINCT FROM f.source") if name == "s" else ("f.top_idx", "true")
        parts.append(f"""f{i + 1} AS (SELECT f.* EXCLUDE (x, proof), CASE WHEN s.inner_node THEN sha256(s.pre || f.x || s.post) ELSE f.x END AS x,
            CASE WHEN s.inner_node THEN f.proof || s.pre || s.post ELSE f.proof END AS proof FROM f{i} f JOIN {name}{k}s s ON {same} AND s.idx = {place} // {16**k})""")
    return ",\n".join(parts)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS altered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
{_levels("s", "SELECT source AS g, idx, count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM leaves", _D)},
{_levels("t", f"SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, h, g AS src FROM s{_D}", _T)},
{_folded()}
SELECT f.doc_id, f.leaf, sub.h AS subroot, root.h AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = root.h AS verified
FROM f{len(_STEPS)} f JOIN s{_D} sub ON sub.g IS NOT DISTINCT FROM f.source CROSS JOIN t{_T} root
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(*fields, F.translate("text", UPPER, LOWER)))
    leaves = docs.select("doc_id", "source", leaf_digest(*fields, F.col("text")).alias("leaf"), altered.alias("shown"))
    proofs = merkle_manifest(leaves, group="source", order="doc_id", digest="leaf", shown="shown")
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

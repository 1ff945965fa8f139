"""Merkle manifest of a grouped dataset: a tree per group, a tree over the groups' roots, a proof per row.

Rows are range-sorted by group and order, so a partition holds consecutive leaves of
each of its groups. Counts per (partition, group), summed in partition order, say
which place in its group a partition's first leaf has. From there a partition builds
all subtrees that lie wholly inside it, aligned to the arity; the few nodes at its
ragged edges are shuffled by coordinate (group, level, place) and the upper levels
finished from them. A proof needs a partition's own subtrees and, per level, the two
groups of siblings at its edges, which are looked up by coordinate.

A partition holds ``PARTITION_ROWS`` leaves or so, whatever the groups' sizes: rows of
one group, or with one order key, are spread over partitions.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm import rowids
from quotemill.llm.scratch import materialize

ARITY = 16
PARTITION_ROWS = 50_000


def digest_of(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the values, each as its number of UTF-8 bytes, a colon and itself; null: a dash."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def local_levels(leaves: list[str], first: int, total: int, arity: int = ARITY) -> list[tuple[int, list[str], int, int, int]]:
    """What consecutive leaves, the ``first``-th of ``total`` on, make without others.

    Per level: place of the first node, nodes, number of the level's nodes in all, and
    the range [a, b) of groups whose nodes are all here. The last level has no group.
    """
    out = []
    nodes, at, n = leaves, first, total
    while True:
        end = at + len(nodes)
        a = -(-at // arity)
        b = max(a, -(-end // arity) if end == n else end // arity) if n > 1 else a
        out.append((at, nodes, n, a, b))
        if a >= b:
            return out
        nodes = [digest_of(*nodes[arity * k - at : arity * (k + 1) - at]) for k in range(a, b)]
        at, n = a, -(-n // arity)


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a digest leads to; ``path``: its place among siblings and their digests (its own place left out), from below."""
    for at, others in path:
        digest = digest_of(*others[:at], digest, *others[at:])
    return digest


def _forest(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Trees over ``leaves`` (g, o, digest and others): placed leaves, segments, groups of siblings at edges, roots."""
    count = leaves.count()
    order = ["g", "o", "digest", "tie"]
    parts = max(4, -(-count // PARTITION_ROWS))
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    placed = materialize(ranged.withColumn("pid", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "merkle-leaves")
    counts = placed.groupBy("pid", "g").agg(F.count("*").alias("n"), F.min("nth").alias("nth0"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("g"))
    segments = materialize(counts.select("pid", "g", "n", before.cast("long").alias("first"), total.cast("long").alias("total")), "merkle-segments")

    def edges(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values("nth", kind="stable")
        by_group = dict(iter(rows.groupby("g", sort=False)["digest"]))
        for g, first, n_all in zip(own["g"], own["first"], own["total"]):
            for level, (at, nodes, n, a, b) in enumerate(local_levels(by_group[g].tolist(), int(first), int(n_all), arity)):
                inside = range(arity * a, arity * b) if a < b else range(0)
                out += [(g, level, at + k, n, d) for k, d in enumerate(nodes) if at + k not in inside]
        return pd.DataFrame(out, columns=["g", "level", "place", "n", "digest"])

    schema = "g string, level int, place long, n long, digest string"
    ragged = materialize(placed.select("pid", "g", "nth", "digest").groupBy("pid").cogroup(segments.groupBy("pid")).applyInPandas(edges, schema), "merkle-edges")
    most = segments.agg(F.max("total")).first()[0] or 0
    none = ragged.where("false")
    groups, built, level = none.select("g", "level", F.col("place").alias("k"), F.array("digest").alias("digests")), none, 0
    while most > 1:
        nodes = ragged.where(F.col("level") == level).unionByName(built).where("n > 1")
        joined = nodes.groupBy("g", F.floor(F.col("place") / arity).cast("long").alias("k")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("all"))
        known = materialize(joined.select("g", F.lit(level).alias("level"), "k", "n", F.col("all.digest").alias("digests")), "merkle-level")
        groups = groups.unionByName(known.drop("n"))
        above = F.ceil(F.col("n") / arity).cast("long")
        built = known.select("g", F.lit(level + 1).alias("level"), F.col("k").alias("place"), above.alias("n"), F.sha2(F.array_join("digests", ""), 256).alias("digest"))
        finished = built.where("n = 1") if level == 0 else finished.unionByName(built.where("n = 1"))
        most, level = -(-most // arity), level + 1
    roots = ragged.where("n = 1").select("g", "digest")
    if level:
        roots = roots.unionAll(finished.select("g", "digest"))
    return placed, segments, groups, roots


_PATH = "array<struct<at:int,others:array<string>>>"


def _proven(placed: DataFrame, segments: DataFrame, groups: DataFrame, above: DataFrame | None, arity: int, columns: list[str], result: str, emit) -> DataFrame:
    """``emit(row columns, paths)`` per group of leaves: every leaf's path through its tree and on through ``above`` (g, path)."""
    bits = arity.bit_length() - 1
    levels = F.sequence(F.lit(0), F.lit(62 // bits))
    at_edges = segments.select("pid", "g", "first", "n", "total", F.explode(levels).alias("level")).where(f"shiftright(total - 1, level * {bits}) > 0")
    ends = F.expr(f"array_distinct(array(shiftright(first, (level + 1) * {bits}), shiftright(first + n - 1, (level + 1) * {bits})))")
    wanted = at_edges.select("pid", "g", "level", F.explode(ends).alias("k")).join(groups, ["g", "level", "k"])
    per_segment = wanted.groupBy("pid", "g").agg(F.collect_list(F.struct("level", "k", "digests")).alias("known"))
    info = segments.join(per_segment, ["pid", "g"], "left")
    if above is not None:
        info = info.join(above, "g")
    info = materialize(info, "merkle-known")
    further = above is not None

    def prove(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth", kind="stable")
        by_group = dict(iter(rows.groupby("g", sort=False)))
        done = []
        for s in own.itertuples(index=False):
            leaves = by_group[s.g]
            siblings: dict[tuple[int, int], list[str]] = {}
            for level, (at, nodes, _, a, b) in enumerate(local_levels(leaves["digest"].tolist(), int(s.first), int(s.total), arity)):
                siblings |= {(level, k): nodes[arity * k - at : arity * (k + 1) - at] for k in range(a, b)}
            siblings |= {(x["level"], x["k"]): list(x["digests"]) for x in (s.known if s.known is not None else ())}
            depth, n = 0, int(s.total)
            while n > 1:
                depth, n = depth + 1, -(-n // arity)
            rest = [(int(x["at"]), list(x["others"])) for x in s.path] if further else []
            upper: dict[int, list[tuple[int, list[str]]]] = {}

            def path(place: int, level: int) -> list[tuple[int, list[str]]]:
                if level == depth:
                    return rest
                k, at = divmod(place, arity)
                if level and (found := upper.get((level, place))):
                    return found
                others = siblings[level, k]
                found = [(at, others[:at] + others[at + 1 :]), *path(k, level + 1)]
                if level:
                    upper[level, place] = found
                return found

            done.append(emit(leaves, [path(p, 0) for p in range(int(s.first), int(s.first) + len(leaves))]))
        return pd.concat(done, ignore_index=True)

    return placed.select("pid", "g", "nth", "digest", *columns).groupBy("pid").cogroup(info.groupBy("pid")).applyInPandas(prove, result)


def merkle_manifest(rows: DataFrame, *, group: str, order: str, digest: str, shown: str, arity: int = ARITY, paths: bool = False) -> DataFrame:
    """A proof per row: (``order``, ``group``, leaf, subroot, root, proof_sha256, folded_root, verified), with ``paths`` also its path.

    ``digest`` is a row's leaf; ``shown`` the digest presented for it when it is
    verified (null: the leaf). Leaves of a group ascend by ``order`` (whole numbers,
    null first), then by digest; groups by name (UTF-8 bytewise, null first). While a
    level has several nodes, every ``arity`` of them (a power of two; the last run may
    be shorter) become the SHA-256 of their joined digests. proof_sha256 is that of all
    siblings from the leaf to the root, left to right, level by level; folded_root is
    what ``shown`` leads to with them. The path is an array of (place, siblings).
    Repeated rows are leaves of their own. An empty table gives an empty result.
    """
    if arity < 2 or arity & (arity - 1):
        raise ValueError("the arity must be a power of two")
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first, others by their bytes
    leaves = rows.select(key.alias("g"), F.col(order).cast("long").alias("o"), F.col(digest).alias("digest"), F.col(shown).alias("shown"))
    placed, segments, groups, subroots = _forest(leaves, arity)
    subroots = materialize(subroots, "merkle-subroots")
    tops = _forest(subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), "digest"), arity)

    def top(leaves: pd.DataFrame, found: list) -> pd.DataFrame:
        listed = [[{"at": at, "others": others} for at, others in path] for path in found]
        roots = [fold(d, path) for d, path in zip(leaves["digest"], found)]
        return pd.DataFrame({"g": leaves["o"].tolist(), "path": listed, "subroot": leaves["digest"].tolist(), "root": roots})

    above = materialize(_proven(*tops[:3], None, arity, ["o"], f"g string, path {_PATH}, subroot string, root string", top), "merkle-top")

    def digests(leaves: pd.DataFrame, found: list) -> pd.DataFrame:
        joined: dict[int, str] = {}
        proofs, folded = [], []
        for leaf, other, path in zip(leaves["digest"], leaves["shown"], found):
            tail = path[1:]
            text = joined.get(id(tail[0][1])) if tail else ""
            if text is None:
                text = joined[id(tail[0][1])] = "".join(d for _, others in tail for d in others)
            proofs.append(digest_of(*(path[0][1] if path else ()), text))
            folded.append(fold(other or leaf, path))
        out = {"g": leaves["g"].tolist(), "o": leaves["o"].tolist(), "no_id": leaves["no_id"].tolist(), "leaf": leaves["digest"].tolist(), "proof_sha256": proofs, "folded_root": folded}
        if paths:
            out["path"] = [[{"at": at, "others": others} for at, others in path] for path in found]
        return pd.DataFrame(out)

    result = "g string, o long, no_id boolean, leaf string, proof_sha256 string, folded_root string" + (f", path {_PATH}" if paths else "")
    marked = placed.select("pid", "g", "nth", "digest", "shown", *rowids.apart("o"))
    found = _proven(marked, segments, groups, above.select("g", "path"), arity, ["shown", "o", "no_id"], result, digests)
    named = found.join(above.select("g", "subroot", "root"), "g")
    return named.select(
        rowids.together("o").alias(order), F.when(F.col("g") != "0", F.substring("g", 2, 2**31 - 1)).alias(group), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if paths else []),
    )

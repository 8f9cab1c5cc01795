"""A Merkle manifest of a dataset: leaves, roots of sources, a root of all, and a proof for every row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palindra.llm.common import cut, n_partitions, read

#: Nodes under one parent, and levels that a superblock collapses: at most FANOUT ** LEVELS nodes meet in a group.
FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values one after another: ``-`` for null, else UTF-8 bytes, ``:``, value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values)]
    return F.sha2(F.concat(*parts), 256)


def parent(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes: of their hex texts one after another."""
    return sha256(b"".join(digests).hex().encode()).digest()


def fold(digest: bytes, proof: bytes, index: int, total: int, fanout: int = FANOUT) -> bytes:
    """The root above node ``index`` of ``total`` that ``digest`` and the siblings in ``proof`` give."""
    at = 0
    while total > 1:
        place, size = index % fanout, min(fanout, total - index // fanout * fanout)
        run = [proof[at + 32 * k : at + 32 * k + 32] for k in range(size - 1)]
        at += 32 * (size - 1)
        digest = parent([*run[:place], digest, *run[place:]])
        index, total = index // fanout, -(-total // fanout)
    return digest


def _collapse(fanout: int, levels: int):
    """The nodes of one superblock, in order: their siblings within it, and its root."""
    span = fanout**levels

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("index", kind="stable")
        n, total = len(nodes), int(nodes["total"].iloc[0])
        row, proofs = [bytes(d) for d in nodes["digest"]], [[] for _ in range(n)]
        for level in range(levels):
            if total <= 1:
                break
            width = fanout**level
            for k in range(n):
                own = k // width
                first = own // fanout * fanout
                proofs[k] += row[first:own] + row[own + 1 : first + fanout]
            row = [parent(row[s : s + fanout]) for s in range(0, len(row), fanout)]
            total = -(-total // fanout)
        out = nodes[["group", "index"]].copy()
        out["bucket"], out["proof"], out["root"] = nodes["index"] // span, [b"".join(p) for p in proofs], [row[0]] * n
        return out

    return run


def superblocks(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(group, index, proof, root) of (group, index, total, digest): every node's siblings up to its group's root.

    Indices of a group are 0 .. total - 1. Buckets of ``fanout`` ** ``levels`` nodes collapse by
    ``levels`` each; their roots are the nodes of the next round, until no group has more than one. Then
    proofs are joined downwards, each bucket's lower ones with the one upper of its root.
    """
    span = fanout**levels
    top = nodes.agg(F.max("total")).first()[0] or 0
    rounds = []
    while True:
        dealt = nodes.groupBy("group", F.floor(F.col("index") / span).alias("bucket"))
        done = cut(dealt.applyInPandas(_collapse(fanout, levels), "group long, index long, bucket long, proof binary, root binary"))
        rounds.append(done)
        if top <= span:
            break
        roots = done.where(F.col("index") == F.col("bucket") * span).select("group", F.col("bucket").alias("index"), F.col("root").alias("digest"))
        totals = nodes.where("index = 0").select("group", F.ceil(F.col("total") / span).cast("long").alias("total"))
        nodes, top = roots.join(totals, "group"), -(-top // span)
    out = rounds[-1].select("group", "index", "proof", "root")
    for lower in reversed(rounds[:-1]):
        upper = out.select("group", F.col("index").alias("bucket"), F.col("proof").alias("above"), F.col("root"))
        out = lower.drop("root").join(upper, ["group", "bucket"]).select("group", "index", F.concat("proof", "above").alias("proof"), "root")
    return out


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``group_no`` (of groups in order), ``groups``, ``index`` in the group and ``total`` of it.

    ``group`` is a string without null. Rows are range-partitioned by group and order, so a large group
    lies in many partitions; a task numbers the rows of its own, and the offsets come from the counts of
    (partition, group), of which a partition has one for each group that begins in it and one more.
    """
    spark = rows.sparkSession
    keys = [group, *order, "_row"]
    ordered = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n_partitions(spark), *keys).sortWithinPartitions(*keys).drop("_row")
    ordered = ordered.withColumn("_part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n = None, 0
        for batch in batches:
            numbers = []
            for g in batch.column(batch.schema.get_field_index(group)).to_pylist():
                here, n = g, (n + 1 if g == here else 0)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "_at"])

    ordered = cut(ordered.mapInArrow(count, ordered.withColumn("_at", F.lit(0).cast("long")).schema))
    counts = cut(ordered.groupBy("_part", group).agg(F.count("*").alias("n")))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy(group).agg(F.min("_part").alias("_first"), F.sum("n").alias("total"))
    starts = cut(starts.withColumn("_rank", F.row_number().over(Window.partitionBy("_first").orderBy(group))))
    per = starts.groupBy("_first").agg(F.count("*").alias("n"))  # a row for each partition
    per = per.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    groups = starts.join(per, "_first").select(group, "total", (F.col("_before") + F.col("_rank") - 1).alias("group_no"), F.lit(starts.count()).cast("long").alias("groups"))
    places = counts.withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(groups, group)
    return ordered.join(places, ["_part", group]).withColumn("index", F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def manifest(leaves: DataFrame, group: str = "source", key: str = "doc_id", digest: str = "leaf", carry: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, digest, *carry, group_no, groups, index, total, proof, above, subroot, root) of every leaf.

    ``digest`` is hex text. Leaves of a group ascend by ``key`` (null before others, repeated ones by their digest); while
    several nodes remain, every ``fanout`` consecutive ones, the last run of fewer or even one, become the
    digest of their hex texts. What remains is ``subroot``; those in the order of their groups, null
    first and bytewise, likewise give ``root``. ``proof`` and ``above`` are the siblings, binary, level
    by level from the leaf to its subroot and from there to the root. Only digests are shuffled, never the rows they are
    of; a group's nodes meet in superblocks of at most ``fanout`` ** ``levels``. Equal rows are leaves each. Empty: empty.
    """
    rows = leaves.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("_group"), F.col(key).alias("_key"), F.unhex(F.col(digest)).alias("_digest"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    rows = numbered(rows, "_group", ["_key", "_digest"])
    below = superblocks(rows.select(F.col("group_no").alias("group"), "index", "total", F.col("_digest").alias("digest")), fanout, levels)
    subroots = cut(below.where("index = 0").select(F.col("group").alias("group_no"), F.col("root").alias("subroot")))
    total = F.lit(subroots.count()).cast("long")
    top = superblocks(subroots.select(F.lit(0).cast("long").alias("group"), F.col("group_no").alias("index"), total.alias("total"), F.col("subroot").alias("digest")), fanout, levels)
    # a superblock's rows at a time, so that no group is a key of the join
    part = F.floor(F.col("index") / fanout**levels)
    parts = rows.select("group_no", part.alias("_bucket")).distinct()
    heads = parts.join(top.select(F.col("index").alias("group_no"), F.col("proof").alias("above"), "root"), "group_no")
    below = below.select(F.col("group").alias("group_no"), "index", "proof", F.col("root").alias("subroot"))
    out = rows.join(below, ["group_no", "index"]).withColumn("_bucket", part).join(heads, ["group_no", "_bucket"])
    texts = [F.lower(F.hex(c)).alias(n) for c, n in (("_digest", digest), ("subroot", "subroot"), ("root", "root"))]
    return out.select(F.col("_key").alias(key), texts[0], *[F.col(f"_carry_{c}").alias(c) for c in carry], "group_no", "groups", "index", "total", "proof", "above", *texts[1:])


def verify(proofs: DataFrame, digest: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """``proofs``, as ``manifest`` has them, with ``folded_root``, recomputed from column ``digest`` and the siblings,
    ``verified`` (it is ``root``) and ``proof_sha256``, the digest of the siblings' hex texts. A null digest has a null
    root and is not verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (digest, "proof", "above", "index", "total", "group_no", "groups")]
            roots, hashes = [], []
            for leaf, proof, above, index, total, no, groups in zip(*columns, strict=True):
                roots.append(None if leaf is None else fold(fold(bytes.fromhex(leaf), proof, index, total, fanout), above, no, groups, fanout).hex())
                hashes.append(parent([proof, above]).hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string()), pa.array(hashes, pa.string())], [*batch.schema.names, "folded_root", "proof_sha256"])

    schema = proofs.withColumns({c: F.lit(None).cast("string") for c in ("folded_root", "proof_sha256")}).schema
    return proofs.mapInArrow(run, schema).withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(struck, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    same = ~struck | F.coalesce(~F.contains("text", F.lit("\n")), F.lit(True))
    leaf = leaf_digest(*map(F.col, FIELDS))
    # texts are read once, for their digests
    leaves = cut(docs.select("doc_id", "source", leaf.alias("leaf"), F.when(~same, leaf_digest(*map(F.col, FIELDS[:-1]), tampered)).alias("tampered")))
    proofs = manifest(leaves, carry=("tampered",)).withColumn("shown", F.coalesce("tampered", "leaf"))
    return verify(proofs, "shown").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The tree level by level over all nodes; the checksum is worked out bit by bit.
ORACLE = """
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0, false) AS struck FROM documents, steps
), h AS (
  SELECT doc_id, source, {leaf} AS leaf, sha256(concat(head, coalesce(strlen(shown) || ':' || shown, '-'))) AS shown
  FROM (SELECT *, concat({head}) AS head, CASE WHEN struck THEN replace(text, chr(10), '') ELSE text END AS shown FROM d)
), l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS index, count(*) OVER (PARTITION BY source) AS total, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS no FROM h
), t AS (
  SELECT no, index, total, 0 AS level, leaf AS h FROM l
  UNION ALL SELECT no, index // 3, (total + 2) // 3, level + 1, sha256(string_agg(h, '' ORDER BY index)) FROM t WHERE total > 1 GROUP BY no, index // 3, total, level
), s AS (SELECT no, h AS subroot, count(*) OVER () AS total FROM t WHERE total = 1), u AS (
  SELECT no AS index, total, 0 AS level, subroot AS h FROM s
  UNION ALL SELECT index // 3, (total + 2) // 3, level + 1, sha256(string_agg(h, '' ORDER BY index)) FROM u WHERE total > 1 GROUP BY index // 3, total, level
), deep AS (SELECT no, max(level) AS levels FROM t GROUP BY no),
-- the runs of the sources' levels, and under -1 those of the levels above
runs AS (
  SELECT no, level, index // 3 AS run, list(h ORDER BY index) AS hs FROM t WHERE total > 1 GROUP BY ALL
  UNION ALL SELECT -1, level, index // 3, list(h ORDER BY index) FROM u WHERE total > 1 GROUP BY ALL
), f AS (
  SELECT l.doc_id, l.leaf, l.no, deep.levels, CASE WHEN deep.levels = 0 THEN l.no ELSE l.index END AS place, 0 AS level, l.shown AS cur, '' AS sib FROM l JOIN deep USING (no)
  UNION ALL
  SELECT f.doc_id, f.leaf, f.no, f.levels, CASE WHEN f.level + 1 = f.levels THEN f.no ELSE f.place // 3 END, f.level + 1,
    sha256(array_to_string(list_concat(hs[1 : f.place % 3], [f.cur], hs[f.place % 3 + 2 :]), '')), concat(f.sib, array_to_string(list_concat(hs[1 : f.place % 3], hs[f.place % 3 + 2 :]), ''))
  FROM f JOIN runs ON runs.no = CASE WHEN f.level < f.levels THEN f.no ELSE -1 END AND runs.level = CASE WHEN f.level < f.levels THEN f.level ELSE f.level - f.levels END AND runs.run = f.place // 3
), root AS (SELECT h AS root, level FROM u WHERE total = 1)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM f JOIN root ON f.level = f.levels + root.level JOIN s ON s.no = f.no
""".format(
    head=", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS[:-1]),
    leaf="sha256(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS) + "))",
)

"""A Merkle manifest of a dataset, collapsed in blocks of higher-order SQL.

Each row is a leaf digest, each group of rows a hash tree over its leaves in
order, and one more tree over the groups' roots gives the root of the dataset.
A level pairs neighbours, so a block of a power of two leaves collapses by
itself: its digests are one ordered array, and sequence, transform, slice and
aggregate make its levels inside Spark.  The roots of the blocks are the leaves
of the next pass, a block's fraction as many, until one is left.  Proofs come
back the same way: a row's siblings in its block, then those of its block's root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positions, shared_table

#: Leaves of a block and the levels it collapses; BLOCK = 2 ** LEVELS.
LEVELS = 8
BLOCK = 1 << LEVELS
#: Fields of a row of ``documents``, in the order of its leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes of all parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the value's length in bytes, a colon and the value, so that no two rows read alike."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


_STEPS = f"slice(sequence(1, {LEVELS}), 1, _height)"
_NEXT = "transform(sequence(0, (size(element_at(acc, -1)) + 1) div 2 - 1), i -> sha2(array_join(slice(element_at(acc, -1), 2 * i + 1, 2), ''), 256))"
_COLLAPSE = f"aggregate({_STEPS}, array(transform(_nodes, x -> x.digest)), (acc, k) -> concat(acc, array({_NEXT})))"
_SIBLING = """
struct(
  if(shiftright(i, k - 1) % 2 = 1, get(get(_levels, k - 1), shiftright(i, k - 1) - 1), '') AS l,
  if(shiftright(i, k - 1) % 2 = 1, '', coalesce(get(get(_levels, k - 1), shiftright(i, k - 1) + 1), '')) AS r)
"""
_LEAVES = f"inline(transform(sequence(0, size(_own) - 1), i -> struct(_block * {BLOCK} + i AS _at, get(get(_levels, 0), i) AS digest, get(_own, i) AS own, transform({_STEPS}, k -> {_SIBLING}) AS path)))"


def _collapsed(nodes: DataFrame) -> DataFrame:
    """Blocks (_key, _block, _n, _height, _levels, _own) of nodes (_key, _at, _n, digest, own); _levels[0] are the nodes, the last level is the block's root."""
    height = F.expr(f"CASE WHEN _n > {BLOCK} THEN {LEVELS} WHEN _n = 1 THEN 0 ELSE length(bin(_n - 1)) END")
    grouped = nodes.groupBy("_key", F.floor(F.col("_at") / BLOCK).alias("_block")).agg(
        F.first("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_at", "digest", "own"))).alias("_nodes")
    )
    made = grouped.withColumn("_height", height).withColumn("_levels", F.expr(_COLLAPSE))
    return shared_table(made.select("_key", "_block", "_n", "_height", "_levels", F.expr("transform(_nodes, x -> x.own)").alias("_own")))


def _tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of all passes, and (_key, digest) of each key's root."""
    tables, most = [], nodes.agg(F.max("_n")).first()[0] or 0
    while True:
        tables.append(_collapsed(nodes))
        top = F.element_at(F.element_at("_levels", -1), 1).alias("digest")
        if most <= BLOCK:
            return tables, tables[-1].select("_key", top)
        most = -(-most // BLOCK)
        nodes = tables[-1].select("_key", F.col("_block").alias("_at"), F.ceil(F.col("_n") / BLOCK).alias("_n"), top, F.lit(None).cast("boolean").alias("own"))


def _paths(tables: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Rows (_key, _at, digest, own, path, above) of all leaves; ``roots`` are (_key, path, above) of the keys' roots."""
    rows = roots.withColumn("_at", F.lit(0).cast("long"))
    for table in reversed(tables):
        upper = rows.select("_key", F.col("_at").alias("_block"), F.col("path").alias("_rest"), "above")
        inner = table.join(upper, ["_key", "_block"]).select("_key", "_rest", "above", F.expr(_LEAVES))
        rows = inner.select("_key", "_at", "digest", "own", F.concat("path", "_rest").alias("path"), "above")
    return rows


def manifest(df: DataFrame, leaf_digest: Column, group: str = "lang", id_col: str = "doc_id", carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``df``: (_row, group, place, n_leaves, leaf, path, subroot, root, *carry).

    Leaves of a group ascend by id, NULL first, then by digest, so equal rows
    (and rows with equal ids) have one defined order; groups ascend by their
    UTF-8 bytes, the NULL group first.  ``place`` counts from 0 in a group of
    ``n_leaves``.  ``path`` has the siblings (l, r), level by level from the
    leaf to the root of all; '' where there is none.  An empty table gives no
    rows.  Columns other than those named are not read, and none of them is
    kept but ``carry``.
    """
    rows = df.select(
        F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("_key"),
        F.col(id_col).alias("_id"), leaf_digest.alias("digest"), F.struct(F.lit(True).alias("_set"), F.col(group).alias("_group"), *carry).alias("own"), F.monotonically_increasing_id().alias("_row"),
    )
    placed = positions(shared_table(rows), "_key", "_id", "digest", "_row")
    leaves = placed.select("_key", "_at", "_n", "digest", F.struct("own", "_row", "_n").alias("own"))
    tables, subroots = _tree(leaves)
    groups = positions(subroots.select(F.lit("").alias("_one"), "_key", "digest"), "_one", "_key")
    upper, root = _tree(groups.select(F.col("_one").alias("_key"), "_at", "_n", "digest", F.col("_key").alias("own")))
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    over = _paths(upper, root.select("_key", nothing.alias("path"), F.col("digest").alias("above")))
    found = _paths(tables, over.select(F.col("own").alias("_key"), "path", F.struct(F.col("digest").alias("subroot"), F.col("above").alias("root")).alias("above")))
    return found.select(
        "own._row", F.col("own.own._group").alias(group), F.col("_at").alias("place"), F.col("own._n").alias("n_leaves"), F.col("digest").alias("leaf"), "path", "above.subroot", "above.root",
        *[F.col("own.own")[name].alias(name) for name in rows.schema["own"].dataType.names[2:]],
    )


def proof(path: Column) -> Column:
    """All siblings of a path in one string, from leaf to root and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_digest, lambda acc, s: digest(s["l"], acc, s["r"]))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    values = {c: F.col(c) for c in FIELDS}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(*(values | {"n_chars": F.col("n_chars") + 1}).values()))
    rows = manifest(docs, leaf(*values.values()), carry=(F.col("doc_id"), tampered.alias("tampered")))
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
#: CRC-32 of an ASCII string, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '-') AS key, {_LEAF} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.replace("CAST(n_chars AS VARCHAR)", "CAST(n_chars + 1 AS VARCHAR)")} ELSE {_LEAF} END AS shown
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM d),
tree(key, level, pos, n, digest) AS (
  SELECT key, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT key, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY key, level, pos // 2),
heads AS (SELECT key, digest, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(level, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM heads
  UNION ALL
  SELECT level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 2),
low(rid, key, level, pos, n, value, proof) AS (
  SELECT rid, key, 0, pos, n, shown, '' FROM placed
  UNION ALL
  SELECT p.rid, p.key, p.level + 1, p.pos // 2, (p.n + 1) // 2,
    sha256(CASE WHEN p.pos % 2 = 1 THEN s.digest || p.value ELSE p.value || coalesce(s.digest, '') END), p.proof || coalesce(s.digest, '')
  FROM low p LEFT JOIN tree s ON s.key = p.key AND s.level = p.level AND s.pos = xor(p.pos, 1) WHERE p.n > 1),
high(rid, level, pos, n, value, proof) AS (
  SELECT p.rid, 0, h.pos, h.n, p.value, p.proof FROM low p JOIN heads h USING (key) WHERE p.n = 1
  UNION ALL
  SELECT p.rid, p.level + 1, p.pos // 2, (p.n + 1) // 2,
    sha256(CASE WHEN p.pos % 2 = 1 THEN s.digest || p.value ELSE p.value || coalesce(s.digest, '') END), p.proof || coalesce(s.digest, '')
  FROM high p LEFT JOIN crown s ON s.level = p.level AND s.pos = xor(p.pos, 1) WHERE p.n > 1)
SELECT d.doc_id, d.leaf, h.digest AS subroot, c.digest AS root, sha256(p.proof) AS proof_sha256, p.value AS folded_root, p.value = c.digest AS verified
FROM d JOIN heads h USING (key) JOIN high p ON p.rid = d.rid AND p.n = 1 JOIN crown c ON c.n = 1
"""

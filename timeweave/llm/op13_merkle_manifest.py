"""Merkle manifest of a dataset: leaves of rows, subtrees by group, one root, and a proof for each row.

A leaf is the digest of a row's fields. Leaves of a group (``lang``) are numbered by id; every
``arity`` consecutive nodes become the digest of their digests, until one is left, the group's
subroot; subroots, ordered by group, become the root in the same way.

Each level is a self-join: a node sends its digest to the indices of its siblings, computed from its
own (``index ^ 1`` for binary trees, else the other slots of its run), an equality join by (group,
index) brings it there, and rows of slot zero, which then hold the whole run, emit the parents. Upper
levels have an eighth of the rows each.

Proofs go down again: a node's path is its siblings, then its parent's path. Paths are joined to runs
of siblings by the parent's index, so a level shuffles an eighth of the paths that it gives out. The
proof of a row is the digest of its path; the root is recomputed from the row's leaf, altered
or not, by folding the path.

Numbering does not sort in one place: rows are dealt to ranges of (group, id, leaf), counted, and
numbered within. Every join key is unique on one side and bounded by the arity on the other, so a group
with a third of all rows is as many small keys as any. Digests are 32 bytes between levels.

Defined results: null fields are ``-``; rows of null ids come first in their group and are not tampered
with; a null group comes before all. Rows of one id are ordered by leaf; equal rows have the places
that they share in any order. Columns besides the fields are not read. An empty table gives no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import Store

#: The fields of a leaf, in order; rows are grouped by one and ordered by another.
FIELDS, GROUP, ID = ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id"
ARITY, EVERY = 8, 3
_PATH = "array<struct<slot:int,siblings:binary>>"


def H(*parts: Column) -> Column:
    """The digest of strings (or of digests in bytes, read as hex text), in bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def framed(value: Column) -> Column:
    """A field with its length before it, ``-`` if null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaves(docs: DataFrame, fields: list[str] = FIELDS, group: str = GROUP, id_col: str = ID, folded: str = "text", every: int = EVERY) -> DataFrame:
    """``id, g, leaf, tampered``: ``g`` orders groups as their values do, null first; ``tampered`` is the
    leaf with A-Z of the text in lower case, null for rows that are left as they are."""
    own = {c: F.col(f"`{c}`") for c in fields}
    lower = F.translate(own[folded].cast("string"), ascii_uppercase, ascii_lowercase)
    chosen = F.crc32(own[id_col].cast("string").cast("binary")) % every == 0
    other = H(*[framed(lower if c == folded else own[c]) for c in fields])
    name = F.coalesce(F.concat(F.lit("="), own[group].cast("string")), F.lit("-"))
    return docs.select(own[id_col].alias("id"), name.alias("g"), H(*[framed(own[c]) for c in fields]).alias("leaf"), F.when(chosen, other).alias("tampered"))


def numbered(rows: DataFrame, group: str, order: list[str], store: Store, name: str) -> DataFrame:
    """``rows`` with ``i``, their place in their group from 0, and ``n``, the group's size. Ranges that
    Spark finds by sampling are written once; a row a range and group is added up before them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows are dealt too
    dealt = store.keep(tied.repartitionByRange(parts, group, *order, "_tie").withColumn("_part", F.spark_partition_id()), f"{name}-ranges")
    sized = dealt.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    own = Window.partitionBy(group)
    before = F.sum("_rows").over(own.orderBy("_part")) - F.col("_rows")
    starts = store.keep(sized.select(group, "_part", before.alias("_before"), F.sum("_rows").over(own).alias("n")), f"{name}-starts")
    # a group's rows in one range are one sort; ranges are as many as partitions, whatever the groups
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order, "_tie")) - 1
    return dealt.withColumn("_place", place).join(starts, [group, "_part"]).withColumn("i", F.col("_place") + F.col("_before")).drop("_tie", "_part", "_rows", "_place", "_before")


def sibling_index(i: Column, k: Column, arity: int) -> Column:
    """The k-th other index (k from 1 to arity - 1) of the run that ``i`` is in."""
    if arity == 2:
        return i.bitwiseXOR(F.lit(1).cast("long"))
    slot = i % arity
    return i - slot + (slot + k) % arity


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """``nodes`` (g, i, n, hash, ...) with ``siblings``: the digests of the others of their run, in
    order. Nodes that are alone in their run have an empty one."""
    sent = nodes.select("g", F.col("i").alias("_from"), "hash", F.explode(F.sequence(F.lit(1), F.lit(arity - 1))).alias("_k"), "n")
    sent = sent.select("g", sibling_index(F.col("_from"), F.col("_k"), arity).alias("i"), F.struct("_from", "hash").alias("_sent"), "n").where("i < n").drop("n")
    own = [c for c in nodes.columns if c not in ("g", "i")]
    met = nodes.join(sent.hint("merge"), ["g", "i"], "left")
    grouped = met.groupBy("g", "i").agg(*[F.first(c).alias(c) for c in own], F.array_sort(F.collect_list("_sent")).alias("_sent"))
    joined = F.aggregate("_sent", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["hash"]))
    return grouped.withColumn("siblings", joined).drop("_sent")


def parents(level: DataFrame, arity: int = ARITY) -> DataFrame:
    """``g, i, n, hash`` of the next level, from the rows of slot zero."""
    first = level.where((F.col("i") % arity == 0) & (F.col("n") > 1))
    return first.select("g", F.floor(F.col("i") / arity).alias("i"), F.ceil(F.col("n") / arity).alias("n"), H(as_hex(F.col("hash")), as_hex(F.col("siblings"))).alias("hash"))


def tree(nodes: DataFrame, store: Store, name: str, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The levels of every group's tree, each with siblings, from the bottom, and ``g, hash`` of the tops."""
    levels: list[DataFrame] = []
    while True:
        level = store.keep(with_siblings(nodes, arity), f"{name}-{len(levels)}")
        levels.append(level)
        more = level.where("n > 1").select(F.max("n")).first()[0]
        if more is None:
            break
        nodes = parents(level, arity)
    tops = levels[0].where("n = 1").select("g", "hash")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("n = 1").select("g", "hash"))
    return levels, tops


def step(arity: int) -> Column:
    """One element of a path, of a node with its siblings."""
    return F.array(F.struct((F.col("i") % arity).cast("int").alias("slot"), F.col("siblings"))).cast(_PATH)


def paths(levels: list[DataFrame], tops: DataFrame, store: Store, name: str, arity: int = ARITY) -> DataFrame:
    """The rows of the lowest level with ``path``, from the bottom to what ``tops`` (g, path, ...) has;
    the other columns of ``tops`` come down too."""
    down = None
    above = [c for c in tops.columns if c not in ("g", "path")]
    for n in reversed(range(len(levels))):
        own = levels[n].drop("hash") if n else levels[n]
        done = own.where("n = 1").join(tops, "g")
        rows = done
        if down is not None:
            up = down.select("g", F.col("i").alias("_up"), "path", *above)
            joined = own.where("n > 1").withColumn("_up", F.floor(F.col("i") / arity)).join(up.hint("merge"), ["g", "_up"]).drop("_up")
            rows = done.unionByName(joined.withColumn("path", F.concat(step(arity), "path")))
        down = store.keep(rows.drop("siblings"), f"{name}-{n}") if n else rows.drop("siblings")
    return down


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def up(now: Column, s: Column) -> Column:
        before, after = F.substring(s["siblings"], F.lit(1), 32 * s["slot"]), F.substring(s["siblings"], 32 * s["slot"] + 1, F.octet_length(s["siblings"]))
        return H(as_hex(F.concat(before, now, after)))

    return F.aggregate(path, leaf, up)


def proof(path: Column) -> Column:
    """The digest (hex text) of a path's siblings."""
    return F.sha2(as_hex(F.aggregate(path, F.lit(b"").cast("binary"), lambda a, s: F.concat(a, s["siblings"]))), 256)


def manifest(docs: DataFrame, arity: int = ARITY, fields: list[str] = FIELDS, group: str = GROUP, id_col: str = ID, folded: str = "text", every: int = EVERY) -> DataFrame:
    """``id, leaf, subroot, root`` (digests in bytes)``, path, tampered`` of each row."""
    store = Store(docs.sparkSession, "merkle")
    rows = numbered(leaves(docs, fields, group, id_col, folded, every), "g", ["id", "leaf"], store, "leaves")
    levels, tops = tree(rows.withColumnRenamed("leaf", "hash"), store, "node", arity)
    subroots = store.keep(tops.select(F.lit("all").alias("all"), F.col("g").alias("of"), "hash"), "subroots")
    ordered = numbered(subroots, "all", ["of"], store, "subroots-in-order").withColumnRenamed("all", "g")
    upper, root = tree(ordered, store, "upper", arity)
    summit = paths(upper, root.select("g", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root")), store, "upper-path", arity)
    over = store.keep(summit.select(F.col("of").alias("g"), F.col("hash").alias("subroot"), "root", "path"), "over")
    whole = paths(levels, over, store, "path", arity)
    store.only("node-0", "path-1", "over")  # which the result reads
    return whole.select("id", F.col("hash").alias("leaf"), "subroot", "root", "path", "tampered")


def digests(docs: DataFrame) -> DataFrame:
    """The manifest with digests as hex text, the proof's digest, and whether the row still gives the root."""
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = manifest(docs).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    named = [as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return rows.select("doc_id", *named, "proof_sha256", as_hex(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same rows by SQL. Rows are told apart by their place in the group, as ids may repeat.
SQL = r"""
WITH RECURSIVE src AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce('=' || lang, '-') AS g, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    list_reduce(list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i + 1]) AS BIGINT)),
      lambda c, b: list_reduce(range(8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)) AS c FROM documents),
framed AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM src),
hashed AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM framed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
nodes AS (
  SELECT g, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL SELECT g, level + 1, i // 8, CAST(ceil(any_value(n) / 8.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 8),
tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
over_nodes AS (
  SELECT 0 AS level, i, n, h FROM tops
  UNION ALL SELECT level + 1, i // 8, CAST(ceil(any_value(n) / 8.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY i)) FROM over_nodes WHERE n > 1 GROUP BY level, i // 8),
every AS (
  SELECT g, level, i, n, h FROM nodes WHERE n > 1
  UNION ALL SELECT '' AS g, level + 1000, i, n, h FROM over_nodes WHERE n > 1),
steps AS (
  SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS left_h, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS right_h
  FROM every a JOIN every b ON a.g = b.g AND a.level = b.level AND a.i // 8 = b.i // 8 GROUP BY a.g, a.level, a.i),
walk AS (
  SELECT p.g, p.i AS leaf_i, CAST(0 AS BIGINT) AS up, CAST(p.i AS BIGINT) AS i, coalesce(p.tampered, p.leaf) AS h, '' AS said, p.n FROM placed p
  UNION ALL
  SELECT w.g, w.leaf_i, CASE WHEN w.n > 1 THEN w.up + 1 WHEN w.up < 1000 THEN 1000 ELSE w.up + 1 END,
    CASE WHEN w.n > 1 THEN w.i // 8 ELSE t.i END, CASE WHEN w.n > 1 THEN sha256(s.left_h || w.h || s.right_h) ELSE w.h END,
    CASE WHEN w.n > 1 THEN w.said || s.left_h || s.right_h ELSE w.said END, CASE WHEN w.n > 1 THEN CAST(ceil(w.n / 8.0) AS BIGINT) ELSE t.n END
  FROM walk w LEFT JOIN steps s ON w.n > 1 AND s.level = w.up AND s.i = w.i AND s.g = CASE WHEN w.up < 1000 THEN w.g ELSE '' END
    LEFT JOIN tops t ON t.g = w.g
  WHERE w.n > 1 OR w.up < 1000),
ends AS (SELECT * FROM walk WHERE up >= 1000 AND n = 1),
root AS (SELECT h FROM over_nodes WHERE n = 1)
SELECT p.doc_id, p.leaf, t.h AS subroot, r.h AS root, sha256(e.said) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM placed p JOIN tops t ON t.g = p.g JOIN ends e ON e.g = p.g AND e.leaf_i = p.i CROSS JOIN root r
"""

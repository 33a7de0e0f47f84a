"""Merkle manifest of a dataset: hash trees per group under one root, and a proof for every row.

Every node is labelled with the interval of leaf ranks that it covers, so ancestry is containment of
intervals and the siblings of a node are its parent's interval without its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypoint.llm.common import stored
from waypoint.operators.ordered import ordinal_rank

#: Children of a node.
ARITY = 3
#: Levels in a bucket: a block holds at most ``ARITY ** SPAN`` nodes of its lowest level.
SPAN = 5
WIDTH = ARITY**SPAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hash of a row: every value with its length in bytes before it, ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda d, step: digest(F.concat(step["left"], d, step["right"])))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings on the way to the root, left to right, level by level."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _parents(level: Column) -> Column:
    last = F.floor((F.size(level) - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.array_join(F.slice(level, i * ARITY + 1, ARITY), "")))


def _height(n: Column) -> Column:
    """Least number of levels whose top covers ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**k) for k in range(40)]), lambda w: w < n))


def _blocks(members: DataFrame, bucket: int) -> DataFrame:
    """Nodes (tree, n, lo, digest, ...) of level ``bucket * SPAN`` in blocks, with the digests of the levels above them."""
    unit = WIDTH**bucket
    rows = members.groupBy("tree", "n", F.floor(F.col("lo") / (unit * WIDTH)).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("lo", *[c for c in members.columns if c not in ("tree", "n", "lo")]))).alias("members")
    )
    steps = F.greatest(F.lit(0), F.least(F.lit(SPAN), _height(F.col("n")) - SPAN * bucket))
    start = F.array(F.transform("members", lambda m: m["digest"]))
    rounds = F.slice(F.array(*[F.lit(k) for k in range(SPAN)]), F.lit(1), steps)
    levels = F.aggregate(rounds, start, lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    lo = F.col("block") * unit * WIDTH
    out = rows.select(
        "tree", "n", "block", lo.alias("lo"), F.least("n", lo + unit * WIDTH).alias("hi"), steps.alias("steps"), "members", levels.alias("levels")
    )
    return stored(out, f"merkle-{bucket}")


def _tops(blocks: DataFrame) -> DataFrame:
    return blocks.select("tree", "n", "lo", F.element_at(F.element_at("levels", -1), 1).alias("digest"))


def _grow(leaves: DataFrame) -> list[DataFrame]:
    """All buckets of levels over leaves (tree, n, lo, digest, ...), the lowest first."""
    buckets = [_blocks(leaves, 0)]
    highest = buckets[0].agg(F.max(_height(F.col("n")))).first()[0] or 0
    while len(buckets) * SPAN < highest:
        buckets.append(_blocks(_tops(buckets[-1]), len(buckets)))
    return buckets


def _siblings(unit: int) -> Callable[[Column], Column]:
    """For a member's first leaf, what each parent inside the block covers besides the node itself."""
    widths = F.slice(F.array(*[F.lit(unit * ARITY**k) for k in range(SPAN)]), F.lit(1), F.col("steps"))

    def covered(level: Column, width: Column, start: Column, end: Column) -> Column:
        at = F.floor((start - F.col("lo")) / width).cast("int")
        return F.array_join(F.slice(level, at + 1, F.floor((end - start) / width).cast("int")), "")

    def step(first: Column, width: Column, k: Column) -> Column:
        level = F.element_at("levels", k + 1)
        own, parent = first - first % width, first - first % (width * ARITY)
        return F.struct(
            covered(level, width, parent, own).alias("left"),
            covered(level, width, own + width, parent + width * ARITY).alias("right"),
        )

    return lambda first: F.transform(widths, lambda width, k: step(first, width, k))


def _descend(buckets: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Members of the lowest bucket with ``path``; ``tops`` has tree, path above the tree and what every member gets.

    Blocks meet the node they hang from by tree and bucket of their interval, which must lie inside the node's.
    """
    kept = [c for c in tops.columns if c not in ("tree", "path")]
    upper = tops.withColumns({"a_block": F.lit(0).cast("long"), "a_lo": F.lit(0).cast("long"), "a_hi": F.lit(2**62)})
    for k in reversed(range(len(buckets))):
        unit = WIDTH**k
        above = upper.withColumnRenamed("tree", "a_tree")
        inside = (F.col("tree") == F.col("a_tree")) & (F.col("block") == F.col("a_block")) & (F.col("lo") >= F.col("a_lo")) & (F.col("hi") <= F.col("a_hi"))
        found = buckets[k].join(above, inside)
        siblings = _siblings(unit)
        fields = buckets[k].schema["members"].dataType.elementType.names
        member = F.transform("members", lambda m: F.struct(*[m[f].alias(f"m_{f}") for f in fields], siblings(m["lo"]).alias("own")))
        rows = found.select("tree", "n", "path", *kept, F.inline(member)).withColumn("path", F.concat("own", "path"))
        if k:
            upper = rows.select(
                "tree", "path", *kept,
                F.floor(F.col("m_lo") / unit).cast("long").alias("a_block"),
                F.col("m_lo").alias("a_lo"),
                F.least("n", F.col("m_lo") + unit).alias("a_hi"),
            )
    return rows.select("tree", "path", *kept, *[F.col(f"m_{f}").alias(f) for f in fields])


@dataclass(frozen=True)
class Manifest:
    """Trees of all groups and the tree of their roots, as tables of blocks in the shared folder."""

    groups: list[DataFrame]
    top: list[DataFrame]

    def nodes(self) -> DataFrame:
        """Every node: scope (group or top), tree, level, covered leaf ranks [lo, hi), digest."""
        parts = []
        for scope, buckets in (("group", self.groups), ("top", self.top)):
            for k, blocks in enumerate(buckets):
                named = blocks.select("tree", "n", "lo", "steps", F.posexplode("levels").alias("k", "level"))
                if k + 1 < len(buckets):  # the top level of a full block is the lowest one of the bucket above
                    named = named.where(f"k < {SPAN}")
                elif k:  # trees that ended below were carried up as they are
                    named = named.where(_height(F.col("n")) >= SPAN * k)
                width = F.element_at(F.array(*[F.lit(WIDTH**k * ARITY**i) for i in range(SPAN + 1)]), F.col("k") + 1)
                at = F.col("lo") + F.col("at") * width
                parts.append(
                    named.select("*", F.posexplode("level").alias("at", "digest")).select(
                        F.lit(scope).alias("scope"), "tree", (F.col("k") + SPAN * k).alias("level"), at.alias("lo"), F.least("n", at + width).alias("hi"), "digest"
                    )
                )
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.dropDuplicates(["scope", "tree", "level", "lo"])

    def paths(self) -> DataFrame:
        """Every leaf with what it carries, ``path`` (per level the digests left and right of it), ``subroot`` and ``root``."""
        root = _tops(self.top[-1]).select(F.col("digest").alias("root"), F.lit("").alias("tree"))
        empty = F.array().cast("array<struct<left: string, right: string>>")
        above = _descend(self.top, root.withColumn("path", empty))
        return _descend(self.groups, above.select(F.col("group").alias("tree"), "path", "root", F.col("digest").alias("subroot")))


def manifest(leaves: DataFrame) -> Manifest:
    """Trees over rows (tree, id, digest, ...): leaves ascend by id per tree, trees by name; further columns are carried.

    Null ids come first, equal ids in order of their digests. Ranks come from a sort across the cluster,
    so a tree may hold any share of the rows; no group but blocks of at most ``WIDTH`` nodes is formed.
    """
    given = stored(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    ranked = ordinal_rank(given, ["tree"], ["id", "digest", "tie"], "lo", size="n")
    groups = _grow(ranked.drop("tie").withColumn("lo", F.col("lo") - 1))
    roots = stored(_tops(groups[-1]).select(F.col("tree").alias("group"), "digest"), "merkle-roots")
    ranked = ordinal_rank(roots, [], ["group"], "lo", size="n")
    return Manifest(groups, _grow(ranked.withColumns({"tree": F.lit(""), "lo": F.col("lo") - 1})))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of the tampered copy, verified.

    The tampered copy loses the line feeds of the texts whose CRC-32 of the decimal id is even; its
    leaves are folded with the siblings of the original.

    Defined cases: null columns are hashed as ``-``; a null source is the first group, a null id the
    first leaf of its group and never tampered with; rows with the same id are leaves of their own,
    equal rows too; a group of one row has that leaf as its root, one group alone gives the root; an
    empty table gives an empty table. Texts are hashed whole. Only the five columns are read, others may
    have any name.
    """
    own = docs.select(*[F.col(c) for c in FIELDS])
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    after = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    leaves = own.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").alias("id"),
        leaf_digest([F.col(c) for c in FIELDS]).alias("digest"),
        F.when(changed, leaf_digest(after)).alias("tampered"),
    )
    paths = manifest(leaves).paths()
    out = paths.select(
        F.col("id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(b))
),
docs AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS c,
         coalesce('=' || source, '') AS tree,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 2 = 0 AS even
  FROM documents d, crc_table
),
given AS (
  SELECT doc_id, tree, pos, c,
         sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
           || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
           || coalesce(strlen(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END) || ':'
                       || CASE WHEN even THEN replace(text, chr(10), '') ELSE text END, '-')) AS tampered
  FROM docs
),
up AS (
  SELECT tree, 0 AS lvl, pos, leaf AS d, c FROM given
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(c) + 2) // 3
  FROM up WHERE c > 1 GROUP BY tree, lvl, pos // 3
),
subroots AS (
  SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS c FROM up WHERE c = 1
),
top AS (
  SELECT 0 AS lvl, pos, d, c FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(c) + 2) // 3
  FROM top WHERE c > 1 GROUP BY lvl, pos // 3
),
folding AS (
  SELECT doc_id, tree, leaf, 0 AS lvl, pos, c, tampered AS f, '' AS proof FROM given
  UNION ALL
  SELECT a.doc_id, a.tree, a.leaf, a.lvl + 1, any_value(a.pos) // 3, (any_value(a.c) + 2) // 3,
         sha256(string_agg(CASE WHEN u.pos = a.pos THEN a.f ELSE u.d END, '' ORDER BY u.pos)),
         any_value(a.proof) || coalesce(string_agg(u.d, '' ORDER BY u.pos) FILTER (u.pos <> a.pos), '')
  FROM folding a JOIN up u ON u.tree = a.tree AND u.lvl = a.lvl AND u.pos // 3 = a.pos // 3
  WHERE a.c > 1 GROUP BY a.doc_id, a.tree, a.leaf, a.lvl
),
ends AS (
  SELECT f.doc_id, f.tree, f.leaf, s.d AS subroot, 0 AS lvl, s.pos, s.c, f.f, f.proof
  FROM folding f JOIN subroots s ON s.tree = f.tree WHERE f.c = 1
),
finish AS (
  SELECT * FROM ends
  UNION ALL
  SELECT a.doc_id, a.tree, a.leaf, a.subroot, a.lvl + 1, any_value(a.pos) // 3, (any_value(a.c) + 2) // 3,
         sha256(string_agg(CASE WHEN u.pos = a.pos THEN a.f ELSE u.d END, '' ORDER BY u.pos)),
         any_value(a.proof) || coalesce(string_agg(u.d, '' ORDER BY u.pos) FILTER (u.pos <> a.pos), '')
  FROM finish a JOIN top u ON u.lvl = a.lvl AND u.pos // 3 = a.pos // 3
  WHERE a.c > 1 GROUP BY a.doc_id, a.tree, a.leaf, a.subroot, a.lvl
)
SELECT f.doc_id, f.leaf, f.subroot, t.d AS root, sha256(f.proof) AS proof_sha256, f.f AS folded_root, f.f = t.d AS verified
FROM finish f, top t WHERE f.c = 1 AND t.c = 1
"""

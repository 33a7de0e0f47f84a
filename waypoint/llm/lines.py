"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypoint.llm.common import WHITE, stored

#: A key is hot if it holds more than one of so many lines; there are at most as many hot keys.
HOT_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(WHITE))
    plain = F.octet_length(bare) == F.char_length(bare)  # nothing but ASCII: lower() changes A-Z alone, and faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _without(text: Column, drops: Column) -> Column:
    """The text without the lines at the ascending positions ``drops``, in time linear in the lines.

    The split text is bound to a lambda variable, so it is split once; between two drops a slice stays.
    """

    def rebuilt(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(-1)), drops)
        ends = F.concat(drops, F.array(F.size(lines)))
        kept = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))
        return F.array_join(F.flatten(kept), "\n")

    return F.transform(F.array(F.split(text, "\n", -1)), rebuilt)[0]


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Documents without lines that many documents share; adds ``n_lines`` and ``n_dropped``.

    A key (see ``line_key``) of at least ``min_chars`` code points found in at least ``min_docs``
    different ids loses all its lines except those in the largest id holding it. The other lines stay
    in their order, joined by a line feed.

    Defined cases: a null or empty text is one empty line and stays as it is; a null id counts as one
    id, below all others; rows repeated with the same id and text lose the same lines and count as one
    document; an empty table gives an empty table. Further columns pass through; of those named
    ``n_lines`` or ``n_dropped`` the new ones replace the old, and names beginning with ``_ld_`` are
    reserved.

    Lines are split and hashed once; ids, positions and 16-byte hashes are written, and counted and joined
    from there. A key held by a third of all rows is counted by (key, id) first. Keys with more than a
    ``HOT_SHARE``-th of the lines, so at most that many, meet their lines by a broadcast, the others by a
    shuffle in which no key has more.
    """
    t, i = F.col(text_col), F.col(id_col)
    base = docs.select(i.alias("_ld_id"), F.xxhash64(t).alias("_ld_hash"), t.alias("_ld_text")).where("_ld_text is not null")
    lines = base.select("_ld_id", "_ld_hash", F.posexplode(F.split("_ld_text", "\n", -1)).alias("_ld_pos", "_ld_line"))
    long_enough = F.char_length(F.btrim("_ld_line", F.lit(WHITE))) >= min_chars
    key = F.unhex(F.md5(line_key(F.col("_ld_line")))).alias("_ld_key")
    keyed = stored(lines.where(long_enough).select("_ld_id", "_ld_hash", "_ld_pos", key), "lines")
    least = F.lit(-(2**63)) if dict(docs.dtypes)[id_col] == "bigint" else F.lit("")
    known = F.coalesce("_ld_id", least)
    shared = (
        keyed.groupBy("_ld_key", known.alias("_ld_known"))
        .agg(F.count("*").alias("_ld_lines"))
        .groupBy("_ld_key")
        .agg(F.count("*").alias("_ld_n"), F.max("_ld_known").alias("_ld_last"), F.sum("_ld_lines").alias("_ld_lines"))
        .where(F.col("_ld_n") >= min_docs)
        .drop("_ld_n")
    )
    shared = stored(shared, "shared-lines")
    hot = F.col("_ld_lines") > keyed.count() // HOT_SHARE
    met = keyed.join(F.broadcast(shared.where(hot).select("_ld_key", F.col("_ld_last").alias("_ld_hot"))), "_ld_key", "left")
    common = met.where("_ld_hot is not null").withColumnRenamed("_ld_hot", "_ld_last")
    rest = met.where("_ld_hot is null").drop("_ld_hot").join(shared.where(~hot).drop("_ld_lines"), "_ld_key")
    drops = (
        common.unionByName(rest)
        .where(known != F.col("_ld_last"))
        .groupBy("_ld_id", "_ld_hash")
        .agg(F.sort_array(F.collect_set("_ld_pos")).alias("_ld_drops"))
        .withColumnsRenamed({"_ld_id": "_ld_id2", "_ld_hash": "_ld_hash2"})
    )
    joined = docs.withColumn("_ld_hash", F.xxhash64(t)).join(
        drops, i.eqNullSafe(F.col("_ld_id2")) & (F.col("_ld_hash") == F.col("_ld_hash2")), "left"
    )
    out = joined.withColumns(
        {
            "n_lines": F.coalesce(F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long"),
            "n_dropped": F.coalesce(F.size("_ld_drops"), F.lit(0)).cast("long"),
            text_col: F.when(F.col("_ld_drops").isNull(), t).otherwise(_without(t, F.col("_ld_drops"))),
        }
    )
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*keep, "n_lines", "n_dropped")


SQL = """
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u
),
shared AS (
  SELECT k, max(doc_id) AS last_id FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(s.last_id <> l.doc_id, false) AS gone
  FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text (null text: the empty one)."""
    out = drop_shared_lines(docs.select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))

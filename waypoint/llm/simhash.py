"""SimHash near-dedup by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waypoint.llm.common import connected, lean, stored

CHUNK = 65_536


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 of all word shingles, as a signed long; 0 without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    size = min(shingle, len(words))
    ones, total = np.zeros(64, np.int64), len(words) - size + 1
    for a in range(0, total, CHUNK):
        n = min(CHUNK, total - a)
        grams = map(b" ".join, zip(*(words[a + k : a + k + n] for k in range(size)), strict=True))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), ">u8", n)
        ones += np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(lean(run), f"id {dict(source.dtypes)['id']}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(src, dst) between distinct fingerprints (column fp) that connect just what links of at most max_bits do.

    Two fingerprints that differ in at most k bits share at least 8 - k of their 8 positional bytes. The
    tally over single-byte postings would meet nearly all pairs, so the index is kept on sets of 8 - k
    positions: a pair meets in a posting exactly if its tally reaches the minimum. Within a posting only
    the k free bytes differ. There, instead of all pairs, each fingerprint is sent to the values within
    half the distance; fingerprints meeting at such a value are within k bits of each other, and every
    such pair meets, so stars at its least member connect the same. Rows grow in proportion to the
    fingerprints however many fall into one posting, and a posting has at most 256^k. The tally and the
    bit distance of each link are then verified.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4")
    full, near, far = (1 << 64) - 1, max_bits // 2, max_bits - max_bits // 2
    masks, flips = [], []
    for free in combinations(range(8), max_bits):
        masks.append(_signed(full & ~sum(0xFF << (8 * p) for p in free)))
        bits = [8 * p + b for p in free for b in range(8)]
        flips.append([_signed(sum(1 << b for b in chosen)) for r in range(far + 1) for chosen in combinations(bits, r)])
    posts = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for c, m in enumerate(masks)])
    index = distinct.select("fp", F.explode(posts).alias("p")).select("fp", "p.c", "p.shared")
    posting = Window.partitionBy("c", "shared")
    met = index.withColumns({"lo": F.min("fp").over(posting), "hi": F.max("fp").over(posting)}).where("lo <> hi")
    table = F.array(*[F.array(*[F.lit(f) for f in fs]) for fs in flips])
    probes = met.select("c", "shared", "fp", F.explode(F.element_at(table, F.col("c") + 1)).alias("flip"))
    probes = probes.withColumn("at", F.col("fp").bitwiseXOR(F.col("flip")))
    meeting = Window.partitionBy("c", "shared", "at")
    close = F.when(F.bit_count("flip") <= near, F.col("fp"))
    links = probes.withColumn("dst", F.min(close).over(meeting)).where("dst is not null and dst <> fp").select(F.col("fp").alias("src"), "dst").distinct()
    differing = F.col("src").bitwiseXOR(F.col("dst"))
    tally = sum(
        (F.when(differing.bitwiseAND(F.lit(_signed(0xFF << (8 * p)))) == 0, 1).otherwise(0) for p in range(8)), F.lit(0)
    )
    return links.where((tally >= 8 - max_bits) & (F.bit_count(differing) <= max_bits))


def _labelled(own: DataFrame, max_bits: int) -> DataFrame:
    """(fp, low, root) of every fingerprint of ``own`` (id, fp): its least id and the least fingerprint it is linked to."""
    least = own.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected(fingerprint_links(own.select("fp").distinct(), max_bits))
    labelled = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return stored(labelled, "labelled")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the least id reachable over links.

    Defined cases: null, empty and blank texts have fingerprint zero and link like any other; repeated
    rows stay; a null id keeps its row and never becomes a component_id unless its component has no
    other; other columns are not read; an empty table gives an empty table.

    Copies are one fingerprint before anything is linked, so a group of copies of any size adds one row.
    """
    own = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    labelled = _labelled(own, max_bits)
    groups = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    named = labelled.join(groups, "root").select("fp", "component_id")
    return own.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` per component, also where ids are null or repeated: that of the least id, nulls last, then of the least text hash.

    Rows are told apart by id, fingerprint and text hash; of rows alike in all three any one stays.
    """
    order = [F.col("id").isNull().alias("none"), "id", "text_hash", "fp"]
    text = F.xxhash64(F.col(text_col), F.col(text_col).isNull())
    keyed = docs.select(F.struct(id_col, text.alias("text_hash")).alias("_k"), text_col)
    own = fingerprints(keyed, "_k", text_col, shingle).select(F.col(f"id.{id_col}").alias("id"), "fp", "id.text_hash")
    own = stored(own, "fingerprints")
    labelled = _labelled(own, max_bits)
    # the least row of each fingerprint first, so that a group of copies meets its component as one row
    firsts = own.groupBy("fp").agg(F.min(F.struct(*order)).alias("first"))
    chosen = labelled.select("fp", "root").join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first"))
    # two components may choose alike in id and text hash only if two texts share a hash
    stay = chosen.select(F.col("first.id").alias("_sh_id"), F.col("first.text_hash").alias("_sh_hash")).distinct()
    kept = docs.join(stay, F.col(id_col).eqNullSafe(F.col("_sh_id")) & (text == F.col("_sh_hash")), "left_semi")
    return kept.withColumn("_sh_hash", text).dropDuplicates([id_col, "_sh_hash"]).drop("_sh_hash")

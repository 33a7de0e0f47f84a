"""Substring dedup: a count-min prefilter over all word windows, then exact grouping of windows estimated repeated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from waypoint.llm.common import filesystem, mix, track, word_hashes
from waypoint.session import scratch_path

#: Windows handled together in a task; bounds its memory.
CHUNK = 1_000_000
BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93))
ROWS = 2
BLOCK_BITS = 20


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def window_keys(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys for each window of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    own, keys = word_hashes(words), []
    with np.errstate(over="ignore"):
        for base in BASES:
            up = np.full(len(words), base, np.uint64)
            up[0] = 1
            down = np.full(n, _inverse(base), np.uint64)
            down[0] = 1
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * np.cumprod(up), dtype=np.uint64)])
            keys.append(mix((sums[size:] - sums[:n]) * np.cumprod(down)))
            own = mix(own + base)
    return keys[0], keys[1]


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + np.uint64(row * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(64 - bits)).astype(np.uint32)


class _Windows:
    """Gathers windows of texts into chunks of about CHUNK windows."""

    def __init__(self, size: int) -> None:
        self.size, self.count, self.parts = size, 0, []

    def add(self, raw: bytes | None, tag: int) -> None:
        words = (raw or b"").split()
        a, b = window_keys(words, self.size)
        if len(a):
            self.parts.append((a, b, tag))
            self.count += len(a)

    def take(self):
        """Keys, text tags and positions of what has been gathered."""
        parts, self.parts, self.count = self.parts, [], 0
        sizes = [len(a) for a, _, _ in parts]
        return (
            np.concatenate([a for a, _, _ in parts]),
            np.concatenate([b for _, b, _ in parts]),
            np.repeat([t for _, _, t in parts], sizes),
            np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
        )


def _packed(sorted_cells: np.ndarray, more: np.ndarray) -> bytes:
    """Gaps between cells and a bit for more than one, byte planes, compressed."""
    gaps = np.diff(sorted_cells, prepend=np.uint32(0)).astype(np.uint32) << np.uint32(1) | more.astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    gaps = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(gaps >> np.uint32(1), dtype=np.uint32), (gaps & np.uint32(1)).astype(np.uint8)


def sketch(docs: DataFrame, size: int, bits: int) -> str:
    """Count-min sketch of all windows: folder with, per row and block of 2^20 cells, a bit for counts over one.

    Counters stop at two, as only "more than once" is asked. Every task emits its counts by block, the
    cells it has touched only; blocks are merged as sorted streams, one block in memory at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Windows(size)

        def out() -> pa.RecordBatch:
            keys, *_ = found.take()
            r_, b_, data = [], [], []
            for r in range(ROWS):
                at, n = np.unique(cells(keys, r, bits), return_counts=True)
                block = at >> np.uint32(BLOCK_BITS)
                edges = np.flatnonzero(np.diff(block, prepend=np.uint32(0xFFFFFFFF)))
                for lo, hi in zip(edges, [*edges[1:], len(at)], strict=True):
                    r_.append(r)
                    b_.append(int(block[lo]))
                    data.append(_packed(at[lo:hi] & np.uint32((1 << BLOCK_BITS) - 1), n[lo:hi] > 1))
            return pa.RecordBatch.from_pydict({"r": pa.array(r_, pa.int32()), "b": pa.array(b_, pa.int32()), "data": pa.array(data, pa.binary())})

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                found.add(text.as_py(), 0)
                if found.count >= CHUNK:
                    yield out()
        if found.count:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"r": pa.array([now[0]], pa.int32()), "b": pa.array([now[1]], pa.int32()), "data": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())}
            )

        for batch in batches:
            for r, b, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (r, b) != now:
                    if now:
                        yield out()
                    now, counts = (r, b), np.zeros(1 << BLOCK_BITS, np.uint8)
                at, more = _unpacked(data)
                counts[at] = np.minimum(counts[at] + 1 + more, 2)
        if now:
            yield out()

    shape = "r int, b int, data binary"
    parts = docs.select("text").mapInArrow(scan, shape)
    path = track(scratch_path(docs.sparkSession, "sketch"))
    parts.repartition("r", "b").sortWithinPartitions("r", "b").mapInArrow(merge, shape).write.parquet(path)
    return path


_loaded: tuple[str, np.ndarray] | None = None


def _sketch_bits(path: str, bits: int) -> np.ndarray:
    """The merged sketch, kept by the worker while it serves the same sketch."""
    global _loaded
    if _loaded is None or _loaded[0] != path:
        _loaded = None
        fs, folder = filesystem(path)
        out = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
        width = 1 << (BLOCK_BITS - 3)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet")]
        for file in files:
            for batch in pq.ParquetFile(fs.open_input_file(file)).iter_batches(batch_size=16):
                for r, b, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    out[r, b * width : (b + 1) * width] = np.frombuffer(data, np.uint8)
        _loaded = path, out
    return _loaded[1]


def _estimated_repeated(keys: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    keep = np.arange(len(keys))
    for r in range(ROWS):
        at = cells(keys[keep], r, bits)
        bit = np.uint8(128) >> (at & np.uint32(7)).astype(np.uint8)
        keep = keep[(table[r][at >> np.uint32(3)] & bit) > 0]
    return keep


def repeated_windows(docs: DataFrame, size: int = 35, bits: int = 29) -> DataFrame:
    """(id, hash, pos, runs): positions of windows whose words also start elsewhere, and runs of such positions.

    The second pass meets each window estimated repeated once more. What repeats within a chunk of a
    task is known to repeat and stays there as runs of positions; other tasks learn of it from one row
    per key. So a key has one row per chunk at most, however many documents share it. These rows are
    shuffled once and counted by 96 bits of their keys. ``hash`` tells apart texts under one id.
    """
    path = sketch(docs, size, bits)
    kind = dict(docs.dtypes)["doc_id"]
    shape = f"k1 bigint, k2 int, id {kind}, at bigint, runs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, found, names = _sketch_bits(path, bits), _Windows(size), []

        def out(ids: pa.DataType) -> pa.RecordBatch:
            a, b, tag, pos = found.take()
            keep = _estimated_repeated(a, table, bits)
            a, b, tag, pos = a[keep], (b[keep] >> np.uint64(32)).astype(np.uint32), tag[keep], pos[keep]
            hashes = np.array([h for _, h in names], np.int64)
            order = np.lexsort((b, a))
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            group = np.cumsum(fresh) - 1
            several = np.bincount(group, minlength=1)[group] > 1
            many = np.empty(len(a), bool)
            many[order] = several
            heads, once, settled = order[fresh & several], np.flatnonzero(~many), np.flatnonzero(many)
            # runs of settled positions, in order of text and position
            cut = np.ones(len(settled), bool)
            cut[1:] = (tag[settled][1:] != tag[settled][:-1]) | (pos[settled][1:] != pos[settled][:-1] + 1)
            starts = np.flatnonzero(cut)
            first, last, owner = pos[settled[starts]], pos[settled[np.append(starts[1:], len(settled))[: len(starts)] - 1]], tag[settled[starts]]
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            runs = [np.stack([first[lo:hi], last[lo:hi]], 1).ravel() for lo, hi in zip(edges, [*edges[1:], len(owner)], strict=True)] if len(edges) else []
            owner = owner[edges]
            h, o, t = len(heads), len(once), len(runs)
            at = np.concatenate([np.zeros(h, np.int64), hashes[tag[once]] >> 32 << 32 | pos[once], hashes[owner] >> 32 << 32])
            # rows of runs need no partner: copies of a text go to different partitions
            spread = mix(hashes[owner].view(np.uint64) + np.arange(t, dtype=np.uint64)).view(np.int64)
            yes, no = np.ones, np.zeros
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a[heads].view(np.int64), a[once].view(np.int64), spread])),
                    pa.array(np.concatenate([b[heads].view(np.int32), b[once].view(np.int32), no(t, np.int32)]), mask=np.concatenate([no(h + o, bool), yes(t, bool)])),
                    pa.array([None] * h + [names[x][0] for x in np.concatenate([tag[once], owner])], ids),
                    pa.array(at, mask=np.concatenate([yes(h, bool), no(o + t, bool)])),
                    pa.array([None] * (h + o) + [r.tolist() for r in runs], pa.list_(pa.int32())),
                ],
                ["k1", "k2", "id", "at", "runs"],
            )

        for batch in batches:
            ids = batch.schema.field(0).type
            for k, text in enumerate(batch.column(2).cast(pa.binary())):
                names.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()))
                found.add(text.as_py(), len(names) - 1)
                if found.count >= CHUNK:
                    yield out(ids)
                    names = []
        if found.count:
            yield out(ids)

    source = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    same = Window.partitionBy("k1", "k2")
    told = F.col("at").isNull()  # repeats within a chunk
    rows = source.mapInArrow(run, shape).withColumn("n", F.sum(F.when(told, 2).otherwise(1)).over(same))
    return rows.where("runs is not null or (n > 1 and at is not null)").select(
        "id",
        F.shiftright("at", 32).alias("hash"),
        F.when(F.col("runs").isNull(), F.col("at").bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("pos"),
        "runs",
    )


KEPT = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])


def without_repeats(docs: DataFrame, size: int = 35, bits: int = 29) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (words that stay, joined by one space) of every row.

    Words are covered by windows of ``size`` consecutive words of one document whose sequence also starts
    anywhere else, the same document included; all windows are judged on the input. ``bits`` sizes the
    sketch (2^bits cells and bits in each of two rows, 128 MB for 29): beyond some hundred million
    windows more of them pass the prefilter needlessly, but none is lost.

    Defined cases: a null text has no words; texts under ``size`` words lose nothing; repeated rows repeat
    each other's windows; null ids are told apart by text; an empty table gives an empty table; other
    columns are not read.
    """

    @F.arrow_udf(KEPT)
    def cut(texts: pa.Array, positions: pa.Array, runs: pa.Array) -> pa.Array:
        n, gone, kept = [], [], []
        for text, pos, run in zip(texts.cast(pa.binary()), positions, runs, strict=True):
            words = (text.as_py() or b"").split()
            p = np.asarray(pos.values.to_numpy() if pos.is_valid else [], np.int64)
            r = np.asarray(run.values.to_numpy() if run.is_valid else [], np.int64).reshape(-1, 2)
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, np.concatenate([p, r[:, 0]]), 1)
            np.add.at(steps, np.concatenate([p, r[:, 1]]) + size, -1)
            stay = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
            n.append(len(words))
            gone.append(len(words) - len(stay))
            kept.append(b" ".join(words if len(stay) == len(words) else [words[k] for k in stay]).decode())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], KEPT.names)

    places = repeated_windows(docs, size, bits).groupBy("id", "hash").agg(
        F.collect_list("pos").alias("pos"), F.flatten(F.collect_list("runs")).alias("runs")
    )
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.shiftright(F.xxhash64("text"), 32).alias("_hash"))
    joined = own.join(places, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")), "left")
    out = joined.select("doc_id", cut("text", "pos", "runs").alias("c"))
    return out.select("doc_id", "c.n_words", "c.n_removed", F.col("c.kept").alias("kept_text"))


SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
),
s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM w WHERE len(words) >= 35
),
k AS (SELECT doc_id, p, sha256(list_aggregate(words[p:p + 34], 'string_agg', ' ')) AS h FROM s),
r AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM k WHERE h IN (SELECT h FROM r)
),
g AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(list_aggregate(
         CASE WHEN g.gone IS NULL THEN w.words
              ELSE list_transform(list_filter(range(1, len(w.words) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: w.words[i]) END,
         'string_agg', ' '), '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""


def report(docs: DataFrame, size: int = 35) -> DataFrame:
    out = without_repeats(docs, size)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

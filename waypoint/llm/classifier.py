"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypoint.llm.common import mix, stored

#: Letters, digits, or other signs standing together; signs at the end of a word are a word of their own.
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Words whose hashes a worker keeps at most.
CACHE = 1 << 19
#: Parts of the state that are added up apart.
PARTS = 16
_C = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


@dataclass(frozen=True)
class Training:
    """``max_rows`` bounds the labelled rows learned from; more are sampled by a hash of their ids."""

    max_rows: int = 20_000
    bits: int = 18
    orders: int = 2
    shards: int = 8
    epochs: int = 3
    alpha: float = 50.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.0
    folds: int = 5


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def features(text: str | None, orders: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the word n-grams of a whole text, ascending, and their values (1 + log count, scaled to length 1).

    Slot 0 is always on; slot 1 stands for any word said twice in a row.
    """
    words = WORD.findall(text or "")
    h = mix(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
    shift = np.uint64(64 - bits)
    grams, found = h, [np.zeros(1, np.uint64), h >> shift]
    if len(h) > 1:
        found.append(np.ones(int((h[1:] == h[:-1]).sum()), np.uint64))
    for n in range(1, orders):
        if len(h) <= n:
            break
        grams = mix(grams[:-1] * _C[0] + (h[n:] ^ (h[n:] >> np.uint64(31))) * _C[1] + _C[2])
        found.append(grams >> shift)
    slots, count = np.unique(np.concatenate(found).astype(np.int32), return_counts=True)
    values = 1 + np.log(count)
    return slots, (values / np.sqrt(values @ values)).astype(np.float32)


def _weight(z: np.ndarray, n: np.ndarray, t: Training) -> np.ndarray:
    w = -(z - np.sign(z) * t.l1) / ((t.beta + np.sqrt(n)) / t.alpha + t.l2)
    return np.where(np.abs(z) <= t.l1, 0.0, w)


def _probability(x: float) -> float:
    return float(1 / (1 + np.exp(-x))) if x >= 0 else float(np.exp(x) / (1 + np.exp(x)))


def follow_leader(state: np.ndarray, slots: np.ndarray, values: np.ndarray, label: float, t: Training) -> float:
    """One update of (z, n) in place by one example; returns the score from before."""
    z, n, values = state[0, slots], state[1, slots], values.astype(np.float64)
    w = _weight(z, n, t)
    p = _probability(float(w @ values))
    g = (p - label) * values
    sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / t.alpha
    state[0, slots] = z + g - sigma * w
    state[1, slots] = n + g * g
    return p


def bucket_of(doc_id: Column, folds: int) -> Column:
    """Unsigned CRC-32 of the decimal id, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, t: Training, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most ``max_rows`` ids with their labels, none of the held-out fold; the same ones on every run.

    Where an id has several labels their mean decides, halves count as 1. Counting comes first, so
    that only ids below a hash limit are sorted, about a tenth more than wanted.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & (bucket_of(F.col(id_col), t.folds) != 0))
        .groupBy(F.col(id_col).alias("_k_id"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("_k_label"))
        .withColumn("_k_order", F.shiftrightunsigned(F.xxhash64("_k_id"), 1))
    )
    total = known.count()
    if total > t.max_rows:
        limit = min(2**63 - 1, int((1.1 * t.max_rows + 1000) / total * 2**63))
        known = known.where(F.col("_k_order") <= limit).orderBy("_k_order", "_k_id").limit(t.max_rows)
    return stored(known, "labelled")


def _examples(t: Training):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                found = [features(x.as_py(), t.orders, t.bits) for x in some.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("shard"),
                        some.column("turn"),
                        some.column("label"),
                        pa.array([slots for slots, _ in found], pa.list_(pa.int32())),
                        pa.array([values for _, values in found], pa.list_(pa.float32())),
                    ],
                    ["shard", "turn", "label", "slots", "shares"],
                )

    return run


def _epoch(t: Training, state):
    """Task side: each shard, its rows in their order, from the common state; gives the state it ends with, in parts."""

    def end(shard: int, own: np.ndarray, rows: int) -> pa.RecordBatch:
        parts = np.split(own, PARTS, axis=1)
        return pa.RecordBatch.from_pydict(
            {"shard": [shard] * PARTS, "part": list(range(PARTS)), "rows": [rows] * PARTS, "state": [np.ascontiguousarray(p).tobytes() for p in parts]},
            schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("rows", pa.int64()), ("state", pa.binary())]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, rows = None, None, 0
        for batch in batches:
            slots, values = (batch.column(c).flatten().to_numpy() for c in ("slots", "shares"))
            ends = np.cumsum(batch.column("slots").value_lengths().to_numpy())
            begin = 0
            for s, label, stop in zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist(), ends.tolist(), strict=True):
                if s != shard:
                    if own is not None:
                        yield end(shard, own, rows)
                    shard, own, rows = s, state.value.copy(), 0
                follow_leader(own, slots[begin:stop], values[begin:stop], label, t)
                begin, rows = stop, rows + 1
        if own is not None:
            yield end(shard, own, rows)

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of the shards of each part, in the order of the shards, weighted by their rows."""
    for batch in batches:
        out = []
        for part in batch.column("found").to_pylist():
            total = sum(x["rows"] for x in part)
            out.append(sum(np.frombuffer(x["state"]) * (x["rows"] / total) for x in part).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out, pa.binary())], ["part", "state"])


def train(docs: DataFrame, labels: DataFrame, t: Training = Training(), text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> np.ndarray:
    """Weights of all slots, learned from the labelled rows outside the held-out fold.

    Labels are sampled by id first and broadcast to the documents (at most ``max_rows`` ids), so no
    text is moved. Each epoch every shard follows the leader over its rows from the common state, one row
    after the other, and the states are averaged, part by part. Shards and orders come from hashes of the ids, so the weights
    do not depend on partitioning or retries; what reaches the driver is the state, ``2 ** (bits + 4)``
    bytes at any size.
    """
    spark = docs.sparkSession
    known = F.broadcast(labelled_sample(labels, t, id_col, label_col))
    turn = F.xxhash64("_k_order", "_k_text")
    rows = (
        docs.select(F.col(id_col).alias("_k_doc"), F.col(text_col).cast("string").alias("_k_text"))
        .join(known, F.col("_k_doc") == F.col("_k_id"))
        .select(F.pmod(F.shiftright(turn, 8), F.lit(t.shards)).cast("int").alias("shard"), turn.alias("turn"), F.col("_k_label").alias("label"), F.col("_k_text").alias("text"))
    )
    shape = "shard int, turn long, label double, slots array<int>, shares array<float>"
    examples = stored(rows.mapInArrow(_examples(t), shape), "examples")
    state = np.zeros((2, 1 << t.bits))
    for _ in range(t.epochs):
        shared = spark.sparkContext.broadcast(state)
        dealt = examples.repartition(t.shards, "shard").sortWithinPartitions("shard", "turn")
        ends = dealt.mapInArrow(_epoch(t, shared), "shard int, part int, rows long, state binary")
        parts = ends.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("shard", "rows", "state"))).alias("found"))
        got = {r["part"]: np.frombuffer(r["state"]).reshape(2, -1) for r in parts.mapInArrow(_mixed, "part int, state binary").toLocalIterator()}
        shared.unpersist()
        if not got:  # no labelled row at all
            break
        state = np.concatenate([got[k] for k in range(PARTS)], axis=1)
    return _weight(state[0], state[1], t)


def scored(docs: DataFrame, weights: np.ndarray, t: Training = Training(), text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of label 1 of every whole text as ``name``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w, out = shared.value, []
        for x in texts:
            slots, values = features(x.as_py(), t.orders, t.bits)
            out.append(_probability(float(w[slots] @ values)))
        return pa.array(out, pa.float64())

    return docs.withColumn(name, score(F.col(text_col).cast("string")))


def report(docs: DataFrame, labels: DataFrame, t: Training = Training(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from ``threshold`` on).

    Nothing but the text enters a score. At most ``Training.max_rows`` labelled rows are learned from,
    none of the held-out fold.

    Defined cases: null and empty texts have the bias as their only feature; a null id is not held out
    and has no label; rows with the same id are scored apart and learned from each; null labels do not
    count; without any label every score is 0.5; an empty table gives an empty table. Texts are read
    whole. Only doc_id and text, and doc_id and quality of the labels, are read, others may have any name.
    """
    weights = train(docs, labels, t)
    out = scored(docs.select("doc_id", "text"), weights, t)
    held = F.coalesce(bucket_of(F.col("doc_id"), t.folds) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

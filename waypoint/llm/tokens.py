"""Token counts by a two-tier map-side lookup: frequent pre-tokens from a broadcast table, others cached per worker."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a partition's summary and of the broadcast table; pre-tokens of at most this many bytes.
TABLE_SIZE = 8192
MAX_BYTES = 48
#: Pre-tokens a worker remembers before it starts anew.
CACHE_SIZE = 400_000
FAN_IN = 32


def _pruned(counts: Counter, size: int) -> Counter:
    """Misra-Gries step: subtract the (size + 1)-th largest count from all and keep what stays positive."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def _summary(counts: Counter, size: int) -> pa.RecordBatch:
    top = sorted(_pruned(counts, size).items(), key=lambda x: (-x[1], x[0]))
    return pa.RecordBatch.from_pydict(
        {"words": pa.array([[w for w, _ in top]], pa.list_(pa.binary())), "counts": pa.array([[n for _, n in top]], pa.list_(pa.int64()))}
    )


def frequent_pretokens(docs: DataFrame, text_col: str = "text", size: int = TABLE_SIZE) -> list[bytes]:
    """At most ``size`` pre-tokens, among them every one that makes up over 1/size of all occurrences.

    Each partition of the whole corpus gives one Misra-Gries summary of at most ``size`` entries; the
    summaries are merged in a tree of fan-in 32. No pre-token occurrence is ever shuffled, and what
    reaches the driver is one summary.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                if text.is_valid:
                    counts.update(w for w in text.as_py().split() if len(w) <= MAX_BYTES)
                if len(counts) > 16 * size:
                    counts = _pruned(counts, size)
        yield _summary(counts, size)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for words, ns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in zip(words, ns, strict=True):
                    counts[w] += n
        yield _summary(counts, size)

    shape = "words array<binary>, counts array<bigint>"
    level = docs.select(text_col).mapInArrow(scan, shape)
    n = docs.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN_IN)
        level = level.repartition(n).mapInArrow(merge, shape)
    total: Counter = Counter()
    for row in level.collect():
        for w, c in zip(row[0], row[1], strict=True):
            total[bytes(w)] += c
    return [w for w, _ in total.most_common(size)]


def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def lengths(words: list[bytes]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]

    return lengths


def count_tokens(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 2048, table_size: int = TABLE_SIZE
) -> DataFrame:
    """The columns of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` in place of the text.

    A pre-token here is a run of bytes other than the six ASCII white space characters. The tokenizer
    must not form a token across such white space, as is so for one that splits at and drops it; then
    a text has the tokens of its runs. The lengths of frequent runs come from the broadcast table (at most
    ``table_size`` entries of at most 48 bytes), those of others from a cache per worker that the library
    fills, so every length is the library's own. Special strings never hold white space, so they are
    found within their run just as in the whole text.

    Defined cases: a null text is empty; empty texts have 0 tokens; repeated rows are each counted; an
    empty table gives an empty table; columns already called like the new ones are replaced.
    """
    common = frequent_pretokens(docs, text_col, table_size)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(common, _encoder(tokenizer_path)(common), strict=True)))
    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    source = docs.select(*rest, F.col(text_col).alias("_tk_text"))
    shape = ", ".join([f"`{c}` {t}" for c, t in source.dtypes[:-1]] + ["n_bytes bigint", "n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _encoder(tokenizer_path), dict(table.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()):
                raw = text.as_py() or b""
                words = raw.split()
                missed = list(set(words).difference(known))
                if missed:
                    if len(known) > CACHE_SIZE:
                        known = dict(table.value)
                        missed = list(set(words).difference(known))
                    known.update(zip(missed, encode(missed), strict=True))
                n_bytes.append(len(raw))
                n_tokens.append(sum(map(known.__getitem__, words)))
                for w in missed:  # giant runs would make the cache large
                    if len(w) > 1024:
                        del known[w]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], [*rest, "n_bytes", "n_tokens"]
            )

    return source.mapInArrow(run, shape).withColumn("over_limit", F.col("n_tokens") > limit)

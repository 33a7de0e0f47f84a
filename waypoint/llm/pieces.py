"""SentencePiece encoding and decoding over a relational lattice of words."""

from __future__ import annotations

import contextlib
import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from waypoint.llm.common import filesystem, holding, lean, track
from waypoint.session import scratch_path

MARK = "▁"
#: Code points of a word whose cuts fit a long; rows of a dictionary that workers may hold (some 20 bytes each).
MAX_WORD, MAX_ROWS = 61, 16_000_000
CACHE_SIZE = 100_000
#: Bytes of texts whose words a worker looks up together.
LOOKUP = 1 << 20
#: Words that a task groups edges of in memory, some 700 bytes each, before it sorts instead.
GROUPED = "100000"


@dataclass
class Pieces:
    """What a model holds: ids of pieces, the order in which merges count, ids of bytes, surfaces of ids."""

    ids: dict[str, int]
    ranks: dict[str, int]
    byte_ids: list[int]
    surfaces: list[bytes]
    longest: int
    #: A line feed is in no piece, so it can part words.
    breaks: bool

    @property
    def kind(self) -> np.dtype:
        """What holds an id inside tasks."""
        return np.dtype("<u2" if len(self.surfaces) <= 1 << 16 else "<i4")

    def word_pattern(self) -> str:
        return f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if self.breaks else f"{MARK}*[^{MARK}]+|{MARK}+"


def load_pieces(path: str) -> Pieces:
    """Read a BPE model with byte fallback, identity normalisation and a dummy prefix; others are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
        raise ValueError("only BPE with byte fallback, identity normalisation and a dummy prefix")
    normal = {p.piece: (k, p.score) for k, p in enumerate(model.pieces) if p.type == 1}
    order = {s: k for k, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
    ranks = {p: order[s] for p, (_, s) in normal.items() if len(p) > 1}
    for p in normal:
        if MARK in p.lstrip(MARK):
            raise ValueError(f"piece {p!r} spans words")
    byte_ids, surfaces = [0] * 256, []
    for k, p in enumerate(model.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = k
            surfaces.append(bytes([int(p.piece[3:5], 16)]))
        else:
            surfaces.append(p.piece.replace(MARK, " ").encode() if p.type == 1 else b"")
    return Pieces({p: k for p, (k, _) in normal.items()}, ranks, byte_ids, surfaces, max(map(len, ranks)), not any("\n" in p for p in normal))


def late_parts(pieces: Pieces) -> set[str]:
    """Pieces that can be put together from a part that counts later than they do.

    One fold over a word's edges in merge order gives what merging the best adjacent pair again and again
    gives, unless an edge becomes possible after its turn; only the edges of these pieces can.
    """
    out = set()
    for p, rank in pieces.ranks.items():
        for k in range(1, len(p)):
            a, b = p[:k], p[k:]
            if all(len(x) == 1 or x in pieces.ranks for x in (a, b)) and max(pieces.ranks.get(a, -1), pieces.ranks.get(b, -1)) > rank:
                out.add(p)
    return out


def merge_word(word: str, pieces: Pieces) -> list[int]:
    """Cuts of one word of any length by merging the best adjacent pair, leftmost first, until none is left."""
    n, rank_of = len(word), pieces.ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n))  # by start of a token; of the token ending here
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int, b: int, c: int) -> None:
        if 0 <= a and c <= n and (rank := rank_of(word[a:c])) is not None:
            heapq.heappush(heap, (rank, a, b, c))

    for k in range(n - 1):
        offer(k, k + 1, k + 2)
    alive = [True] * n
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if alive[a] and b < n and alive[b] and end[a] == b and end[b] == c:
            end[a], alive[b], before[c] = c, False, a
            if a:
                offer(before[a], a, c)
            if c < n:
                offer(a, c, end[c])
    return [k for k in range(n) if alive[k]] + [n]


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _lengths(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(head, lengths) by the first three code points of the pieces of three or more."""
    lengths: dict[str, set[int]] = {}
    for p in pieces.ranks:
        if len(p) > 2:
            lengths.setdefault(p[:3], set()).add(len(p))
    return F.broadcast(words.sparkSession.createDataFrame([(h, sorted(x)) for h, x in sorted(lengths.items())], "head string, lengths array<int>"))


def word_cuts(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, uses, cuts) for the distinct words (columns word, at most 61 code points, and uses) that hold a piece of two or more.

    Substrings of two code points, and longer ones of the lengths that pieces with the same first three have,
    are exploded and equi-joined to the piece table (as many rows as the model has pieces, so it is broadcast,
    like the lengths). Edges are grouped by word, in the partitioning
    that made the words distinct, as one number each, and folded in merge order by a higher-order aggregate: an edge between
    two present cuts with exactly one cut between removes that one. Bit k of ``cuts`` is a cut before
    code point k. Where an edge has become possible after its turn, so that one fold may not do,
    ``cuts`` is null; such words are rare, and workers merge them one pair at a time.
    """
    spark, late = words.sparkSession, late_parts(pieces)
    table = F.broadcast(spark.createDataFrame([(p, r, p in late) for p, r in sorted(pieces.ranks.items())], "piece string, rank int, late boolean"))
    n = F.char_length("word")
    starts = words.where(n >= 2).select("word", "uses", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 2)).alias("s"))
    starts = starts.withColumn("head", F.substring("word", F.col("s") + 1, F.lit(3))).join(_lengths(words, pieces), "head", "left")
    lengths = F.concat(F.array(F.lit(2)), F.coalesce("lengths", F.array().cast("array<int>")))
    spans = starts.select("word", "uses", "n", "s", F.explode(lengths).alias("l")).where(F.col("s") + F.col("l") <= F.col("n"))
    spans = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("l")))
    # an edge as one number, in merge order, then from the left: rank, start, length, whether it can be late
    packed = ((F.col("rank").cast("long") * 64 + F.col("s")) * 64 + F.col("l")) * 2 + F.col("late").cast("int")
    edges = spans.join(table, "piece").select("word", "uses", packed.alias("e"))
    grouped = edges.groupBy("word", "uses").agg(F.sort_array(F.collect_list("e")).alias("packed"))

    def unpacked(e: Column) -> Column:
        s = F.shiftright(e, 7).bitwiseAND(F.lit(63)).cast("int")
        end = s + F.shiftright(e, 1).bitwiseAND(F.lit(63)).cast("int")
        return F.struct(
            F.shiftright(e, 13).alias("rank"),
            _bit(s).bitwiseOR(_bit(end)).alias("ends"),
            (_bit(end) - _bit(s + 1)).alias("inner"),
            (e % 2 == 1).alias("late"),
        )

    grouped = grouped.select("word", "uses", n.alias("n"), F.transform("packed", unpacked).alias("edges"))

    def possible(cuts: Column, e: Column) -> Column:
        return (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)

    def fold(state: Column, e: Column) -> Column:
        cuts = state["cuts"].bitwiseAND(F.bitwise_not(e["inner"]))
        missed = F.exists("late", lambda x: (x["rank"] < e["rank"]) & possible(cuts, x))
        return F.when(possible(state["cuts"], e), F.struct(cuts.alias("cuts"), (state["missed"] | missed).alias("missed"))).otherwise(state)

    start = F.struct((_bit(F.col("n") + 1) - 1).alias("cuts"), F.lit(False).alias("missed"))
    grouped = grouped.withColumn("late", F.filter("edges", lambda x: x["late"]))
    folded = grouped.select("word", "uses", F.aggregate("edges", start, fold).alias("state"))
    return folded.select("word", "uses", F.when(~F.col("state.missed"), F.col("state.cuts")).alias("cuts"))


def distinct_words(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """(word, uses): distinct words of all texts, at most 61 code points, and how often they occur.

    A word is what ``Pieces.word_pattern`` finds: marks (for the spaces before) and what follows up to the next
    space or line feed. Lines with single spaces between words are split there, only others meet the pattern.
    The first line begins with a mark, later ones do not.
    """
    lines = docs.select(F.posexplode(F.split(text_col, "\n")).alias("line", "words")) if pieces.breaks else docs.select(F.lit(0).alias("line"), F.col(text_col).alias("words"))
    text = F.col("words")
    odd = text.contains("  ") | text.startswith(" ") | text.endswith(" ") | text.contains(MARK)
    marked = F.concat(F.when(F.col("line") == 0, F.lit(MARK)).otherwise(F.lit("")), F.translate(text, " ", MARK))
    found = F.regexp_extract_all(marked, F.lit(pieces.word_pattern()), F.lit(0))
    # what the pattern finds has its marks already; nothing of a line but its number is kept beside its words
    words = lines.select("line", F.posexplode(F.when(odd, found).otherwise(F.split(text, " "))).alias("at", "w"))
    whole = F.col("w").startswith(MARK) | ((F.col("line") > 0) & (F.col("at") == 0))
    all_words = words.where("w <> ''").select(F.when(whole, F.col("w")).otherwise(F.concat(F.lit(MARK), "w")).alias("word"))
    # counted by the word alone: the edges of a word are grouped later in the same partitioning
    return all_words.where(F.char_length("word").between(2, MAX_WORD)).groupBy("word").agg(F.count("*").alias("uses"))


@dataclass
class Dictionary:
    """Ids of words by the hash of the word: ``size`` bytes of ``ids`` from ``start`` on."""

    keys: np.ndarray
    start: np.ndarray
    size: np.ndarray
    ids: bytes

    def find(self, words: list[str]) -> list[bytes | None]:
        if not len(self.keys):
            return [None] * len(words)
        own = np.fromiter(map(xxhash.xxh64_intdigest, [w.encode() for w in words], repeat(42)), np.uint64, len(words))
        order = np.argsort(own)  # neighbouring searches touch neighbouring memory
        own = own[order]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        start, ends = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        start[order] = self.start[at]
        ends[order] = np.where(self.keys[at] == own, self.start[at] + self.size[at], -1)
        ids = self.ids
        return [ids[a:b] if b >= 0 else None for a, b in zip(start.tolist(), ends.tolist(), strict=True)]


@dataclass
class Cuts:
    """A written dictionary, and how many binary digits the uses of a word have at least that workers read; 1 is all."""

    path: str
    least: int


def _dictionary(path: str, least: int) -> Dictionary:
    """Words whose uses have at least ``least`` binary digits, kept by the worker while it serves the same dictionary."""

    def load() -> Dictionary:
        fs, folder = filesystem(path)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet")]
        keys, sizes, ids = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)], []
        for f in files:
            for batch in pq.ParquetFile(fs.open_input_file(f)).iter_batches(columns=["key", "digits", "ids"]):
                if least > 1:
                    batch = batch.filter(pc.greater_equal(batch.column("digits"), least))
                keys.append(batch.column("key").to_numpy().view(np.uint64))
                sizes.append(pc.binary_length(batch.column("ids")).to_numpy().astype(np.uint16))
                ids.append(b"".join(batch.column("ids").to_pylist()))
        key, size = np.concatenate(keys), np.concatenate(sizes)
        del keys, sizes
        start = np.cumsum(size, dtype=np.int64) - size
        order = np.argsort(key)
        return Dictionary(key[order], start[order], size[order], b"".join(ids))

    return holding((path, least), load)


class Encoder:
    """Ids of texts inside a task: words by the dictionary, or by merging where there is none."""

    def __init__(self, pieces: Pieces, cuts: Cuts | None = None) -> None:
        self.pieces, self.find = pieces, re.compile(pieces.word_pattern()).findall
        self.table = _dictionary(cuts.path, cuts.least) if cuts else None
        self.complete = cuts is not None and cuts.least == 1
        self.kind = pieces.kind
        self.one = [k.to_bytes(self.kind.itemsize, "little") for k in range(len(pieces.surfaces))]
        self.known = {p: self.one[k] for p, k in pieces.ids.items()}
        self.plain: dict[str, bytes] = {}  # by word
        self.spaced: dict[str, bytes] = {}  # by what follows a mark
        self.line_feed = self.packed("\n", [0, 1])

    def fallback(self, part: str) -> bytes:
        """The ids of what is no piece: its bytes."""
        return b"".join([self.one[self.pieces.byte_ids[x]] for x in part.encode()])

    def packed(self, word: str, cuts: list[int]) -> bytes:
        """The ids between cuts."""
        known, fallback = self.known.get, self.fallback
        return b"".join([known(p) or fallback(p) for p in [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]])

    def merged(self, word: str) -> bytes:
        return self.packed(word, merge_word(word, self.pieces))

    def of_bits(self, word: str, bits: int) -> bytes:
        """The ids between the cuts that are the bits of a number."""
        return self.packed(word, [k for k, x in enumerate(bin(bits)[:1:-1]) if x == "1"])

    def ids_of(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words; those of up to 61 code points that a complete dictionary does not hold have no merges, others are merged here."""
        single, fallback = self.known.get, self.fallback
        for w, held in zip(words, self.table.find(words) if self.table else repeat(None), strict=False):
            if held is not None:
                yield held
            elif self.complete and len(w) <= MAX_WORD:
                yield b"".join([single(x) or fallback(x) for x in w])
            else:
                yield self.merged(w)

    def learn(self, cache: dict[str, bytes], mark: str, missed: set[str]) -> None:
        words = list(missed)
        cache.update(zip(words, self.ids_of([mark + w for w in words]), strict=True))

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; the words of all that are not known yet are looked up together."""
        split_texts, spaced, plain = [], set(), set()
        for text in texts:
            lines = (text.split("\n") if self.pieces.breaks else [text]) if text else []
            split = []
            for k, line in enumerate(lines):
                words = line.split(" ")
                odd = MARK in line or ("" in words and (len(words) > 1 or not k))
                if odd:  # several spaces, at an end, or marks: the words come with their marks
                    words = self.find(("" if k else MARK) + line.replace(" ", MARK))
                    plain.update(words)
                else:
                    spaced.update(words[1:] if k else words)
                    if k and words[0]:
                        plain.add(words[0])
                split.append((odd, words))
            split_texts.append(split)
        if len(self.spaced) + len(self.plain) > CACHE_SIZE:
            self.spaced, self.plain = {}, {}
        if missed := spaced.difference(self.spaced):
            self.learn(self.spaced, MARK, missed)
        if missed := plain.difference(self.plain):
            self.learn(self.plain, "", missed)
        by_rest, by_word = self.spaced.__getitem__, self.plain.__getitem__
        for split in split_texts:
            out = []
            for k, (odd, words) in enumerate(split):
                if k:
                    out.append(self.line_feed)
                if odd:
                    out.extend(map(by_word, words))
                elif not k:
                    out.extend(map(by_rest, words))
                else:
                    if words[0]:
                        out.append(by_word(words[0]))
                    out.extend(map(by_rest, words[1:]))
            yield np.frombuffer(b"".join(out), self.kind).astype(np.int32)


class Decoder:
    """Text of ids: surfaces joined, marks as spaces, the dummy prefix taken off, invalid bytes as U+FFFD."""

    def __init__(self, pieces: Pieces) -> None:
        self.sizes = np.array([len(x) for x in pieces.surfaces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces.surfaces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)
        raw = self.bytes[places].tobytes()
        raw = raw[1:] if raw[:1] == b" " else raw
        return raw.decode("utf-8", "replace").encode() if len(ids) else raw


def _parts(batch: pa.RecordBatch, column: str, most: int = LOOKUP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most about ``most`` bytes of a column, so that what is made of them stays small."""
    sizes = pc.coalesce(pc.binary_length(batch.column(column)), 0).to_pylist()
    lo, total = 0, 0
    for k, n in enumerate(sizes):
        if k > lo and total + n > most:
            yield batch.slice(lo, k - lo)
            lo, total = k, 0
        total += n
    yield batch.slice(lo)


@contextlib.contextmanager
def _conf(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_dictionary(docs: DataFrame, pieces: Pieces, text_col: str = "text", max_rows: int = MAX_ROWS) -> Cuts | None:
    """Ids of all distinct words, in a folder; workers read at most ``max_rows`` of them, those used most.

    Words are cut by the lattice, once each, and their ids written down. Where they are too many, the number
    of binary digits of their uses says which are left out; nothing but 64 such counts reaches the driver.
    """
    path = track(scratch_path(docs.sparkSession, "cuts"))
    cuts = word_cuts(distinct_words(docs, pieces, text_col), pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for batch in batches:
            pairs = zip(batch.column("word").to_pylist(), batch.column("cuts").to_pylist(), strict=True)
            ids = pa.array([encoder.of_bits(w, c) if c else encoder.merged(w) for w, c in pairs], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("digits"), ids], ["key", "digits", "ids"])

    digits = F.char_length(F.bin("uses")).cast("int")
    rows = cuts.select(F.xxhash64("word").alias("key"), digits.alias("digits"), "word", "cuts")
    with _conf(docs.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", GROUPED):
        rows.mapInArrow(lean(run), "key bigint, digits int, ids binary").write.parquet(path)
    held, least = 0, 64
    for digits, n in sorted(map(tuple, docs.sparkSession.read.parquet(path).groupBy("digits").count().collect()), reverse=True):
        if held + n > max_rows:
            break
        held, least = held + n, digits
    else:
        least = 1
    return Cuts(path, least) if held or least == 1 else None


def encode(docs: DataFrame, model_path: str, text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """The columns of ``docs`` and ``ids``, the model's piece ids of the text (a column so named is replaced).

    The ids are those of the public library for the model. The distinct words of the corpus are cut by the
    relational lattice of ``word_cuts`` and their ids written to the shared folder, some 20 bytes a word.
    Every worker reads at most ``max_rows`` of them, those used most, so texts are never shuffled; rarer
    words and those of over 61 code points are merged by the workers. Both give the same ids.

    Defined cases: null and empty texts have no ids; repeated rows are each encoded; an empty table gives
    an empty table; white space other than the space is text like any other.
    """
    pieces = load_pieces(model_path)
    cuts = cut_dictionary(docs, pieces, text_col, max_rows)
    source = docs.drop("ids")
    shape = StructType([*source.schema.fields, StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, cuts)
        for batch in batches:
            for part in _parts(batch, text_col):
                own = list(encoder.encode_all(part.column(text_col).to_pylist()))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return source.mapInArrow(lean(run), shape)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of the ids; null ids are no ids, which is the empty text."""
    pieces = load_pieces(model_path)

    @F.arrow_udf("string")
    def text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(pieces)
        for lists in columns:
            yield pa.array([decoder.decode(x.values.to_numpy(zero_copy_only=False)).decode() if x.is_valid else "" for x in lists], pa.string())

    return encoded.withColumn(to, text(ids_col))


REPORT = "n_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def report(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, SHA-256 of the ids (32-bit little-endian) and of the decoded text, and whether it equals the text.

    Encodes and decodes in one pass, so ids stay in the task.
    """
    pieces = load_pieces(model_path)
    cuts = cut_dictionary(docs, pieces)
    source = docs.select("doc_id", "text")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(pieces, cuts), Decoder(pieces)
        for batch in batches:
            rows = []
            for part in _parts(batch, "text"):
                texts = part.column("text").to_pylist()
                for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
                    back = decoder.decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == (text or "").encode()))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    return source.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {REPORT}")

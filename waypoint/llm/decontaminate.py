"""Benchmark decontamination: CGK embedding of item-sized windows with bit-sampling LSH, undisturbed segments for all that it misses, exact edit distances."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from waypoint.llm.common import lean, mix, word_hashes

#: Characters that words are compared without, besides the case of A-Z.
PUNCTUATION = b".,;:!?\"()[]{}#*$%&|<>"
#: Sampled symbols per hash, walks, hashes per walk; see ``expected_recall``.
SAMPLES, WALKS, HASHES = 4, 6, 2
#: Most words of a segment, and cells of a table of edit distances.
SEGMENT, CELLS = 6, 1 << 21
#: Items per pass over the documents, and words of documents handled together.
BLOCK, GROUP_WORDS = 20_000, 65_536


def normal_words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().translate(None, PUNCTUATION).split()


def _symbols(words: list[bytes]) -> np.ndarray:
    h = word_hashes(words)
    h[h == 0] = 1  # 0 marks the end of a text
    return h


def _coins(symbols: np.ndarray, seed: int, walk: int, block: int) -> np.ndarray:
    """64 random bits per symbol: whether steps 64 * block and on of the walk advance. The end never does."""
    with np.errstate(over="ignore"):
        out = mix(symbols + np.uint64((seed * 1_000_003 + walk * 8191 + block) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    out[symbols == 0] = 0
    return out


class Walk:
    """A CGK walk over a buffer of texts that end in the symbol 0: the embedding's j-th symbol is that at the walk's place."""

    def __init__(self, symbols: np.ndarray, seed: int, walk: int) -> None:
        self.symbols, self.seed, self.walk = symbols, seed, walk
        self.blocks: dict[int, np.ndarray] = {}

    def go(self, at: np.ndarray, step: int, until: int) -> np.ndarray:
        for j in range(step, until):
            b = j // 64
            if b not in self.blocks:
                self.blocks[b] = _coins(self.symbols, self.seed, self.walk, b)
            at = at + ((self.blocks[b][at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        return at


@dataclass
class Items:
    """Benchmark items prepared for the search."""

    words: list[np.ndarray]
    max_edits: list[int]
    seed: int
    vocabulary: np.ndarray
    #: (walk, hash, class) -> (sampled steps, tables of key prefixes, key -> items)
    hashes: dict = field(default_factory=dict)
    #: words of a segment -> (keys, where each key's entries begin, their items, their places in the item)
    segments: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        """0 for words of no item, 1 for the end of a text, from 2 on for words of items."""
        at = np.minimum(np.searchsorted(self.vocabulary, symbols), len(self.vocabulary) - 1)
        return np.where(symbols == 0, 1, np.where(self.vocabulary[at] == symbols, at + 2, 0))


def _joined(key: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key * np.uint64(0xD6E8FEB86659FD93) + v.astype(np.uint64))


def _segments(items: Items) -> dict[int, tuple[np.ndarray, ...]]:
    """Each item in one part more than it may have edits, so that one part at least stays as it is; of each its first words."""
    rows: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = defaultdict(list)
    for k, w in enumerate(items.words):
        if n := len(w):
            parts = min(items.max_edits[k], n - 1) + 1
            q, places, ids = min(n // parts, SEGMENT), np.arange(parts) * n // parts, items.ids(w)
            rows[q].append((ids[places[:, None] + np.arange(q)], k, places))
    out = {}
    for q, own in rows.items():
        key = _keys(np.concatenate([x for x, _, _ in own]))
        order = np.argsort(key, kind="stable")
        keys, begin = np.unique(key[order], return_index=True)
        of = np.concatenate([np.full(len(p), k, np.int32) for _, k, p in own])[order]
        out[q] = (keys, np.append(begin, len(order)), of, np.concatenate([p for _, _, p in own]).astype(np.int32)[order])
    return out


def _keys(ids: np.ndarray) -> np.ndarray:
    key = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        key = _joined(key, ids[:, j])
    return key


def prepare(texts: list[bytes | None], max_ratio: float, min_words: int, seed: int = 7, walks: int = WALKS) -> Items:
    own = [_symbols(normal_words(t)) for t in texts]
    own = [w if len(w) >= min_words else w[:0] for w in own]
    vocabulary = np.unique(np.concatenate([*own, np.ones(1, np.uint64)]))
    items = Items(own, [int(max_ratio * len(w)) for w in own], seed, vocabulary)
    classes: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(own):
        if len(w):
            classes[len(w).bit_length() - 1].append(k)
    rng = np.random.default_rng(seed)
    for walk in range(walks):
        for c, members in sorted(classes.items()):
            steps = max(SAMPLES, 3 * (1 << c) // 2)  # a walk advances on half of its steps
            ends = np.linspace(0, steps, SAMPLES + 1).astype(int)
            buffer = np.concatenate([np.append(own[k], np.uint64(0)) for k in members])
            starts = np.concatenate([[0], np.cumsum([len(own[k]) + 1 for k in members])[:-1]])
            ids, path = items.ids(buffer), Walk(buffer, seed, walk)
            for h in range(HASHES):
                sampled = [int(rng.integers(a, b)) for a, b in zip(ends, ends[1:], strict=False)]
                at, step, key, prefixes = starts, 0, np.zeros(len(members), np.uint64), []
                for s in sampled:
                    at, step = path.go(at, step, s), s
                    key = _joined(key, ids[at])
                    prefixes.append(np.unique(key))
                found = defaultdict(list)
                for k, x in zip(members, key.tolist(), strict=True):
                    found[x].append(k)
                first = np.zeros(len(vocabulary) + 2, bool)
                first[np.unique(ids[path.go(starts, 0, sampled[0])])] = True
                items.hashes[walk, h, c] = (sampled, first, prefixes, dict(found))
    items.segments = _segments(items)
    return items


def _known(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key


def candidates(symbols: np.ndarray, items: Items) -> np.ndarray:
    """(start, item) pairs whose windows agree with the item in all symbols sampled by some hash.

    All windows walk together up to the first sampled symbol of each hash; on from there only those
    whose key so far is a prefix of some item's key.
    """
    starts, ids = np.flatnonzero(symbols), items.ids(symbols)
    pairs = [np.empty((0, 2), np.int64)]
    for walk in sorted({w for w, _, _ in items.hashes}):
        path, at, step = Walk(symbols, items.seed, walk), starts, 0
        mine = sorted(((x[0][0], k) for k, x in items.hashes.items() if k[0] == walk))
        for s, k in mine:
            at, step = path.go(at, step, s), s
            sampled, first, prefixes, found = items.hashes[k]
            v = ids[at]
            keep = np.flatnonzero(first[v])
            where, here, key, done = starts[keep], at[keep], _joined(np.zeros(len(keep), np.uint64), v[keep]), s
            for n, t in enumerate(sampled[1:], 1):
                here, done = path.go(here, done, t), t
                key = _joined(key, ids[here])
                keep = np.flatnonzero(_known(key, prefixes[n]))
                where, here, key = where[keep], here[keep], key[keep]
            if len(where):
                lists = [found[x] for x in key.tolist()]
                pairs.append(np.stack([np.repeat(where, [len(x) for x in lists]), np.concatenate(lists)], 1))
    return np.unique(np.concatenate(pairs), axis=0)


def edit_table(items: np.ndarray, texts: np.ndarray, anywhere: bool = False) -> np.ndarray:
    """Per row and place of the text row, least word edits that turn the item into what ends there, begun at the first word or anywhere."""
    n, m = items.shape[1], texts.shape[1]
    ramp = np.arange(m + 1, dtype=np.int32)
    row = np.broadcast_to(ramp * (not anywhere), (len(items), m + 1)).copy()
    for i in range(n):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (texts != items[:, i : i + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row


def edit_distances(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Per row, least word edits that turn the item into some prefix of the text row."""
    return edit_table(items, texts).min(axis=1)


def verified(symbols: np.ndarray, pairs: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(start, item, edits) of the candidates within the item's edit limit."""
    out: list[tuple[int, int, int]] = []
    if not len(pairs):
        return out
    lengths = np.array([len(w) for w in items.words])[pairs[:, 1]]
    for n in np.unique(lengths):
        mine = pairs[lengths == n]
        width = n + items.max_edits[mine[0, 1]]
        for lo in range(0, len(mine), 4096):
            part = mine[lo : lo + 4096]
            place = part[:, :1] + np.arange(width)
            text = np.where(place < len(symbols), symbols[np.minimum(place, len(symbols) - 1)], np.uint64(0))
            text = np.where(np.logical_or.accumulate(text == 0, axis=1), np.uint64(0), text)
            d = edit_distances(np.stack([items.words[k] for k in part[:, 1]]), text)
            ok = d <= items.max_edits[mine[0, 1]]
            out += [(int(p), int(k), int(e)) for (p, k), e in zip(part[ok], d[ok], strict=True)]
    return out


def undisturbed(symbols: np.ndarray, begin: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(start, item, edits) of the best place, text by text, of every item that occurs within its edit limit; none is missed.

    An item with at most e edits keeps one of its e + 1 parts, at most e words off its place. Around each
    such place one table of edit distances, run from the end, gives the least edits for all starts at once.
    """
    ids, out = items.ids(symbols), []
    known = np.concatenate([[0], np.cumsum(ids >= 2)])
    edits = np.array(items.max_edits, np.int64)
    places = []
    for q, (keys, first, of, inside) in items.segments.items():
        at = np.flatnonzero(known[q:] - known[:-q] == q)
        key = _keys(ids[at[:, None] + np.arange(q)])
        row = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        at, row = (x[keys[row] == key] for x in (at, row))
        n = first[row + 1] - first[row]
        entry = np.repeat(first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, item = np.repeat(at, n), of[entry].astype(np.int64)
        text = np.searchsorted(begin, at, side="right") - 1
        places.append(np.stack([item, text, (at - inside[entry]) // (edits[item] + 1)], 1))
    bands = np.unique(np.concatenate(places), axis=0) if places else np.empty((0, 3), np.int64)
    lengths = np.array([len(w) for w in items.words])[bands[:, 0]]
    for n in np.unique(lengths):
        mine = bands[lengths == n]
        e = int(edits[mine[0, 0]])
        starts, width = 3 * e + 1, n + 4 * e
        base = mine[:, 2] * (e + 1) - e
        low, high = begin[mine[:, 1]], begin[mine[:, 1] + 1] - 1
        # words of no item cannot agree with any of its words
        enough = known[np.clip(base + width, low, high)] - known[np.clip(base, low, high)] >= n - e
        mine, base, low, high = mine[enough], base[enough], low[enough], high[enough]
        step = max(1, CELLS // (width + 1))
        for lo in range(0, len(mine), step):
            part, own = mine[lo : lo + step], (x[lo : lo + step, None] for x in (base, low, high))
            b, x, y = own
            place = b + np.arange(width)
            text = np.where((place >= x) & (place < y), symbols[np.clip(place, 0, len(symbols) - 1)], np.uint64(0))
            d = edit_table(np.stack([items.words[k][::-1] for k in part[:, 0]]), text[:, ::-1], anywhere=True)[:, ::-1][:, :starts]
            at = place[:, :starts]
            d = np.where((at >= x) & (at < y), d, e + 1)
            best = d.argmin(axis=1)
            least = d[np.arange(len(part)), best]
            out += [(int(s), int(k), int(v)) for s, k, v in zip((b[:, 0] + best)[least <= e], part[least <= e, 0], least[least <= e], strict=True)]
    return out


def find(raws: list[bytes | None], items: Items) -> list[dict[int, tuple[int, int]]]:
    """Per text: item -> (edits, first word) of its best place."""
    hits: list[dict[int, tuple[int, int]]] = [{} for _ in raws]
    if not items.segments:
        return hits

    def flush(parts: list[np.ndarray], owners: list[int]) -> None:
        if not parts:
            return
        symbols = np.concatenate(parts)
        begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        for start, item, edits in verified(symbols, candidates(symbols, items), items) + undisturbed(symbols, begin, items):
            k = int(np.searchsorted(begin, start, side="right")) - 1
            best, mine = hits[owners[k]], (edits, start - int(begin[k]))
            best[item] = min(best.get(item, mine), mine)

    parts, owners, total = [], [], 0
    for k, raw in enumerate(raws):
        words = normal_words(raw)
        if words:
            parts.append(np.append(_symbols(words), np.uint64(0)))
            owners.append(k)
            total += len(words)
        if total >= GROUP_WORDS:
            flush(parts, owners)
            parts, owners, total = [], [], 0
    flush(parts, owners)
    return hits


def expected_recall(texts: list[bytes], edits: float, seed: int = 3, walks: int = WALKS, rounds: int = 20, within: float = 1.0) -> float:
    """Share of items found after that share of their words, all in the first ``within`` of the item, was edited at random (words replaced, lost or added)."""
    items, rng, found, total = prepare(texts, edits, 1, walks=walks), np.random.default_rng(seed), 0, 0
    for k, w in enumerate(items.words):
        for _ in range(rounds if len(w) else 0):
            x = w.tolist()
            for _ in range(int(edits * len(w))):
                at, kind = int(rng.integers(max(1, int(within * len(x))))), int(rng.integers(3))
                new = [int(rng.integers(1, 2**63))]
                x[at : at + (kind != 2)] = [] if kind == 1 else new
            buffer = np.array([*rng.integers(1, 2**63, 5), *x, *rng.integers(1, 2**63, len(w)), 0], np.uint64)
            pairs = verified(buffer, candidates(buffer, items), items) + undisturbed(buffer, np.array([0, len(buffer)]), items)
            found += k in {item for _, item, _ in pairs}
            total += 1
    return found / max(total, 1)


def _hits_udf(items: Items, ids: list, kind) -> object:
    shape = ArrayType(StructType([StructField("item_id", kind), StructField("edits", IntegerType()), StructField("start_word", IntegerType()), StructField("item_words", IntegerType())]))
    arrow = to_arrow_type(shape)

    @F.arrow_udf(shape)
    @lean
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = find([t.as_py() for t in texts.cast(pa.binary())], items)
            yield pa.array(
                [[{"item_id": ids[k], "edits": e, "start_word": p, "item_words": len(items.words[k])} for k, (e, p) in sorted(x.items())] for x in found], arrow
            )

    return hits


def _blocks(benchmark: DataFrame, max_ratio: float, min_words: int) -> list:
    """A UDF per block of at most about BLOCK items: the items are a stated query set, met in blocks of bounded size."""
    n = -(-benchmark.count() // BLOCK)
    kind = benchmark.schema["item_id"].dataType
    udfs = []
    for b in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).select("item_id", "text").collect() if n > 1 else benchmark.select("item_id", "text").collect()
        texts = [None if r[1] is None else r[1].encode() for r in rows]
        udfs.append(_hits_udf(prepare(texts, max_ratio, min_words), [r[0] for r in rows], kind))
    return udfs


def contaminated(docs: DataFrame, benchmark: DataFrame, max_ratio: float = 0.2, min_words: int = 5) -> DataFrame:
    """doc_id, item_id, edits, start_word, item_words: items that occur in documents with few word edits.

    Words are lower-cased (A-Z) and compared without punctuation. A window starts at every word of every
    text. It and each item are embedded by random CGK walks, which turn word edits into differing
    symbols; windows that agree with an item in the symbols sampled by one of the hashes (6 walks, 2
    hashes each, 4 symbols spread over the item's length) are verified by exact word edit distance, at
    most ``max_ratio`` of the item's words. The walks miss part of the edited items, more of longer ones;
    ``undisturbed`` finds the rest, so every item within its limit is found at its best place, whatever
    its length and wherever its edits are. ``expected_recall`` measures it.

    Defined cases: null texts and items, and items under ``min_words`` words, match nothing; repeated rows
    are reported each; empty tables give an empty table; other columns are not read. All work stays in
    the scan of the documents: no shuffle, whatever the skew.
    """
    out = None
    for hits in _blocks(benchmark, max_ratio, min_words):
        part = docs.select("doc_id", F.explode(hits("text")).alias("_h")).select("doc_id", "_h.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        item = benchmark.schema["item_id"].dataType.simpleString()
        out = docs.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", item), ("edits", "int"), ("start_word", "int"), ("item_words", "int"))]).where("false")
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_ratio: float = 0.2, min_words: int = 5) -> DataFrame:
    """The rows of ``docs`` in which no item occurs."""
    for hits in _blocks(benchmark, max_ratio, min_words):
        docs = docs.where(F.size(hits("text")) == 0)
    return docs

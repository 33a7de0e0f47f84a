"""Periodic runs of words, found online by catchers over completed power-of-two blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from waypoint.llm.common import mix

#: Bytes of text that are worked on together; a longer text is worked on by itself.
SLICE_BYTES = 4 << 20
#: Words appended at once.
CHUNK = 1 << 16
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Ids(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class _Level:
    """Catchers over blocks of ``2 ** k`` words that begin at every half block.

    A catcher opens when its block is complete and compares the block with each suffix of the same
    length as words are appended, up to one block length on. Its first match is a square; it is of this
    level if its period exceeds half a block, else a lower level has it too. Either way the catcher closes.
    """

    def __init__(self, k: int):
        self.k, self.block = k, 1 << k
        self.shift = max(k - 1, 0)
        self.step = 1 << self.shift
        self.at = 0  # first window whose hash is kept
        self.kept = np.empty(0, np.uint64)
        self.caught = np.zeros(1024, np.int64)  # distance of the first match by catcher, 0 while open

    def append(self, new: np.ndarray) -> np.ndarray:
        """Take the hashes of the windows completed now; returns those of windows twice as long."""
        start = self.at + len(self.kept)
        end = start + len(new)
        hashes = np.concatenate([self.kept, new])
        need = (end >> self.shift) + 2
        if need > len(self.caught):
            self.caught = np.concatenate([self.caught, np.zeros(max(need, len(self.caught)), np.int64)])
        suffix = np.arange(max(start, 1), end)
        nearer = ((suffix - 1) >> self.shift) << self.shift
        for catcher in (nearer, nearer - self.step) if self.k else (nearer,):
            known = catcher >= 0
            s, i = catcher[known], suffix[known]
            same = hashes[s - self.at] == hashes[i - self.at]
            s, i = s[same], i[same]
            which = s >> self.shift
            free = self.caught[which] == 0
            self.caught[which[free][::-1]] = (i - s)[free][::-1]  # of several matches the first counts
        ready = max(0, start - self.block)
        first, second = hashes[ready - self.at : end - self.block - self.at if end > self.block else 0], hashes[ready + self.block - self.at :]
        longer = mix(first * _C1 + (second ^ (second >> np.uint64(31))) * _C2) if len(first) else np.empty(0, np.uint64)
        cut = max(0, end - 2 * self.block - 1)
        if cut > self.at:
            hashes = hashes[cut - self.at :]
            self.at = cut
        self.kept = hashes
        return longer

    def squares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches [start, end) with their period: squares of neighbouring catchers merged."""
        low = self.step if self.k else 0
        which = np.flatnonzero(self.caught > low)
        period = self.caught[which]
        if not len(which):
            return which, which, period
        new = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 1) | (np.diff(period) != 0)]))
        last = np.append(new[1:], len(which)) - 1
        return which[new] * self.step, which[last] * self.step + self.block + period[new], period[new]


class Catchers:
    """Runs of a growing sequence of numbers; ``longest`` bounds the periods looked for at a quarter of it."""

    def __init__(self, longest: int):
        self.levels = [_Level(0)]
        while 4 * (self.levels[-1].block + 1) <= longest:  # the next level has periods above this block
            self.levels.append(_Level(len(self.levels)))
        self.parts: list[np.ndarray] = []

    def append(self, numbers: np.ndarray) -> None:
        self.parts.append(numbers)
        hashes = mix(numbers.view(np.uint64) * _C1 + _C2)
        for level in self.levels:
            hashes = level.append(hashes)

    def runs(self, min_length: int = 6, min_power: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and smallest period of the runs of at least ``min_power`` periods (4 or more).

        A run of period p is found at the level of blocks of p to 2p - 1 words: a half-block grid puts a
        block and its copy p words on inside every run of 4p words, and within the run the block recurs
        no sooner. So its catcher's distance is the smallest period, and beyond the outermost catchers
        the run goes on for less than half a block.
        """
        words = np.concatenate(self.parts) if self.parts else np.empty(0, np.int64)
        found = []
        for level in self.levels:
            start, end, period = level.squares()
            reach = level.step - 1
            least = np.maximum(min_length, min_power * period)
            for a, b, p in zip(*(x[end - start + 2 * reach >= least].tolist() for x in (start, end, period)), strict=True):
                back = words[max(a - reach, 0) : a] != words[max(a - reach, 0) + p : a + p]
                a -= int(np.argmax(back[::-1])) if back.any() else len(back)
                on = words[b : b + reach] != words[b - p : min(b + reach, len(words)) - p]
                b += int(np.argmax(on)) if on.any() else len(on)
                if b - a >= max(min_length, min_power * p) and np.array_equal(words[a : b - p], words[a + p : b]):
                    found.append((a, b - a, p))
        table = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) by start, then period, of every list of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    classes: dict[int, list[int]] = {}
    for k, words in enumerate(texts):
        if len(words) >= 6:
            classes.setdefault(len(words).bit_length(), []).append(k)
    for members in classes.values():  # texts of like length need the same levels
        ids = _Ids()
        catchers = Catchers(max(len(texts[k]) for k in members))
        begins, pending, at = [], [], 0

        def flush(pending: list, catchers: Catchers = catchers) -> None:
            both = np.concatenate(pending)
            for k in range(0, len(both), CHUNK):
                catchers.append(both[k : k + CHUNK])

        for nth, k in enumerate(members):
            n = len(texts[k])
            numbers = np.fromiter(map(ids.__getitem__, texts[k]), np.int64, n)
            pending += [numbers, np.array([-1 - nth])]  # a number of its own ends each text, no run passes it
            begins.append(at)
            at += n + 1
            if sum(map(len, pending[-2:])) > CHUNK or len(pending) > 512:
                flush(pending)
                pending = []
        if pending:
            flush(pending)
        start, length, period = catchers.runs()
        owner = np.searchsorted(begins, start, "right") - 1
        for o, s, m, p in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
            out[members[o]].append((s - begins[o], m, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth id, by its CRC-32, gets a periodic end; a null id none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1), strict=True):
        text = t.as_py() or ""
        if texts and size + len(text) > SLICE_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i.as_py())
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def _per_text(schema: pa.Schema, rows_of, plant: bool):
    """Task side: whole texts slice by slice; ``rows_of(id, words, runs)`` gives the rows of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                words = [t.encode().split() for t in texts]
                if plant:
                    words = [planted(w, i) for w, i in zip(words, ids, strict=True)]
                rows = [r for i, w, found in zip(ids, words, runs_of(words), strict=True) for r in rows_of(i, w, found)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _report_row(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> list[dict]:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return [
        {
            "doc_id": doc_id,
            "n_runs": len(runs),
            "start": best[0],
            "length": best[1],
            "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        }
    ]


def _mapped(docs: DataFrame, id_col: str, text_col: str, columns: str, rows_of, plant: bool) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = docs.sparkSession.createDataFrame([], f"doc_id {kind}, {columns}").schema
    return given.mapInArrow(_per_text(to_arrow_schema(shape), rows_of, plant), shape)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: doc_id, start (word number), length in words, period."""
    rows_of = lambda i, words, runs: [{"doc_id": i, "start": s, "length": m, "period": p} for s, m, p in runs]
    return _mapped(docs, id_col, text_col, "start long, length long, period long", rows_of, False)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with each run reduced to its first period, words joined by one space, and n_runs."""
    rows_of = lambda i, words, runs: [
        {"doc_id": i, "text": b" ".join(collapsed(words, runs)).decode(), "n_runs": len(runs)}
    ]
    return _mapped(docs, id_col, text_col, "text string, n_runs long", rows_of, False)


def report(docs: DataFrame) -> DataFrame:
    """Runs of every text with its planted end: their number, the longest, hashes of all and of the collapsed words.

    A run has a smallest period q, at least max(6, 4q) words, and no neighbour that continues it. Of
    the longest ones the first by start, then by period is given.

    Defined cases: null and empty texts have no words, no runs and null for the longest; rows with the
    same id are worked on apart; a null id gets no planted end; an empty table gives an empty table.
    Texts are worked on whole, in time n log n, a very long one by itself. Only doc_id and text are read,
    others may have any name. Nothing is shuffled.
    """
    columns = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _mapped(docs, "doc_id", "text", columns, _report_row, True)

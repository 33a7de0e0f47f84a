import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waypoint.llm import periods

DOCS = "doc_id bigint, text string, start string, length int"


def brute(words):
    """All maximal repetitions by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(
                all(words[k] == words[k + e] for k in range(i, i + length - e)) for e in range(1, q) if q % e == 0
            ):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(i, text):
    words = (text or "").encode().split()
    n = len(words)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute(words)
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    s, m, p = best[0] if best else (None, None, None)
    return (
        i,
        len(runs),
        s,
        m,
        p,
        1000 * m // p if best else None,
        hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest(),
    )


def repetitive(rng, size):
    words = []
    while len(words) < size:
        unit = [rng.choice("abcd") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 21]))]
        times = rng.choice([1, 1, 2, 4, 5, 9])
        words += (unit * times)[: len(unit) * times - rng.randrange(len(unit))]
    return words[:size]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab"), max_size=60), max_size=6))
def test_runs_match_brute_force(texts):
    texts = [[w.encode() for w in t] for t in texts]
    assert periods.runs_of(texts) == [brute(t) for t in texts]


def test_long_periods_and_nested_runs():
    rng = random.Random(3)
    texts = [[w.encode() for w in repetitive(rng, n)] for n in [7, 40, 200, 600, 600, 900]]
    inner = [b"x"] * 7 + [b"y"]
    texts += [inner * 6, [str(k % 57).encode() for k in range(300)], [b"z"] * 500, inner * 3 + [b"q"] + inner * 5]
    got = periods.runs_of(texts)
    assert got == [brute(t) for t in texts] and sum(map(len, got)) > 40


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 10_000])
def test_runs_do_not_depend_on_how_words_are_appended(chunk):
    rng = random.Random(8)
    words = [w.encode() for w in repetitive(rng, 700)]
    ids = periods._Ids()
    numbers = np.array([ids[w] for w in words])
    catchers = periods.Catchers(len(words))
    for k in range(0, len(numbers), chunk):
        catchers.append(numbers[k : k + chunk])
    assert list(zip(*(x.tolist() for x in catchers.runs()), strict=True)) == brute(words)


def test_report_matches_brute_force(rows):
    rng = random.Random(5)
    data = [(k, " ".join(repetitive(rng, rng.randrange(0, 160)))) for k in range(60)]
    data += [(k, " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 300)))) for k in range(100, 160)]
    data += [(None, "a " * 30), (200, None), (201, ""), (202, "\x0b \n"), (203, "é" * 9), (3, "a b " * 9), (3, "a b " * 9), (204, "a b " * 20)]
    data += [(205, "u v w " * 4), (206, "a " * 5), (207, "a " * 6), (208, "a b " * 3 + "a")]
    out = periods.report(rows([(i, t, "clash", 1) for i, t in data], DOCS))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t in data), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 and r[1] > 0 for r in got if (i := r[0]) is not None) > 5
    assert periods.report(out.limit(0).selectExpr("doc_id", "collapsed_sha256 AS text")).count() == 0


def test_a_very_long_text(rows):
    words = [str(k * k % 1_000_003) for k in range(150_000)]
    words += ["tail", "of", "it"] * 60_000
    row = periods.find_runs(rows([(1, " ".join(words), "", 0)], DOCS)).collect()
    assert [tuple(r) for r in row] == [(1, 150_000, 180_000, 3)]


def test_collapsed_texts(rows):
    out = periods.collapse_runs(rows([(1, "so it goes. " * 9 + "End", "", 0), (2, "no run", "", 0), (3, None, "", 0)], DOCS))
    assert sorted(map(tuple, out.collect())) == [(1, "so it goes. End", 1), (2, "no run", 0), (3, "", 0)]

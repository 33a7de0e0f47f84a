import hashlib
import random
from collections import Counter

import duckdb
import pytest

from waypoint.llm import substrings


def brute(data, size):
    texts = [(t or "").encode().split() for _, t in data]
    count = Counter(tuple(w[k : k + size]) for w in texts for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(data, texts, strict=True):
        gone = {k + j for k in range(len(w) - size + 1) if count[tuple(w[k : k + size])] > 1 for j in range(size)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, chunk", [(22, 10**6), (20, 40)])
def test_matches_brute_force(spark, rows, monkeypatch, bits, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzé")
    passage = [word() for _ in range(12)]
    data = [(k, " ".join([word() for _ in range(rng.randrange(0, 30))] + passage * (k % 3 > 0) + [word() for _ in range(9)])) for k in range(60)]
    data += [(100, None), (101, ""), (102, " \n "), (103, "same " * 40), (104, "one two three four five"), (104, "one two three four five"), (104, "other text under the same id " * 2)]
    data += [(None, data[5][1]), (105, "\x0b".join(passage[:6]) + "  " + passage[6])]
    df = rows([(i, t, "x") for i, t in data], "doc_id bigint, text string, n_words string").repartition(5)
    out = substrings.without_repeats(df, 5, bits)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=str) == brute(data, 5)


def test_sql_agrees_and_long_text(spark, rows):
    long = " ".join(str(k) for k in range(30_000))
    passage = " ".join(f"p{k}" for k in range(50))
    data = [(1, long), (2, f"start {passage} end"), (3, f"{passage} tail"), (4, passage + " " + passage), (5, None), (6, " ".join(str(k) for k in range(200, 240)))]
    df = rows(data, "doc_id bigint, text string")
    got = sorted(map(tuple, substrings.report(df).collect()))
    assert got == brute(data, 35)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.sql(substrings.SQL).fetchall()) == got
    assert substrings.report(df.limit(0)).count() == 0

import hashlib
import random
import zlib

import duckdb
import pytest

from waypoint.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, digest int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n, *_ = row
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def climb(digests):
    """All levels, and per leaf the list of (left, right) siblings."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    paths = []
    for k in range(len(digests)):
        path = []
        for level in levels[:-1]:
            a = k - k % 3
            path.append((level[a:k], level[k + 1 : a + 3]))
            k //= 3
        paths.append(path)
    return levels, paths


def brute(data):
    groups = {}
    for row in data:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        rows = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (rows, *climb([leaf(r) for r in rows]))
    top, above = climb([trees[s][1][-1][0] for s in order]) if order else ([], [])
    out = []
    for s, upper in zip(order, above, strict=True):
        rows, levels, paths = trees[s]
        for row, path in zip(rows, paths, strict=True):
            path = path + upper
            changed = list(row)
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                changed[1] = row[1].replace("\n", "")
            d = leaf(changed)
            for left, right in path:
                d = H(*left, d, *right)
            proof = H(*[x for left, right in path for x in left + right])
            out.append((row[0], leaf(row), levels[-1][0], top[-1][0], proof, d, d == top[-1][0]))
    return out


def made(n, sources, rng):
    return [(k, rng.choice([f"a\nb {k}", "", "ü\n\n" * (k % 5), None, "x"]), rng.choice(["en", None]), rng.choice(sources), rng.choice([k, None]), "t", 1) for k in range(n)]


@pytest.mark.parametrize(
    "data",
    [
        made(40, [None, "a", "B", "ä", "", "one"], random.Random(1)) + [(None, "n\n", "en", "a", 1, "", 0)] * 2 + [(3, "again\n", "en", "a", 1, "", 0)] * 3,
        made(800, ["hot"] * 9 + ["b", None], random.Random(2)),
        [(7, "only\none", "en", "s", 3, "", 0)],
        [(k, "x\ny" * 50_000, "en", "s", 3, "", 0) for k in range(4)],
        [(k, f"t\n{k}", "en", f"s{k % 300:03}", k, "", 0) for k in range(600)],
    ],
    ids=["cases", "several buckets", "one leaf", "long texts, one source", "many sources"],
)
def test_manifest_matches_brute_force(rows, data):
    out = merkle.report(rows(data, DOCS))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(data), key=str)


def test_tampering_is_noticed_only_where_a_line_feed_went(rows):
    data = made(120, ["a", "b"], random.Random(5))
    got = {r.doc_id: r.verified for r in merkle.report(rows(data, DOCS)).collect()}
    for i, text, *_ in data:
        assert got[i] == (zlib.crc32(str(i).encode()) % 2 == 1 or "\n" not in (text or ""))


def test_empty_table(rows):
    assert merkle.report(rows([], DOCS)).count() == 0


def test_nodes_carry_the_intervals_they_cover(rows):
    n = 3**5 + 5
    leaves = rows([("t", k, H(str(k))) for k in range(n)] + [("u", 0, H("u"))], "tree string, id bigint, digest string")
    nodes = merkle.manifest(leaves).nodes().collect()
    levels, _ = climb([H(str(k)) for k in range(n)])
    want = {(k, i * 3**k): (min(n, (i + 1) * 3**k), d) for k, level in enumerate(levels) for i, d in enumerate(level)}
    assert {(r.level, r.lo): (r.hi, r.digest) for r in nodes if r.scope == "group" and r.tree == "t"} == want
    assert [(r.level, r.lo, r.hi, r.digest) for r in nodes if r.scope == "group" and r.tree == "u"] == [(0, 0, 1, H("u"))]
    assert len(nodes) == len(want) + 1 + 3


def test_sql_agrees(rows, tmp_path):
    data = [r for r in made(200, ["a", "B", "ä", None], random.Random(3))]
    df = rows(data, DOCS)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = [tuple(r) for r in merkle.report(df).collect()]
    assert sorted(con.execute(merkle.SQL).fetchall(), key=str) == sorted(got, key=str)

import random

import xxhash

from waypoint.llm import common, simhash


def brute_fingerprint(text, size=3):
    words = [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(fps))]


def test_fingerprints_follow_the_definition():
    for t in [None, "", " \n", "One", "one Two", "a b c d", "É é A a É é a a", "x y z " * 5]:
        assert simhash.fingerprint(None if t is None else t.encode()) % 2**64 == brute_fingerprint(t)
    long = " ".join(str(k % 977) for k in range(simhash.CHUNK + 500))
    assert simhash.fingerprint(long.encode()) % 2**64 == brute_fingerprint(long)


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):  # chains, clusters within one byte, across bytes, and misses by one bit
        x = rng.choice(fps)
        for _ in range(rng.choice([1, 2, 2, 3])):
            x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(8)])
        fps.append(x)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    for bits in (0, 1, 2, 3):
        links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bits)
        found = {r.node: r.root for r in common.connected(links).collect()}
        groups = [found.get(f, f) for f in signed]
        want = brute_groups(fps, bits)
        assert len(set(zip(groups, want, strict=True))) == len(set(groups)) == len(set(want)), bits


def test_one_dense_group_does_not_make_pairs(spark):
    fps = [(a << 8 | b,) for a in range(64) for b in range(64)]  # 4096 within two bytes
    links = simhash.fingerprint_links(spark.createDataFrame(fps, "fp bigint"))
    assert links.count() < 40 * len(fps)


def test_near_duplicates_and_edge_rows(spark, rows):
    base = " ".join(f"word{k}" for k in range(400))
    data = [(7, base), (3, base + " tail"), (5, base), (5, base), (1, "something else entirely here"), (9, None), (8, ""), (None, base), (None, "alone and null")]
    df = rows([(i, t, "x") for i, t in data], "doc_id bigint, text string, fingerprint string")
    out = simhash.near_duplicates(df).collect()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    fps = {(i, f"{brute_fingerprint(t):016x}") for i, t in data}
    assert set(got) == fps and len(out) == len(data)
    groups = brute_groups([brute_fingerprint(t) for _, t in data], 2)
    least = {g: min((i for (i, _), h in zip(data, groups, strict=True) if h == g and i is not None), default=None) for g in groups}
    want = {(i, f"{brute_fingerprint(t):016x}"): least[g] for (i, t), g in zip(data, groups, strict=True)}
    assert got == want and want[9, "0" * 16] == 8 and None in want.values()
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(set(least.values()), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    got = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1400)}


def test_one_row_per_component_of_null_and_repeated_ids(spark, rows):
    lone = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcd"]
    data = [(None, lone[0]), (None, lone[0]), (None, lone[1]), (None, lone[1]), (4, lone[2]), (4, lone[3]), (4, lone[3]), (None, lone[2])]
    df = rows([(i, t, "x") for i, t in data], "doc_id bigint, text string, lang string").repartition(3)
    assert len(set(brute_groups([brute_fingerprint(t) for t in lone], 2))) == 4
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, lone[0]), (None, lone[1]), (4, lone[2]), (4, lone[3])], key=str)


def test_copies_of_an_id_with_other_text_in_the_same_component_go(spark, rows):
    base = " ".join(f"word{k}" for k in range(400))
    df = rows([(1, base), (1, base.upper()), (2, base), (None, None), (None, "")], "doc_id bigint, text string")
    kept = [(r.doc_id, (r.text or "").lower()) for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, base), (None, "")], key=str)

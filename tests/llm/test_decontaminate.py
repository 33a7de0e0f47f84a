import random

import numpy as np

from waypoint.llm import decontaminate as d

DOCS = "doc_id bigint, text string, item_id string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_edit_distances_match_brute_force():
    rng = random.Random(1)
    items = [[rng.randrange(4) for _ in range(7)] for _ in range(40)]
    texts = [[rng.randrange(4) for _ in range(9)] for _ in range(40)]
    got = d.edit_distances(np.array(items), np.array(texts))
    assert got.tolist() == [edits(a, b) for a, b in zip(items, texts, strict=True)]


def test_passages_are_found_and_clean_documents_left(spark, rows):
    rng = random.Random(2)
    items = [(k, " ".join(words(rng, 8 + 2 * k))) for k in range(30)] + [(100, None), (101, ""), (102, "too short")]
    docs, want = [], {}
    for k in range(30):
        own = items[k][1].split()
        copy = list(own)
        if k % 3 == 1:  # one word in ten replaced
            for _ in range(len(copy) // 10):
                copy[rng.randrange(len(copy))] = "changed"
        if k % 3 == 2:  # in capitals and with punctuation
            copy = [w.upper() + "," for w in copy]
        docs.append((k, " ".join(words(rng, 70) + copy + words(rng, 50))))
        want[k] = k
    docs += [(200 + k, " ".join(words(rng, 200))) for k in range(60)] + [(300, None), (301, ""), (302, "too short"), (7, docs[7][1])]
    docs.append((303, " ".join(words(rng, 60_000) + items[9][1].split())))
    df = rows([(i, t, "clash") for i, t in docs], DOCS).repartition(3)
    bench = rows(items, "item_id bigint, text string")
    out = d.contaminated(df, bench).collect()
    found = {(r.doc_id, r.item_id): r for r in out}
    assert {(k, k) for k in range(30) if k % 3 != 1} | {(303, 9)} <= set(found)
    assert len({k for k in range(1, 30, 3) if (k, k) in found}) >= 8
    assert all(i < 30 or i == 303 for i, _ in found) and len([r for r in out if r.doc_id == 7]) == 2
    assert found[0, 0].edits == 0 and found[0, 0].start_word == 70 and found[0, 0].item_words == 8
    for (i, j), r in found.items():
        text = d.normal_words(dict(docs)[i].encode())
        own = d.normal_words(dict(items)[j].encode())
        assert edits(own, text[r.start_word : r.start_word + len(own) + int(0.2 * len(own))]) == r.edits <= 0.2 * len(own)
    kept = d.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in found}


def test_recall_of_edited_items_and_blocks(spark, rows, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(15, 60))).encode() for _ in range(40)]
    assert d.expected_recall(texts, 0.0, rounds=2) == 1.0
    assert d.expected_recall(texts, 0.1, rounds=3) >= 0.9
    monkeypatch.setattr(d, "BLOCK", 15)
    bench = rows([(k, t.decode()) for k, t in enumerate(texts)], "item_id bigint, text string")
    df = rows([(k, t.decode(), "x") for k, t in enumerate(texts)], DOCS)
    assert {(k, k) for k in range(40)} <= {(r.doc_id, r.item_id) for r in d.contaminated(df, bench).collect()}
    assert d.keep_clean(df, bench).count() == 0
    assert d.contaminated(df, bench.limit(0)).count() == 0 and d.keep_clean(df, bench.limit(0)).count() == 40
    assert d.contaminated(df.limit(0), bench).count() == 0


def test_every_item_within_the_limit_is_found_at_its_best_place():
    rng = random.Random(8)
    for lengths, seed in (((15, 38, 59), 1), ((120, 250), 2)):
        texts = [" ".join(words(rng, n)).encode() for n in lengths for _ in range(6)]
        for within in (1.0, 0.5):
            assert d.expected_recall(texts, 0.2, seed, rounds=4, within=within) == 1.0


def test_places_and_edits_match_brute_force():
    rng = random.Random(9)
    few = lambda n: [f"v{rng.randrange(5)}" for _ in range(n)]
    items = [few(n) for n in (5, 6, 9, 10, 14, 15, 21, 30) for _ in range(3)]
    texts = [few(rng.randrange(1, 60)) for _ in range(12)] + [[], ["v1"]]
    for own in items:  # edited copies at the start, inside and at the end of texts
        copy = list(own)
        for _ in range(rng.randrange(len(own) // 5 + 2)):
            at, kind = rng.randrange(len(copy)), rng.randrange(3)
            copy[at : at + (kind != 2)] = [] if kind == 1 else few(1)
        texts.append(few(rng.choice([0, 25])) + copy + few(rng.choice([0, 20])))
    want = []
    for text in texts:
        hits = {}
        for k, own in enumerate(items):
            limit = int(0.2 * len(own))
            places = [(edits(own, text[s : s + len(own) + limit]), s) for s in range(len(text))]
            if places and min(places)[0] <= limit:
                hits[k] = min(places)
        want.append(hits)
    prepared = d.prepare([" ".join(w).encode() for w in items], 0.2, 5)
    assert d.find([" ".join(w).encode() for w in texts], prepared) == want
    assert sum(map(len, want)) > len(items) // 2

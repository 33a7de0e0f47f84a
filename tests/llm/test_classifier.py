import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypoint.llm import classifier

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, score string, quality string"
LABELS = "doc_id bigint, quality int, text int"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def dense_reference(rows, t):
    """Follow-the-regularised-leader written out over dense vectors, shard by shard."""
    z, n = np.zeros(1 << t.bits), np.zeros(1 << t.bits)
    for _ in range(t.epochs):
        ends = []
        for shard in sorted({r.shard for r in rows}):
            zs, ns, count = z.copy(), n.copy(), 0
            for r in sorted((r for r in rows if r.shard == shard), key=lambda r: r.turn):
                x = np.zeros(1 << t.bits)
                x[r.slots] = r.shares
                w = np.where(np.abs(zs) <= t.l1, 0, -(zs - np.sign(zs) * t.l1) / ((t.beta + np.sqrt(ns)) / t.alpha + t.l2))
                p = 1 / (1 + np.exp(-(w @ x)))
                g = (p - r.label) * x
                zs += g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / t.alpha * w
                ns += g * g
                count += 1
            ends.append((zs, ns, count))
        total = sum(c for *_, c in ends)
        z, n = (sum(e[k] * (e[2] / total) for e in ends) for k in (0, 1))
    return np.where(np.abs(z) <= t.l1, 0, -(z - np.sign(z) * t.l1) / ((t.beta + np.sqrt(n)) / t.alpha + t.l2))


def made(n):
    good, bad = "the river runs past an old mill and turns east", "BUY now !!! click $$$ here here here"
    data = [(k, f"{good if k % 3 else bad} number {k}", "clash", "clash") for k in range(n)]
    return data, [(k, int(k % 3 > 0), 0) for k in range(n)]


def test_training_matches_a_dense_reference(spark, rows, monkeypatch):
    t = classifier.Training(bits=8, shards=3, epochs=2)
    kept = {}
    own = classifier.stored
    monkeypatch.setattr(classifier, "stored", lambda df, name, **k: kept.setdefault(name, own(df, name, **k)))
    data, labels = made(60)
    got = classifier.train(rows(data, DOCS), rows(labels, LABELS), t)
    examples = kept["examples"].collect()
    assert len(examples) == sum(not held(k) for k in range(60))
    assert {r.label for r in examples} == {0.0, 1.0}
    np.testing.assert_allclose(got, dense_reference(examples, t), rtol=1e-9, atol=1e-12)
    again = classifier.train(rows(data[::-1], DOCS).repartition(7), rows(labels[::-1], LABELS), t)
    assert np.array_equal(got, again)


def test_held_out_labels_do_not_matter(rows):
    data, labels = made(50)
    turned = [(i, 1 - q if held(i) else q, x) for i, q, x in labels]
    t = classifier.Training(bits=10)
    a, b = (classifier.train(rows(data, DOCS), rows(x, LABELS), t) for x in (labels, turned))
    assert np.array_equal(a, b) and a.any()


def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    out = classifier.report(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == docs.count() and all(held(r.doc_id) for r in rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_cases(rows):
    data, labels = made(40)
    data += [(None, "the river", "x", "y"), (100, None, "x", "y"), (101, "", "x", "y"), (102, " \n", "x", "y"), (1, "BUY", "x", "y"), (1, "BUY", "x", "y")]
    data += [(103, "the river runs past " * 200_000, "x", "y")]
    labels += [(None, 1, 0), (5, None, 0), (6, 0, 0), (6, 0, 0), (999, 1, 0)]
    out = classifier.report(rows(data, DOCS), rows(labels, LABELS), classifier.Training(bits=10)).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(data) and by_id[None].held_out is False
    assert by_id[100].score == by_id[101].score == by_id[102].score and 0 < by_id[100].score < 1
    assert {r.held_out for r in out if r.doc_id is not None and held(r.doc_id)} == {True}
    assert by_id[103].score > 0.5
    nothing = rows([], LABELS)
    assert {r.score for r in classifier.report(rows(data[:5], DOCS), nothing, classifier.Training(bits=10)).collect()} == {0.5}
    assert classifier.report(rows([], DOCS), rows(labels, LABELS), classifier.Training(bits=10)).count() == 0


@pytest.mark.parametrize("bound", [30, 500])
def test_sample_is_bounded_and_stable(rows, bound):
    labels = rows([(k, k % 2, 0) for k in range(400)], LABELS)
    t = classifier.Training(max_rows=bound)
    a, b = (sorted(r._k_id for r in classifier.labelled_sample(x, t).collect()) for x in (labels, labels.orderBy(F.desc("doc_id")).repartition(5)))
    assert a == b and len(a) == min(bound, sum(not held(k) for k in range(400))) and not any(map(held, a))

import hashlib
import random
import re

import numpy as np

from waypoint.llm import pii, secrets

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][k]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1.2.3@+- ()é\n%") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 (377) 555-0271.", "x" * 200_000 + "@y", "1" * 200_000, "9." * 100_000]
    for t in texts:
        if len(t) < 1000:
            assert pii.base_spans(t) == brute(t), t
        else:
            pii.base_spans(t)  # in linear time


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = pii.Network.fresh(3, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, pii.N_CHARS, (4, 6)), rng.integers(0, pii.N_TAGS, (4, 6))
    _, g = net.gradients(x, y)
    for name in net.w:
        for _ in range(3):
            at = tuple(int(rng.integers(n)) for n in net.w[name].shape)
            keep, loss = net.w[name][at], []
            for step in (1e-2, -1e-2):
                net.w[name][at] = keep + step
                loss.append(net.gradients(x, y)[0])
            net.w[name][at] = keep
            assert abs((loss[0] - loss[1]) / 2e-2 - g[name][at]) < 2e-3, name


def test_paths_match_brute_force():
    rng = np.random.default_rng(1)
    t = rng.normal(0, 1, (pii.N_TAGS, pii.N_TAGS)).astype(np.float32)
    scores = [rng.normal(0, 1, (n, pii.N_TAGS)).astype(np.float32) for n in (1, 2, 3, 3, 2)]
    for e, got in zip(scores, pii.best_paths(scores, t), strict=True):
        paths = np.stack(np.meshgrid(*[range(pii.N_TAGS)] * len(e), indexing="ij"), -1).reshape(-1, len(e))
        value = sum(e[k, paths[:, k]] for k in range(len(e))) + sum(t[paths[:, k], paths[:, k + 1]] for k in range(len(e) - 1))
        assert got.tolist() == paths[value.argmax()].tolist()


def test_network_learns_and_report_handles_edges(spark, rows):
    net = pii.fit(pii.templates(500, 1), steps=160)
    held = pii.templates(200, 99)
    right = found = wanted = 0
    for (text, want), got in zip(held, pii.model_spans([t for t, _ in held], net), strict=True):
        want = [s for s in want if pii.plausible(s[0], text[s[1] : s[2]])]
        right += len(set(want) & set(got))
        found, wanted = found + len(got), wanted + len(want)
    assert right >= 0.85 * found and right >= 0.85 * wanted
    data = [(1, "mail joe.doe@mail.example.com or call 599-555-3756 today"), (2, None), (3, ""), (4, "plain words"), (4, "plain words"), (None, "ip 10.0.0.1"), (5, "x " * 40_000 + "+1 (377) 555-0271 " + "y " * 40_000)]
    df = rows([(i, t, "clash") for i, t in data], "doc_id bigint, text string, n_email string")
    out = pii.find_personal(df, net).collect()
    assert len(out) == len(data)
    for r in out:
        text = next(t for i, t in data if i == r.doc_id) or ""
        base = brute(text)
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in base) for n in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert set(written.split(",")) - {""} <= set(spans)
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
    assert pii.find_personal(df.limit(0), net).count() == 0


def test_secrets_are_told_from_other_findings(spark, rows):
    key = "f91f2b873bc89b9c5b8b3a486adf32c8523be758"
    texts = [
        (1, f'Words token = "{key}" more', {15: True}), (2, f"commit {key}\nnext", {7: False}), (3, "order 1234567890123456 and so", {6: False}),
        (4, None, {}), (5, "", {}), (6, "averyverylongwordwithoutanydigit", {}), (7, f'é password: {key}\nsee /var/data/{key}.txt', {12: True, 57: False}),
        (8, "y " * 50_000 + f"api_key='{key}'", {100_009: True}), (None, f'token = "{key}"', {9: True}), (9, "z" * 50_000, {}),
    ]
    df = rows([(i, t, "clash") for i, t, _ in texts] + [(1, texts[0][1], "again")], "doc_id bigint, text string, start string")
    out = secrets.scan(df, secrets.made_findings(spark, 60)).collect()
    for i, t, want in texts:
        got = {r.start: r.is_secret for r in out if r.id == i}
        assert got == want, (i, got)
        assert all(t[r.start : r.start + len(r.candidate)] == r.candidate for r in out if r.id == i)
    assert len([r for r in out if r.id == 1]) == 2
    assert secrets.report(df.limit(0)).count() == 0


def test_forest_on_held_out_findings(spark, rows):
    model = secrets.train(secrets.made_findings(spark, 60), ["report", "notes"])
    held = secrets.made_findings(spark, 30, offset=1000).withColumnRenamed("label", "want")
    held = held.selectExpr("monotonically_increasing_id() AS id", "want AS start", "candidate", "before", "after")
    out = secrets.score(held, model, ["report", "notes"]).collect()
    assert sum((r.start == 1.0) == r.is_secret for r in out) >= 0.95 * len(out)

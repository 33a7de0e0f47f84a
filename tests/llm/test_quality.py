import re

import numpy as np

from waypoint.llm import quality

DOCS = "doc_id bigint, text string, lang string, source string, n_words string"


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines)


def test_statistics_follow_their_definition():
    for t in [None, "", " \n\t", "a b c a b c", "a a a a", "x\nx\n\n \nx", "é # $ |\n<b>\x0bz w", "one two three four one two three " * 4]:
        assert quality.text_stats(t) == brute_stats(t), t


def test_chi_squared():
    assert abs(quality.chi2_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(quality.chi2_cdf(4.3515, 5) - 0.5) < 1e-4


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    text = lambda m: " ".join(rng.choice(vocabulary, m))
    rows = [(k, text(int(rng.integers(60, 400))), "en", "hot" if k % 2 else f"s{k % 3}", "z") for k in range(n)]
    rows += [(10_000 + k, "### ".join(text(120).split()) + " |$$", "en", "hot", "z") for k in range(12)]
    rows += [(20_000, None, "en", "hot", "z"), (20_001, "", None, None, "z"), (20_002, "few words", "en", "hot", "z"), (20_003, text(80), None, None, "z"), (20_003, text(80), None, None, "z"), (None, "spam and ham " * 60, "en", "hot", "z")]
    return rows


def brute_mcd(x, share=0.75, steps=5):
    """Concentration steps on one cohort, in plain numpy, with the same cells, factors and floors: rows, centre, scatter."""
    floor, scale = np.diag(np.square(quality.FLOORS)), quality.SCALE
    q = quality.chi2_quantile(share, 5)
    centre = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - centre), axis=0) / scale
    centre, scatter = centre / scale, np.diag(spread**2)
    dist = lambda: brute_distance(x, centre, scatter)

    def refit(rows, factor):
        return rows.mean(0) / scale, factor * np.cov(rows.T, bias=True) / scale**2

    for _ in range(steps):
        cell = np.floor(np.log2(dist() + 1e-6) * quality.CELLS)
        last = np.sort(cell)[int(np.ceil(len(x) * share)) - 1]
        centre, scatter = refit(x[cell <= last], share / quality.chi2_cdf(q, 7))
    ql = quality.chi2_quantile(0.975, 5)
    inside = x[dist() <= ql]
    return len(inside), *refit(inside, 0.975 / quality.chi2_cdf(ql, 7))


def brute_distance(x, centre, scatter):
    off = x / quality.SCALE - centre
    return np.einsum("ni,ij,nj->n", off, np.linalg.inv(scatter + np.diag(np.square(quality.FLOORS))), off)


def brute_verdicts(data):
    """(id, base statistics) -> distance: pairs drawn towards their language, languages towards all."""
    vectors = {}
    for i, t, lang, source, _ in data:
        s = brute_stats(t) if len(t or "") < 400 else quality.text_stats(t)
        if s[0] >= 50 and 100 * s[4] <= 50 * s[0]:
            z = [np.log(s[0]), np.log(s[1] / s[0]), np.log1p(1000 * s[2] / s[1]), np.sqrt(s[3] / s[5]), np.sqrt(s[4] / s[0])]
            vectors.setdefault((lang, source), []).append(((i, s[:5]), np.floor(np.array(z) * quality.SCALE + 0.5)))

    def mcd(chosen):
        return brute_mcd(np.array([z for pair, own in vectors.items() if chosen(pair) for _, z in own]))

    def drawn(own, wide):
        w = own[0] / (own[0] + 25)
        return own[0], w * own[1] + (1 - w) * wide[1], w * own[2] + (1 - w) * wide[2]

    everything, want = mcd(lambda p: True), {}
    for pair, own in vectors.items():
        language = drawn(mcd(lambda p, lang=pair[0]: p[0] == lang), everything)
        _, centre, scatter = drawn(mcd(lambda p, pair=pair: p == pair), language)
        d = brute_distance(np.array([z for _, z in own]), centre, scatter)
        want |= {key: x for (key, _), x in zip(own, d, strict=True)}
    return want


def test_verdicts_match_plain_numpy_and_reject_junk(spark, rows):
    data = made(900)
    out = quality.quality_report(rows(data, DOCS).repartition(7)).collect()
    want = brute_verdicts(data)
    got = {(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)): r for r in out}
    assert len(out) == len(data) and all(abs(got[k].distance - x) < 1e-6 * (1 + x) for k, x in want.items())
    assert all(not r.kept and not r.base_failed for r in out if r.doc_id and 10_000 <= r.doc_id < 10_012)
    assert all(r.kept for r in out if r.doc_id is not None and r.doc_id < 900)
    assert [r.base_failed for r in sorted(out, key=lambda r: r.doc_id or 0)[-5:]] == [True, True, True, False, False]
    assert any(r.doc_id is None and r.base_failed for r in out)


def test_kept_rows_keep_their_columns(spark, rows):
    df = rows(made(150), DOCS)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= set(range(150))
    assert quality.quality_report(df.limit(0)).count() == 0


def test_every_pair_has_an_estimate_of_its_own_whatever_its_size(spark, rows):
    rng = np.random.default_rng(4)
    text = lambda m, tail="": " ".join(f"{'abcdefgh'[k % 8] * int(rng.integers(1, 9))}{k}{tail}" for k in rng.integers(0, 500, m))
    sizes = {"one": 1, "few": 4, "some": 24, "edge": 26, "odd": 40, "many": 260}
    data = [(1000 * n + k, text(int(rng.integers(70, 300)), "|$" if name == "odd" else ""), "ab"[n % 2], name, "z") for n, (name, size) in enumerate(sizes.items()) for k in range(size)]
    data += [(90_000 + k, text(150, "#|$<>") + " ###" * 20, "b", "few", "z") for k in range(1)] + [(90_001, text(100), None, "some", "z")]
    out = quality.quality_report(rows(data, DOCS).repartition(5)).collect()
    want = brute_verdicts(data)
    got = {(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)): r for r in out}
    assert set(want) <= set(got) and len(got) == len(data)
    for key, d in want.items():
        assert abs(got[key].distance - d) < 1e-6 * (1 + d), key
    fits = quality.fit_quality(rows(data, DOCS).select("lang", "source", quality.stats_of("text").alias("s")).select("lang", "source", "s.*"))
    assert fits.count() == len(sizes) + 1
    kept = {r.doc_id for r in out if r.kept}
    assert 90_000 not in kept and {i for i, _, _, name, _ in data if name not in ("odd", "few")} <= kept
    assert {i for i, _, _, name, _ in data if name == "odd"} <= kept  # its own style, rare in its language

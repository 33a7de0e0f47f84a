import hashlib
import re

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

from waypoint.llm import lines, tokens

DOCS = "doc_id bigint, text string, n_lines string, extra int"
SHARED = "  A line that Many documents share \t"


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        me = -(2**63) if i is None else i
        kept = [x for x in own if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != me)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark, rows):
    data = [
        (1, f"own one\n{SHARED}\nx\n{SHARED.upper()}"),
        (2, f"{SHARED}\n\nend"),
        (3, f"a\n{SHARED}"),
        (9, f"{SHARED}\nkeeps both\n{SHARED.strip()}"),
        (4, "ümlaut zeile mit Äpfeln\n" * 3),
        (5, "ümlaut zeile mit äpfeln"),
        (6, None),
        (7, ""),
        (None, SHARED),
        (8, "short\nshort"),
        (8, "short\nshort"),
        (2, f"{SHARED}\n\nend"),
        (10, "\n".join(f"line number {k} of a very long text" for k in range(20_000))),
    ]
    out = lines.report(rows([(i, t, "q", 0) for i, t in data], DOCS))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_lines(data)


def test_line_dedup_keeps_other_columns_and_order(spark, rows):
    df = rows([(k, f"{SHARED}\nrest {k}\n{SHARED}", "clash", k) for k in range(3)], DOCS)
    out = lines.drop_shared_lines(df)
    assert out.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.extra) for r in out.collect()}
    assert got[0] == ("rest 0", 3, 2, 0) and got[2] == (f"{SHARED}\nrest 2\n{SHARED}", 3, 0, 2)
    assert lines.report(df.limit(0)).count() == 0


def test_line_sql_agrees(spark, rows, tmp_path):
    data = [(k, f"{SHARED}\nrest {k % 3} and some more words\n\n") for k in range(12)] + [(50, None)]
    documents = rows(data, "doc_id bigint, text string")
    got = sorted(map(tuple, lines.report(documents).collect()))
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    assert sorted(con.sql(lines.SQL).fetchall()) == got


def test_token_counts_are_the_librarys(spark, rows):
    texts = [
        None, "", " ", "hello world", "It's 3:45 o'clock, don't!", "<|endoftext|> x<|startoftext|>y", "naïve Ångström é ΣΑΣ",
        "a b c\x1cd", "日本語 テスト", "x" * 5000, "word " * 3000, "line\n\ttab\r\n", "😀 👩‍👩‍👧", "İI ß",
    ]
    df = rows([(k, t, "z", 1) for k, t in enumerate(texts)] + [(3, "hello world", "z", 1)], "doc_id bigint, text string, n_tokens string, extra int")
    path = public_tokenizers.path("word_bpe_49k.json")
    out = tokens.count_tokens(df.repartition(3), path, table_size=4)
    library = Tokenizer.from_file(path)
    assert out.columns == ["doc_id", "extra", "n_bytes", "n_tokens", "over_limit"]
    for r in out.collect():
        t = texts[r.doc_id] or ""
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len(t.encode()), want > 2048), t[:40]
    assert tokens.count_tokens(df.limit(0), path).count() == 0


def test_frequent_pretokens_hold_what_is_frequent(spark, rows):
    df = rows([(k, " ".join(f"w{k}x{j}" for j in range(50)) + " hot warm" + " hot" * 20) for k in range(40)], "doc_id bigint, text string")
    found = tokens.frequent_pretokens(df.repartition(40), size=8)
    assert found[0] == b"hot" and len(found) <= 8
    assert all(re.fullmatch(rb"\S+", w) for w in found)

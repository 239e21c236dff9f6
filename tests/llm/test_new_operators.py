"""Periodic runs, personal data and vector codes against brute force and hand-made cases."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boutframe.llm import packing, periodic_runs, pii, secrets, vector_codes

SCHEMA = "doc_id long, text string, n_runs long, label string"
ODD = [None, "", " ", "\n\t ", "a", "a " * 3000, "é é é é é é", "x  y z", "a b " * 4 + "c", "12 " * 20]


def table(spark, texts):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], SCHEMA)  # with names that operators use too


# periodic runs


def slow_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=6))
def test_runs_match_brute_force(blocks):
    words = [w for unit, times in blocks for w in unit * times]
    assert periodic_runs.runs(words) == slow_runs(words)


def test_runs_inside_runs_and_long_periods():
    rng = random.Random(5)
    unit = [f"u{k}" for k in range(300)]
    unit[40:50] = ["-"] * 10
    words = [f"v{rng.randrange(900)}" for _ in range(500)] + unit * 6 + ["-"] * 9
    assert periodic_runs.runs(words) == slow_runs(words) and (500, 1800, 300) in periodic_runs.runs(words)
    assert periodic_runs.runs(["a"] * 5) == [] and periodic_runs.runs(["a"] * 6) == [(0, 6, 1)] and periodic_runs.runs(["a", "b"] * 4) == [(0, 8, 2)]
    many = [x for k in range(20_000) for x in (f"x{k}", *["-"] * 7)]  # many runs, none of which hides another
    assert periodic_runs.runs(many) == [(8 * k + 1, 7, 1) for k in range(20_000)]
    assert periodic_runs.runs(["a", "b", "c"] * 200_000) == [(0, 600_000, 3)]


def expected_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    longest = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_run_rows_match_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["ab", "c", "D", "d"]) for _ in range(rng.randrange(60))) for _ in range(90)]
    got = periodic_runs.find_runs(table(spark, texts).repartition(5), plant=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [expected_row(k, t) for k, t in enumerate(texts)]
    null = periodic_runs.find_runs(spark.createDataFrame([(None, None), (None, "a b c d e f")], "doc_id long, text string"), plant=True)
    assert sorted(map(tuple, null.collect()), key=str) == sorted([expected_row(None, None), expected_row(None, "a b c d e f")], key=str)


def test_collapse_repeats(spark):
    rows = {r.doc_id: r for r in periodic_runs.collapse_repeats(table(spark, ["x  a b a b a b a b y", "two  spaces", None])).collect()}
    assert rows[0].text == "x a b y" and rows[1].text == "two  spaces" and rows[2].text is None and rows[0].label == "x"


# personal data


def slow_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(pii.BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            right = {
                "email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "phone": lambda digits=digits: 9 <= len(digits) <= 15,
                "card": lambda digits=digits, twice=twice: 12 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in twice) % 10 == 0,
            }[kind]
            if right():
                out.append((m.start(), n, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


PIECES = ["@", "a", "b.c", "+", "1", "22", "255", "256", ".", "-", " ", "(", ")", "4111111111111111", "::", "x", "é", "://", "iban ", "tel ", "u:p@host", "0", " 4929348385146306 ", "+1 (017) 555-7713", "1.2.3.4", "_", "%", "\n", "account no. 12345678", "İ", "٣"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans_match_the_patterns(text):
    base, spans = pii.find_spans(text)
    assert base == slow_spans(text) and set(base) <= set(spans)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 please", ["iban DE89 3704 0044 0532 0130 00"]), ("iban DE89 3704 0044 0532 0130 01", []),
        ("write to jürgen@exämple.de", ["mail jürgen@exämple.de"]), ('"john doe"@example.com', ['mail "john doe"@example.com']),
        ("https://bob:secret@example.com:80/x", ["login https://bob:secret@example.com:80", "email secret@example.com"]),
        ("at fe80::1ff:fe23:4567:890a or 2001:db8:0:0:0:0:2:1", ["ip6 fe80::1ff:fe23:4567:890a", "ip6 2001:db8:0:0:0:0:2:1"]),
        ("12:30:45, std::vector<int>, a::b, Note: this", []), ("00:1B:44:11:3A:B7", ["mac 00:1B:44:11:3A:B7"]),
        ("SSN 123-45-6789, ssn: 000-12-3456", ["ssn 123-45-6789"]), ("account number: 12345678; passport no AB123456", ["account 12345678", "account AB123456"]),
        ("Tel. (030) 123 45 67", ["tel (030) 123 45 67"]), ("the account is closed in 2024, hotel 1234567, tel aviv 2020", []),
        ("a@b.c@d.e", ["email a@b.c"]), ("1.2.3.4.5.6.7.8", ["ip 1.2.3.4", "ip 5.6.7.8"]), ("999.1.1.1", []), ("4111 1111-1111 1111", ["card 4111 1111-1111 1111"]), ("4111 1111-1111 1112", []),
    ],
)
def test_added_spans(text, want):
    assert [f"{kind} {text[start:end]}" for start, end, kind in pii.find_spans(text)[1]] == want


def test_pii_rows_and_redaction(spark):
    texts = [*ODD, "mail me: a.b@c.de or call +1 (017) 555-7713", "https://bob:secret@example.com/x"]
    rows = {r.doc_id: r for r in pii.scan(table(spark, texts).repartition(5)).collect()}
    for k, text in enumerate(texts):
        base = slow_spans(text or "")
        assert rows[k].base_sha256 == hashlib.sha256(",".join(f"{x}:{s}:{e}" for s, e, x in base).encode()).hexdigest()
        assert [rows[k][f"n_{x}"] for x in pii.KINDS] == [sum(b[2] == x for b in base) for x in pii.KINDS]
    out = {r.doc_id: r.text for r in pii.redact(table(spark, texts)).collect()}
    assert out[len(ODD)] == "mail me: <email> or call <phone>" and out[len(ODD) + 1] == "<login>/x" and out[0] is None


def test_anchors_take_linear_time():
    for unit in ("1", "1.", "a@", "+1(", "(", "a:", "tel ", "b.c-", "1:", "a@b.c-", "a" * 50 + "@"):
        assert pii.find_spans("+1" + unit * 400)[0] == slow_spans("+1" + unit * 400)  # the patterns themselves take quadratic time
        pii.find_spans("+1" + unit * 150_000)


# vector codes


def slow_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label) by id, vectors of one length."""
    whole = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = len(whole[0][1]) // parts
    cut = [[q[k * size : (k + 1) * size] for k in range(parts)] for _, q, _ in whole]
    books = [[cut[e][k] for e in range(min(entries, len(whole)))] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [[min(range(len(books[k])), key=lambda e: (far(p[k], books[k][e]), e)) for k in range(parts)] for p in cut]
        for k in range(parts if n < rounds else 0):
            for e in range(len(books[k])):
                if mine := [p[k] for p, a in zip(cut, at, strict=True) if a[k] == e]:
                    books[k][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    error = [sum(far(p[k], books[k][a[k]]) for k in range(parts)) for p, a in zip(cut, at, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for e in a), err, sum(x for x, (_, _, l) in zip(error, whole, strict=True) if l == label), sha) for (i, _, label), a, err in zip(whole, at, error, strict=True))


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"entry": F.lit(1), "upper": F.lit(0.5), "code": F.lit("x")}).repartition(5)


def coded(df, **options):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, **options).collect())


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.2, (7, 8))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 7] + rng.normal(0, 0.01, 8)], None if k % 5 == 0 else k % 3) for k in range(300)]
    rows += [(1000 + k, rows[k][1], 1) for k in range(0, 100, 3)]  # ties
    rows += [(2000, None, 1), (2001, [0.1] * 7 + [None], 1), (2002, [float("nan")] * 8, None), (2003, [float("-inf")] + [0.0] * 7, 2)]
    assert coded(vectors(spark, rows)) == slow_codes(rows)
    assert coded(vectors(spark, rows[:30]), rounds=1) == slow_codes(rows[:30], rounds=1)


def test_codes_of_coarse_grids_keep_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) / 1024 for x in rng.integers(-2, 3, 8)], 0) for k in range(500)]
    assert coded(vectors(spark, rows), entries=12) == slow_codes(rows, entries=12)


def test_codes_of_large_numbers(spark):
    rng = np.random.default_rng(5)
    for size in (1e7, 1e25):  # beyond float64's integers, beyond int64
        rows = [(k, [float(np.float32(x)) for x in rng.normal(0, size, 4)], k % 2) for k in range(40)]
        want = slow_codes(rows, entries=6)
        fit = [(i, c, e if e < 2**63 else None, t if t < 2**63 else None, s) for i, c, e, t, s in want]
        got = coded(vectors(spark, rows, "double"), entries=6)
        assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in fit]
        assert all(g[3] == w[3] for g, w in zip(got, fit, strict=True) if w[3] is not None)


def test_bounds_never_change_an_assignment():
    rng = np.random.default_rng(6)
    x, books = rng.integers(-30, 30, (3000, 3)), vector_codes.Codebooks([rng.integers(-30, 30, (40, 3))])
    entry, upper, lower = books.scan(0, x)
    scanned = []
    for _ in range(6):
        moved = np.array([x[entry == e].sum(0) // max(1, (entry == e).sum()) if (entry == e).any() else books.entries[0][e] for e in range(40)])
        books = vector_codes.Codebooks([moved], books.entries)
        entry, upper, lower, doubts = books.assign(0, x, entry, upper, lower)
        assert (entry == books.scan(0, x)[0]).all()
        scanned.append(doubts)
    assert min(scanned) < 1500  # the bounds save scans


def test_codes_of_odd_tables(spark):
    assert coded(vectors(spark, []).where("vec_id > 0")) == [] and coded(vectors(spark, [(1, None, 1)])) == []
    empty = coded(vectors(spark, [(1, [], 1), (2, [], None)]))
    assert [r[:4] for r in empty] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    ragged = vector_codes.compress(vectors(spark, [(1, [0.5] * 5, 1), (None, [0.5], 1), (1, [0.5] * 5, 1)])).collect()  # padded to eight
    assert len(ragged) == 3 and {r.error for r in ragged} == {0}


def test_codes_match_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.1, 16)], None if k == 7 else k % 4) for k in range(300)]
    path = str(tmp_path / "embeddings.parquet")
    vectors(spark, rows).coalesce(1).write.parquet(path)
    want = sorted(duckdb.sql(vector_codes.oracle(f"'{path}/*.parquet'")).fetchall())
    assert coded(spark.read.parquet(path)) == want


def test_decoding_is_near(spark):
    rng = np.random.default_rng(8)
    df = vectors(spark, [(k, [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)], 0) for k in range(200)])
    books, codes = vector_codes.train(df)
    near = {r.vec_id: r.vector for r in vector_codes.decode(codes, books).collect()}
    assert all(np.abs(np.array(r.embedding) - near[r.vec_id]).max() < 1e-3 for r in df.collect())


# best-fit packing


def best_fit_decreasing(histogram, capacity):
    free, bins = [], 0
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fitting = [g for g in free if g >= length]
        if fitting:
            free.remove(min(fitting))
            free.append(min(fitting) - length)
        else:
            bins += 1
            free.append(capacity - length)
    return bins


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_plans_are_no_larger_than_best_fit_decreasing(folder):
    ids = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = pq.read_table(f"/root/testdata/{folder}/documents.parquet", columns=["text"])["text"].to_pylist()
    histogram = collections.Counter()
    for found in ids.encode_batch([t or "" for t in texts], add_special_tokens=False):
        whole, rest = divmod(len(found.ids) + 1, 1024)
        histogram.update({1024: whole} | ({rest: 1} if rest else {}))
    plan = packing.plan_bins(histogram, 1024)
    assert collections.Counter(x for lengths, times in plan for x in lengths for _ in range(times)) == +histogram and all(sum(lengths) <= 1024 for lengths, _ in plan)
    assert sum(times for _, times in plan) <= best_fit_decreasing(+histogram, 1024)


# secrets


def test_tokens_of_one_case_and_encoded_prose(spark):
    rng = random.Random(9)
    small = "abcdefghijklmnopqrstuvwxyz"
    cases = ["".join(rng.choice(letters) for _ in range(n)) for letters in (small, small.upper()) for n in (24, 32, 48, 64) for _ in range(12)]
    prose = [base64.b64encode(x).decode() for x in (b"the quick brown fox jumps over the lazy dog and on", b"Meet me at noon, by the old bridge; bring all the papers!", b"two lines\nof plain text are here for you")]
    names = ["donaudampfschifffahrtsgesellschaft", "antidisestablishmentarianism", "internationalizationandlocalization", "PNEUMONOULTRAMICROSCOPICSILICOVOLCANOCONIOSIS", "heitheitscheinauunderungkeitlich"]
    key = base64.b64encode(bytes(rng.randrange(256) for _ in range(30))).decode()
    texts = [f"see {x} there" for x in (*cases, key, *prose, *names)] + names * 40
    rows = {r.doc_id: r.spans for r in secrets.scan(table(spark, texts)).collect()}
    found = [k for k in range(len(cases)) if rows[k] == f"random:4:{4 + len(cases[k])}"]
    assert len(found) >= 0.95 * len(cases), [cases[k] for k in range(len(cases)) if k not in found]
    assert rows[len(cases)] == f"random:4:{4 + len(key)}" and not any(rows[k] for k in range(len(cases) + 1, len(texts)))

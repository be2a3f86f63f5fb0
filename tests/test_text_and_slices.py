import random

import pytest
from pyspark.sql import functions as F

from srcquarry.functions.text import is_blank, lines_keepends, strip
from srcquarry.operators.packing import pack_long
from srcquarry.operators.slicing import char_slices, check_budget, prepare, token_slices, verified_slices
from srcquarry.operators.windows import overlapping_windows, uncovered

CHUNK = "id int, type string, signature string, body string, doc string, start_line int, end_line int, language string"


def test_lines_blank_strip_like_python(spark):
    rng = random.Random(5)
    texts = ["", " ", "a", "\r\n", "a\rb\n\x0bc\x85d\u2028e", "\u3000\x1f"] + ["".join(rng.choice("ab \r\n\t\x0c\x1c\u2029é🙂") for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", lines_keepends(F.col("t")).alias("l"), is_blank(F.col("t")).alias("b"), strip(F.col("t")).alias("s")).collect():
        t = texts[r.i]
        assert r.l == t.splitlines(keepends=True)
        assert r.b == (not t.strip())
        assert r.s == t.strip()


def test_windows(spark):
    df = spark.createDataFrame([(1, "x" * 1801), (2, "\n" * 10), (3, ""), (4, None)], "k int, t string")
    got = overlapping_windows(df, keep=["k"], text="t").collect()
    assert [(r.k, r.window_no, len(r.body)) for r in sorted(got, key=lambda r: r.window_no)] == [(1, 0, 1801), (1, 1, 1)]


def test_uncovered(spark):
    spans = spark.createDataFrame([("f", 2, 4), ("f", 3, 6), ("f", 3, 6), ("f", 8, 9)], "k string, s int, e int")
    extents = spark.createDataFrame([("f", 10), ("g", 3), ("h", 0)], "k string, n int")
    got = uncovered(spans, extents, key=["k"], start="s", end="e", extent="n").collect()
    assert sorted(map(tuple, got)) == [("f", 0, 2), ("f", 6, 8), ("f", 9, 10), ("g", 0, 3)]


def test_budgets():
    for bad in (0, -1, True, 1.5, "18"):
        with pytest.raises(ValueError):
            check_budget(bad)


def test_slices_are_lossless_and_agree(spark):
    rng = random.Random(4)
    texts = ["", "🙂" * 40, "a\r\nb" * 20] + ["".join(rng.choice("ab中🙂 \r\n\t") for _ in range(rng.randrange(400))) for _ in range(40)]
    rows = [(i, "function", "f()", t, None if i % 3 else t[:5], 7, 40, "python") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, CHUNK)
    a = char_slices(df, max_tokens=18).collect()
    b = token_slices(df, lambda: lambda s: len(s) + 2, max_tokens=18).collect()
    key = lambda r: (r.id, r.source_field, r.char_start, r.char_end, r.piece, r.token_count)
    assert sorted(map(key, a)) == sorted(map(key, b))
    for i, t in enumerate(texts):
        own = sorted((r for r in a if r.id == i and r.source_field == "body"), key=lambda r: r.char_start)
        assert "".join(r.piece for r in own) == t and all(r.token_count <= 18 for r in own)


def test_prepare_lines_and_context(spark):
    df = spark.createDataFrame([(1, "function", "f()", "a" * 254 + "\n" + "b", "why", 7, 9, "python"), (2, "class", "", None, None, None, None, "go")], CHUNK)
    rows = sorted(prepare(df).collect(), key=lambda r: (r.id, r.source_field, r.char_start))
    one, two, doc, empty = rows
    assert (one.start_line, one.end_line, one.context_omitted) == (7, 7, "signature")
    assert (two.start_line, two.end_line, two.document) == (7, 8, "// Signature: f()\n\nb")
    assert (doc.type, doc.associated_type, doc.start_line, doc.end_line, doc.line_range_kind) == ("comment", "function", 7, 9, "associated_symbol")
    assert (empty.source_text, empty.doc_context) == ("", "none")


def test_verified_slices_bounded_and_not_monotonic():
    def count(s):
        assert len(s) <= 1024
        return len(s) + 2 + (s.count("a") > 3) * 9

    spans = verified_slices("a" * 101 + "中" * 3000, count, 18)
    assert spans[0][0] == 0 and spans[-1][1] == 3101 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    with pytest.raises(ValueError):
        verified_slices("🙂", lambda s: len(s) + 2, 2)
    assert verified_slices("", lambda s: 2, 2) == [(0, 0)]


def packed(spark, lines, first, limit, overlap):
    df = spark.createDataFrame([("k", "".join(lines), first)], "k string, t string, l int")
    rows = pack_long(df, keep=["k"], text="t", first_line="l", limit=limit, overlap=overlap).orderBy("part").collect()
    return [(r.body, r.start_line, r.end_line) for r in rows]


def by_hand(lines, first, limit, overlap):
    """The rules of packing told line by line, over ranges of line numbers."""
    size = lambda a, b: sum(map(len, lines[a:b]))
    out, a = [], 0
    for i, line in enumerate(lines):
        if len(line) > limit:
            out += [(a, i)] * (a < i) + [(i, i + 1)]
            a = i + 1
            continue
        if a < i and size(a, i + 1) > limit:
            out.append((a, i))
            a = min(x for x in range(max(a, i - overlap), i + 1) if size(x, i + 1) <= limit)
        if not line.strip() and size(a, i + 1) >= 0.8 * limit:
            out.append((a, i + 1))
            a = i + 1
    if "".join(lines[a:]).strip():
        out.append((a, len(lines)))
    texts = [("".join(lines[a:b]), first + a, first + b - 1) for a, b in out]
    return [(t[k : k + limit], x, y) for t, x, y in texts for k in range(0, len(t), limit)]


def test_pack_against_the_rules(spark):
    rng = random.Random(8)
    for n in range(12):
        lines = [rng.choice(["\n", "  \n", "a\n", "bb 🙂 cc\n", "d" * rng.randrange(40) + "\n", "e" * 70 + "\r\n"]) for _ in range(80)]
        assert packed(spark, lines, 3, 60, n % 4) == by_hand(lines, 3, 60, n % 4)


def test_pack_lines(spark):
    long = ["x" * 7000 + "\n", "tail"]
    got = packed(spark, long, 1, 3000, 2)
    assert [len(t) for t, _, _ in got] == [3000, 3000, 1001, 4] and [x[1:] for x in got[:3]] == [(1, 1)] * 3
    lines = [f"line {i}\n" for i in range(1000)]
    got = packed(spark, lines, 5, 100, 2)
    assert all(len(t) <= 100 for t, _, _ in got)
    for (t, a, b), (u, c, d) in zip(got, got[1:]):
        assert c == b - 1 and t.splitlines()[-2:] == u.splitlines()[:2]

import random
import re

from srcquarry.llm.split import split_oversized

LIMITS = [("python", 100, 10, "code points"), ("markdown", 120, 2, "lines"), ("zero", 50, 0, "code points")]
LINE = re.compile(r"[^\n]*\n|[^\n]+")


def run(spark, rows):
    items = spark.createDataFrame(rows, "id long, language string, body string, start_line int, piece string")
    limits = spark.createDataFrame(LIMITS, "language string, max_size int, overlap int, overlap_unit string")
    return split_oversized(items, limits, key="id", text="body", first_line="start_line", on="language").collect()


def test_pieces(spark):
    rng = random.Random(2)
    texts = {}
    for i in range(60):
        lang = ("python", "markdown", "zero")[i % 3]
        texts[i] = (lang, "".join(rng.choice(["word ", "x.\n", "\n\n", "🙂", "\r\n", "long" * 30, "中文。", "    y = 1\n"]) for _ in range(rng.randrange(5, 80))))
    got = run(spark, [(i, lang, t, 7, "clash") for i, (lang, t) in texts.items()])
    limit = {x[0]: x for x in LIMITS}
    for i, (lang, t) in texts.items():
        own = sorted((r for r in got if r.id == i), key=lambda r: r.piece_no)
        _, size, overlap, unit = limit[lang]
        assert bool(own) == (len(t) > size)
        at = 0
        for r in own:
            assert t[r.char_start : r.char_end] == r.piece and len(r.piece) <= size and r.char_start + r.overlap_chars == at
            assert r.start_line == 7 + t[: r.char_start].count("\n") and r.end_line == 7 + t[: max(r.char_start, r.char_end - 1)].count("\n")
            if unit == "code points":
                assert r.overlap_chars == (min(overlap, at) if at else 0)
            elif at:
                kept, following = "".join(LINE.findall(t[:at])[-overlap:]), len(LINE.search(t[at:])[0])
                assert r.overlap_chars == min(len(kept), max(size - following, size // 2))
            at = r.char_end
        assert not own or at == len(t)


def test_boundaries(spark):
    code = "def a():\n" + "    x = 1\n" * 7 + "\n" + "def b():\n" + "    y = 2\n" * 7
    got = sorted(run(spark, [(1, "python", code, 1, "")]), key=lambda r: r.piece_no)
    assert got[0].piece.endswith("x = 1\n") and got[1].piece[got[1].overlap_chars :].lstrip("\n").startswith("def b")
    lines = "".join(f"sentence number {i}\n" for i in range(12))
    got = sorted(run(spark, [(1, "markdown", lines, None, "")]), key=lambda r: r.piece_no)
    for a, b in zip(got, got[1:]):
        assert b.piece[: b.overlap_chars] == "".join(a.piece.splitlines(keepends=True)[-2:])
    assert got[0].start_line == 1


def test_pieces_fill_the_limit_beside_short_overlaps(spark):
    got = sorted(run(spark, [(1, "markdown", "ab\n" * 200, 1, "")]), key=lambda r: r.piece_no)
    assert [len(r.piece) for r in got[:-1]] == [120] * (len(got) - 1) and [r.overlap_chars for r in got] == [0] + [6] * (len(got) - 1)


def test_overlap_reaches_behind_a_piece_of_one_line(spark):
    text = "".join(c * (n - 1) + "\n" for c, n in (("a", 50), ("b", 30), ("c", 40), ("d", 40), ("e", 30)))
    got = sorted(run(spark, [(1, "markdown", text, 1, "")]), key=lambda r: r.piece_no)
    assert [r.piece[r.overlap_chars :][0] for r in got] == ["a", "d", "e"] and got[2].piece[0] == "c" and got[2].overlap_chars == 80


def test_texts_over_many_pages(spark):
    text = "".join(f"line {i} 🙂 of a long text\n" + ("\n" if i % 7 == 0 else "") for i in range(4_000))
    for lang in ("python", "markdown"):
        got = sorted(run(spark, [(1, lang, text, 1, "")]), key=lambda r: r.piece_no)
        assert "".join(r.piece[r.overlap_chars :] for r in got) == text and got[-1].end_line == text.count("\n")


def test_edges(spark):
    rows = [(1, None, "x" * 500, 1, ""), (2, "other", "x" * 500, 1, ""), (3, "python", None, 1, ""), (4, "python", "", 1, ""), (5, "python", "x" * 100, 1, ""), (None, "python", "x" * 101, 1, ""), (7, "zero", "🙂" * 5000, 1, "")]
    got = run(spark, rows)
    assert {r.id for r in got} == {None, 7} and sum(len(r.piece) for r in got if r.id == 7) == 5000
    assert run(spark, []) == []

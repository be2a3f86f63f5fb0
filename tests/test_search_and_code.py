import numpy as np
import pytest

from srcquarry.operators.code import chunks_of
from srcquarry.operators.search import top_k, top_k_batch


def vectors(spark, n=200, d=8):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, d))
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)] + [(n, None), (n + 1, [0.0] * d)]
    return v, spark.createDataFrame(rows, "id int, v array<double>")


def test_top_k_filters_before_ranking_and_clamps(spark):
    v, df = vectors(spark)
    from pyspark.sql import functions as F

    got = [r.id for r in top_k(df, v[0], k=5, id_="id", embedding="v", where=F.col("id") > 100).collect()]
    d = 1 - v @ v[0] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[0])
    assert got == [int(i) for i in np.argsort(d) if i > 100][:5]
    assert top_k(df, v[0], k=999, id_="id", embedding="v").count() == 200


def test_batch_in_blocks(spark):
    v, df = vectors(spark)
    got = top_k_batch(df.where("id % 50 = 0"), df, k=4, id_="id", embedding="v", query_rows=2, base_rows=30).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 50, 100, 150):
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == list(np.argsort(1 - u @ u[q], kind="stable")[:4])


def test_python_chunks():
    text = "import os\nMARKER = 1\n\n# why\n@deco\ndef f():\n    return '#'\nclass A:\n    pass\n"
    got = chunks_of(text, "python")
    assert [(c[0], c[1]) for c in got] == [("other", ""), ("function", "f"), ("class", "A")]
    assert "MARKER = 1" in got[0][3] and got[1][4] == "# why" and got[1][3].startswith("@deco") and got[1][5:] == (5, 7)
    with pytest.raises(ValueError, match="syntax error"):
        chunks_of(text + "def broken(\n", "python")


def test_go_and_cpp_chunks():
    go = chunks_of('package m\n\nimport "log"\nvar MARKER = 1\n// doc\nfunc (t *T) F(a int) int {\n\treturn "}"[0]\n}\n', "go")
    assert [(c[0], c[1]) for c in go if c[0] != "other"] == [("var", "<anonymous>"), ("method", "F")]
    assert go[-1][4] == "// doc" and any("import" in c[3] for c in go)
    cpp = chunks_of("#include <x>\nint MARKER = 1;\n// d\nint f(int a) { return '}'; }\nclass A {\n int x;\n};\n", "cpp")
    assert [(c[0], c[1]) for c in cpp if c[0] != "other"] == [("variable", "MARKER"), ("function", "f"), ("class", "A")]
    with pytest.raises(ValueError):
        chunks_of("int f() {", "cpp")


def test_long_symbols_are_cut_with_overlap():
    got = chunks_of("def f():\n" + "    x = 1\n" * 400, "python")
    assert len(got) > 1 and all(len(c[3]) <= 2000 for c in got) and all(c[2] == "def f():" for c in got)


def test_long_cpp_classes_are_split_into_members():
    body = "class A {\n public:\n" + "".join(f"  // doc {i}\n  int f{i}(int a) {{\n    return a * {i} + 1000000;\n  }}\n" for i in range(60)) + " private:\n  int field_ = 12345;\n};\n"
    got = [c for c in chunks_of("#include <x>\n" + body, "cpp") if c[0] != "other"]
    assert [c[1] for c in got] == [f"A::f{i}" for i in range(60)] + ["A::field_"]
    assert got[3][4] == "// doc 3" and got[3][5:] == (17, 19) and got[-1][0] == "member"


@pytest.mark.parametrize("sign", ["\x0c", "\x0b", "\x85", "\u2028", "\x1c"])
def test_signs_that_end_no_line_of_python(sign):
    text = f"x = '{sign}'\n" if sign != "\x0c" else "\x0c\n"
    got = [c for c in chunks_of(text + "# why\ndef a():\n    return 1\n\ndef b(): pass\n", "python") if c[0] != "other"]
    assert [(c[1], c[3], c[4], c[5], c[6]) for c in got] == [("a", "def a():\n    return 1", "# why", 3, 4), ("b", "def b(): pass", "", 6, 6)]


def test_carriage_returns_end_lines_of_python():
    got = [c for c in chunks_of("x = 1\r\ndef a():\r    return 1\rdef b(): pass\n", "python") if c[0] != "other"]
    assert [c[3] for c in got] == ["def a():\r    return 1", "def b(): pass"]


def test_files_that_do_not_parse_are_reported(spark):
    from srcquarry.operators.code import parse_files

    deep = "x = " + "(" * 5000 + ")" * 5000 + "\n"
    files = spark.createDataFrame([("a", "python", "def f(\n"), ("b", "python", deep), ("c", "go", "func F() {"), ("d", "python", "def g(): pass\n"), ("e", "python", None)], "p string, language string, content string")
    rows = {r.p: r for r in parse_files(files, keep=["p"], text="content", language="language", on_error="report").collect()}
    assert {k: r.type for k, r in rows.items()} == {"a": "syntax_error", "b": "syntax_error", "c": "syntax_error", "d": "function"} and rows["b"].body == deep
    with pytest.raises(Exception, match="syntax error"):
        parse_files(files, keep=["p"], text="content", language="language").collect()


def test_limits_and_further_parsers(spark):
    from srcquarry.operators.code import Node, parse_files

    def shout(text):
        return [Node(m.start(), m.end(), "shout", m[0], m[0], "") for m in __import__("re").finditer(r"[A-Z]{3,}", text)]

    files = spark.createDataFrame([("a", "notes", "some WORDS here"), ("b", "python", "def f():\n" + "    x = 1\n" * 30)], "p string, language string, content string")
    rows = parse_files(files, keep=["p"], text="content", language="language", limit=100, overlap=10, parsers={"notes": shout}).collect()
    assert [(r.type, r.body) for r in rows if r.p == "a"] == [("other", "some "), ("other", " here"), ("shout", "WORDS")]
    long = [r.body for r in rows if r.p == "b"]
    assert len(long) == 4 and all(len(b) <= 100 for b in long) and long[1].startswith(long[0][-10:])

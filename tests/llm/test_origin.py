import random

from srcquarry.llm import origin
from srcquarry.llm.layout import bundled, canonical, layout, looks
from srcquarry.llm.origin import classify_origin

HAND = 'import os\n\n\ndef alpha(value):\n    """Doc."""\n    total = 0\n    for item in value:\n        total += item * 3\n    return total\n\n\nclass Beta:\n    size = 3\n\n    def gamma(self):\n        if self.size > 2:\n            return os.sep\n        return None\n'
GETTERS = "".join(f"def get_field_{i}(m):\n    return m._f[{i}]\n\n" for i in range(12))


def test_looks():
    assert looks(HAND, "python") is None
    assert looks("# Code generated by xc. DO NOT EDIT.\n" + HAND, "python") == "generated"
    assert looks("# Copyright 2029 A\n\n# <auto-generated> by xc 3\n" + HAND, "python") == "generated"
    assert looks("# Vendored from lib 2.1; keep in sync with upstream.\n" + HAND, "python") == "vendored"
    assert looks(HAND + 'out.write("// Code generated by xc. DO NOT EDIT.")\n', "python") is None
    assert looks("# not generated: tuned by hand\n" + HAND, "python") is None
    assert looks(GETTERS, "python") == "generated"
    assert looks("package x\n\n" + "".join(f"func (m *T) GetF{i}() int32 {{\n\treturn m.f{i}\n}}\n\n" for i in range(9)), "go") == "generated"
    assert looks("TABLE = [" + ", ".join(str(random.Random(i).random()) for i in range(300)) + "]\n", "python") == "data"
    assert looks(HAND + "TABLE = [" + ", ".join(map(str, range(40))) + "]\n", "python") is None
    assert looks("".join(f"int f{i}(int a){{for(int i=0;i<3;++i)a^=i;return a?{i}:0;}}" for i in range(40)), "cpp") == "minified"
    assert looks("".join(f"def a{i}(b,q=4):w=b^{i};return w if q else a(w,1)\n" for i in range(20)), "python") == "minified"
    assert looks("<!-- @generated by xc -->\n\n# T\n", "markdown") == "generated" and looks("# generated by hand\n\ntext", "markdown") is None


def test_dirs():
    assert bundled("lib/third_party/x/a.py") and bundled("Godeps/_workspace/a.go") and not bundled("vendor_portal/a.go") and not bundled("src/vendor.go") and not bundled(None)


def classify(spark, rows, known):
    schema = "p string, rel string, language string, content string, origin string"
    files = spark.createDataFrame(rows, schema)
    return {r.p: (r.origin, r.copy_of) for r in classify_origin(files, spark.createDataFrame(known, "name string, content string"), key="p", path="rel", text="content", language="language").collect()}


def test_copies_by_both_ways(spark, monkeypatch):
    lib = HAND * 3
    rows = [
        ("copy", "src/other.py", "python", lib, ""), ("near", "src/x.py", "python", lib + "\nx = 1\n", ""), ("far", "src/y.py", "python", HAND[: len(HAND) // 2].rsplit("\n", 2)[0] + "\n", ""),
        ("dir", "a/vendor/x.md", "markdown", "# t\n", ""), ("bad", "vendor/z.py", "python", "def f(\n", ""), ("badcopy", "q.py", "python", lib + "\n<<<<<<< HEAD\n", ""),
        ("null", None, None, None, ""), ("blank", "vendor/e.py", "python", " \n", ""), (None, "s.py", "python", GETTERS, ""),
    ]
    want = {"copy": ("vendored", "l/a"), "near": ("vendored", "l/a"), "far": ("hand-written", None), "dir": ("vendored", None), "bad": ("hand-written", None), "null": ("hand-written", None), "blank": ("hand-written", None), None: ("generated", None)}
    got = classify(spark, rows, [("l/a", lib), ("l/b", None)])
    assert got.pop("badcopy")[0] == "hand-written" and got == want
    monkeypatch.setattr(origin, "MAX_KNOWN_FILES", 0)
    got = classify(spark, rows, [("l/a", lib), ("l/b", None)])
    assert got.pop("badcopy")[0] == "hand-written" and got == want
    assert classify(spark, [], [("l/a", lib)]) == {}


def test_both_paths_agree_on_versions_names_and_keys(spark, monkeypatch):
    body = lambda v: "\n".join(f"value_{v}_{i} = call_{v}({i}, other, more)" for i in range(60)) + "\n"
    known = spark.createDataFrame([("lib/a.py", body(1)), ("lib/a.py", body(2)), ("lib/b.py", body(2)), (None, body(3)), ("lib/c.py", None)], "name string, content string")
    rows = [("1", "x.py", body(1)), ("1", "x.py", body(2)), (None, "y.py", body(1)), ("3", "z.py", body(3)), ("4", "vendor/a.py", body(1)), ("5", "n.py", None)]
    files = spark.createDataFrame([(*r, "python") for r in rows], "id string, path string, content string, language string")
    run = lambda: sorted((tuple(r) for r in classify_origin(files, known, key="id", path="path", text="content", language="language").collect()), key=repr)
    small = run()
    monkeypatch.setattr("srcquarry.llm.origin.MAX_KNOWN_FILES", 0)
    assert run() == small
    assert small == sorted([("1", "vendored", "lib/a.py"), ("1", "vendored", "lib/b.py"), (None, "vendored", "lib/a.py"), ("3", "vendored", ""), ("4", "vendored", None), ("5", "hand-written", None)], key=repr)


def test_head_comment_of_any_length():
    licence = "# All rights reserved, as the licence of this part says.\n" * 600
    assert looks(licence + "# Code generated by tool. DO NOT EDIT.\n" + HAND, "python") == looks("# Code generated by tool. DO NOT EDIT.\n" + HAND, "python") == "generated"


def test_canonical_form():
    assert canonical("def f(a,\n      b): return a; x = 1\nif a:\n  for i in a: g(i)\n", "python") == [
        (0, "def f(a, b):"), (1, "return a"), (1, "x = 1"), (0, "if a:"), (1, "for i in a:"), (2, "g(i)")]
    assert canonical("int f(int a){for(int i=0;i<3;++i)a^=i;\n  return   a;}\n#define X 1\nint g;", "cpp") == [
        (0, "int f(int a) {"), (1, "for(int i=0;i<3;++i)a^=i;"), (1, "return a;"), (0, "}"), (0, "#define X 1"), (0, "int g;")]
    assert canonical("package x\n\nfunc F(\n\ta int,\n) int {\n\treturn a +\n\t\t1\n}\n", "go") == [(0, "package x"), (0, "func F( a int, ) int {"), (1, "return a + 1"), (0, "}")]


def test_layout_measures_the_original_against_the_canonical_form():
    neat = "int a = 1;\nint b = 2;\nvoid f() {\n  a = 2;\n}\n"
    f, tight = layout(neat, "cpp"), layout(neat.replace("\n", ""), "cpp")
    assert (f.lines, f.canonical_lines, f.same_lines) == (5, 5, 5) and (tight.lines, tight.canonical_lines, tight.same_lines) == (1, 5, 0)
    settings = "".join(f"{n.upper()} = {i * 37 % 11}\n" for i, n in enumerate("alpha beta gamma delta rho tau phi chi".split()))
    g, s = layout(GETTERS, "python"), layout(settings, "python")
    assert (g.uniform_share, g.counted_share) == (1.0, 1.0) and (s.uniform_share, s.counted_share) == (1.0, 0.0) and looks(settings, "python") is None


def test_many_known_files_with_a_shared_licence_agree_on_both_ways(spark, monkeypatch):
    licence = "# " + " ".join(f"word{i} of the licence" for i in range(12)) + "\n"
    body = lambda v: licence + "".join(f"value_{v}_{i} = call_{v}({i}, other)\n" for i in range(70))
    known = spark.createDataFrame([(f"l/{v}", body(v)) for v in range(300)], "name string, content string")
    rows = [(str(v), "x.py", body(v) + ("y = 1\n" * (v % 3)), "python") for v in range(250, 350)]
    files = spark.createDataFrame(rows, "id string, path string, content string, language string")
    run = lambda: sorted(tuple(r) for r in classify_origin(files, known, key="id", path="path", text="content", language="language").select("id", "copy_of").na.fill("-").collect())
    small = run()
    monkeypatch.setattr(origin, "MAX_KNOWN_FILES", 0)
    assert run() == small == [(str(v), f"l/{v}" if v < 300 else "-") for v in range(250, 350)]

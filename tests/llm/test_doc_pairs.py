import pytest

from srcquarry.llm.doc_pairs import doc_pairs
from srcquarry.llm.doc_text import informative
from srcquarry.llm.islands import documented_pairs

TELLS = "Returns the first slot that has no cold worker."


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  \n", "TODO", "# TODO: document this", "// FIXME(later): write docs", "# ------------", "# ====", "/* ... */", "-", "N/A", "ditto", "// See above.",
        "# noqa: E501", "# type: ignore", "// nolint:gocyclo", "// go:noinline", "/* clang-format off */", "// NOLINTNEXTLINE(readability-function-size)",
        "# Copyright 2029 The Project Contributors.\n# Licensed under the Public Terms, version 2.\n# All rights reserved.", "// SPDX-License-Identifier: X-1",
        "// if err := sortZone(entry); err != nil {\n// return 15\n// }", "# while value < 74:\n# value += 1\n# break", "size = load_map(None)", "load_map()", "The load map function.",
        "load_map.", "Load map...", "待补充", "待办：补文档", "同上", "Noch offen.", "Sin documentar.", "TODO(zone): write a proper description once the cleanup is finished",
        "/**\n * @brief TODO\n * @param size the map\n */", ">>> def load_map(): pass",
    ],
)
def test_trivial(text):
    assert not informative(text, "load_map")


@pytest.mark.parametrize(
    "text",
    [
        TELLS, f"# TODO\n# {TELLS}", f"TODO {TELLS}", f"/* FIXME(later): write docs {TELLS} */", f"# noqa: E501\n\n{TELLS}", "Seconds until the idle scope expires.",
        "// loadMap returns the first slot that has no cold worker.", "在锁释放之前一直等待，超时后丢弃远程的队列并返回错误码。", f"/// @brief {TELLS}", f"/*! \\brief {TELLS} */",
        f"# Copyright 2029 X\n# All rights reserved.\n# {TELLS}", f"同上 {TELLS}", "Liefert den ersten Puffer, der noch nicht zum Fenster gehört, sonst nichts.",
        f"Load map.\n\nArgs:\n    size: {TELLS}", "True if mesh and matrix share an offset.",
    ],
)
def test_informative(text):
    assert informative(text, "load_map")


def names(language, body, doc=""):
    return [p.name for p in documented_pairs(language, body, doc)]


def test_python():
    body = f'class A:\n    """{TELLS}"""\n\n    # {TELLS}\n\n    @deco\n    def one(self, a=")"):\n        pass\n\n    def two(self):\n        r"""{TELLS}"""\n        # {TELLS}\n\n    def three(self):\n        def inner():\n            """{TELLS}"""\n        return 1\n    async def four(\n        self,\n    ) -> dict[str, int]:\n        # c\n        \'{TELLS}\'\n'
    assert names("python", body) == ["one", "two", "four"]
    assert names("python", "def f():\n    x = 1\n", f"# {TELLS}") == ["f"]
    assert names("python", f"def f():\n    x = 1\n    '''{TELLS}'''\n") == []
    assert names("python", "class A:\n    def f(self):\n        pass\n", f"# {TELLS}") == []
    assert names("python", f"def f():\n    f'{TELLS}'\n") == []


def test_go_and_cpp():
    assert names("go", "func (t *T) F(a int) int {\n}\n", f"// {TELLS}") == ["F"]
    assert names("go", "type T struct {\n}\n", f"// {TELLS}") == []
    assert names("cpp", "template <typename T>\nstatic int A::f(std::vector<int>& a) {\n}\n", f"/// {TELLS}") == ["f"]
    body = f"class A {{\n public:\n  /// {TELLS}\n\n  int one(int a) {{ return '}}'; }}\n  int two() {{\n    // {TELLS}\n    return 0;\n  }}\n  /* TODO */\n  int three() {{ }}\n  /** {TELLS} */\n  bool operator==(int a) {{ }}\n  // {TELLS}\n private:\n  int x = 0;\n}};\n"
    assert names("cpp", body, f"// {TELLS}") == ["one", "operator=="]


def test_operator_edges(spark):
    schema = "chunk_id long, language string, body string, doc string, fn_name string, k string"
    rows = [
        (1, "python", "def f(): pass", f"# {TELLS}", "x", "y"), (1, "python", "def f(): pass", f"# {TELLS}", "x", "y"), (2, None, "def f(): pass", TELLS, "", ""),
        (3, "go", None, TELLS, "", ""), (None, "go", "func G() {", f"// {TELLS}", "", ""), (4, "python", "x" * 200_000, None, "", ""), (5, "python", "", "", "", ""),
    ]
    run = lambda r: sorted([(x.chunk_id, x.fn_name) for x in doc_pairs(spark.createDataFrame(r, schema), key="chunk_id", language="language", body="body", doc="doc").collect()], key=str)
    assert run(rows) == [(1, "f"), (1, "f"), (None, "G")]
    assert run([]) == []


def pairs(language, body, doc=""):
    return {p.name: p for p in documented_pairs(language, body, doc)}


def test_signatures_and_balanced_bodies_of_go():
    body = f"func F(v interface{{}}, s struct{{ a int }}) interface{{}} {{\n\tx := \"}}\"\n\treturn func() {{}}\n}}\n\n// {TELLS}\nfunc (t *T) G(f func(int) error) (a int, err error) {{ return 1, nil }} // {TELLS}\nfunc H() {{}}\n"
    got = pairs("go", body, f"// {TELLS}")
    assert list(got) == ["F", "G"] and got["F"].signature == "func F(v interface{}, s struct{ a int }) interface{}"
    assert got["F"].code.endswith("return func() {}\n}") and got["G"].code.endswith("nil }") and got["G"].doc == f"// {TELLS}"
    assert list(pairs("go", f"// {TELLS}\nvar x = 1\nfunc F() {{}}\n// {TELLS}\nfunc g()\n")) == []


def test_signatures_and_balanced_bodies_of_cpp():
    got = pairs("cpp", "int f(int a = int{3}, std::vector<int> b = {}) {\n  return a;\n}\nint g() { return 1; }\n", f"// {TELLS}")
    assert list(got) == ["f"] and got["f"].signature == "int f(int a = int{3}, std::vector<int> b = {})" and got["f"].code.endswith("return a;\n}")
    body = f"class P {{ // {TELLS}\n  int a; // first\n  // {TELLS}\n  P(int x) : a{{x}}, b(2) {{ go(); }}\n  int v = {{1}};\n  /* {TELLS} */ P& operator=(const P& o) {{ return *this; }}\n  // {TELLS}\n  int decl(int);\n  // {TELLS}\n  struct Q {{ int q() {{ return 1; }} }};\n  // {TELLS}\n  int last() const noexcept {{ return '}}'; }}\n}};\n"
    got = pairs("cpp", body)
    assert list(got) == ["P", "operator=", "last"] and got["P"].code == "P(int x) : a{x}, b(2) { go(); }" and got["P"].signature == "P(int x) : a{x}, b(2)"
    space = f"namespace a::b {{\n// {TELLS}\nint f() {{ return 1; }}\n#define X {{\n\n/// {TELLS}\ntemplate <typename T>\nT g(T t) {{ return t; }}\n}}  // namespace\n// {TELLS}\nint h() {{ return 2; }}\n"
    got = pairs("cpp", space)
    assert list(got) == ["f", "g", "h"] and got["g"].code == "template <typename T>\nT g(T t) { return t; }"
    for cut in range(0, len(body), 7):
        documented_pairs("cpp", body[:cut], TELLS)  # broken code around an island does not matter


def test_bodies_of_python():
    body = f'def f(a=(1,\n2)):\n    """{TELLS}"""\n    x = """\nat the margin\n"""\n# a comment at the margin\n    y = [\n1]\n\n    return x\n\nSIZE = 3\n\nif __name__ == "__main__":\n    f()\n\n# {TELLS}\ndef g(): return 1\nZ = 1\n'
    got = pairs("python", body)
    assert list(got) == ["f", "g"] and got["f"].code.endswith("1]\n\n    return x") and got["g"].code == "def g(): return 1"
    method = f'class A:\n    size = 1\n\n    def one(self):\n        """{TELLS}"""\n        return 1\n\n    other = 2\n'
    assert pairs("python", method)["one"].code == f'def one(self):\n        """{TELLS}"""\n        return 1'


def test_code_starts_with_its_signature_and_ends_its_body(spark):
    import pathlib

    from srcquarry.llm.doc_pair_queries import p1_pairs

    folder = "/root/testdata/sf0.001"
    if not pathlib.Path(folder).is_dir():
        pytest.skip("no tables here")
    rows = p1_pairs(spark, folder).join(spark.read.parquet(f"{folder}/chunk.parquet").select("chunk_id", "language").distinct(), "chunk_id").collect()
    assert rows and all(r.code.startswith(r.signature) and (r.language == "python" or r.code[-1] == "}") for r in rows)

import pytest

from srcquarry.llm import grammar_cpp, grammar_go, grammar_python
from srcquarry.llm.validity import invalid_rates, judge, judge_files

GO = """// c
package m

import (
	"log"
	f "fmt"
)

type T[K comparable] struct {
	A, B int `tag`
	*Base
	m map[string][]*T
}

type I interface {
	F(a int, b ...string) (x int, err error)
	~int | ~string
}

const (
	X = iota + 1
	Y
)

var v, w = []int{1, 2}, map[string]struct{}{"a": {}}

func (t *T[K]) F(a, b int, c func(int) error) (int, error) {
	for i := 0; i < 3; i++ {
		a += i << 2
	}
	for _, x := range v {
		go func() { f.Println(x, T{A: 1}.A) }()
	}
	for {
		break
	}
	if err := c(1); err != nil {
		return 0, err
	} else if a == '{' || *t.p >= 0x1F {
		defer t.Unlock()
	}
	switch y := w.(type) {
	case int, *T:
		a = y.(int)
	default:
	}
	select {
	case x := <-ch:
		ch <- x
	}
label:
	s := v[1:len(v)]
	goto label
	return -a, nil
}
"""
CPP = """#pragma once
#include <vector>
#ifdef X
#define F(x) ((x) + 1)
#endif
namespace a::b {
template <typename T, int N = 3>
class A final : public B<T>, private C {
 public:
  explicit A(int x) : x_(x), y_{1} {}
  ~A() override = default;
  virtual int f(const std::vector<std::pair<int, T>>& v, int* p = nullptr) const = 0;
  bool operator==(const A& o) const { return x_ == o.x_ && y_ < 3; }
  static constexpr int k = 1'000;
 private:
  int x_ = 0, *y_;
};
enum class E : int { A = 1, B, };
struct S { int a; double b[3]; } s = {1, {2.0, 3.5f}};
using V = std::vector<int>;
typedef unsigned long size;
extern "C" { int g(void); }
static const char* t[] = {"a" "b", R"(c")", u8"d"};
auto h(int a, unsigned char b) -> int {
  for (int i = 0; i < 3; ++i) { a ^= b << i; }
  for (auto& x : v) x *= 2;
  while (a > 0) if (a == '{') --a; else break;
  do { a++; } while (a < 3);
  switch (a) { case 1: ++a; break; default: a = 0; }
  auto l = [&, a](int x) mutable { return x ? a : (int)b + static_cast<int>(b); };
  std::vector<int> w{1, 2};
  int* q = new int[3]; delete[] q;
  try { throw E::A; } catch (const std::exception& e) { goto end; }
  if (auto it = m.find(1); it != m.end()) { it->second(w)[0].z = sizeof(int); }
end:
  return a ? 1 : 0;
}
}  // namespace
int main(int argc, char** argv) { const auto [x, y] = f(); return 0; }
"""


def test_valid():
    assert grammar_go.valid(GO) and grammar_go.valid(GO.replace("\n", "\r\n"))
    assert grammar_cpp.valid(CPP) and grammar_cpp.valid(CPP.replace("\n", "\r\n"))
    assert grammar_python.valid("def f(a, /, *, b=1):\n    match a:\n        case 1: return (yield)\n")
    assert grammar_go.valid("package m;func f0(a,b int)int{if a>b{return a*78};return b+11};")


@pytest.mark.parametrize("cut", range(40, len(GO) - 3, 97))
def test_truncated_go(cut):
    assert not grammar_go.valid(GO[:cut]) or GO[:cut].count("{") == GO[:cut].count("}")


@pytest.mark.parametrize("old,new", [("if err := c(1); err", "if err := c(1) err"), ("X = iota + 1", "X = iota + ;"), ("defer t.Unlock()", "defer t.Unlock("), ("v[1:len(v)]", "v[1:len(v)"), ('"log"', '"log'), ("func (t", "def (t"), ("s := v", "<<<<<<< HEAD\ns := v")])
def test_broken_go(old, new):
    assert old in GO and not grammar_go.valid(GO.replace(old, new, 1))


@pytest.mark.parametrize("old,new", [("int x_ = 0, *y_;", "int x_ = 0, *y_"), ("a ^= b << i;", "a ^= b <<;"), ("};\nenum", "}\nenum class"), ("#endif", ""), ("return a ? 1 : 0;", "return a ? 1;"), ('"c', '"c'), ("auto l", "=======\n  auto l"), ("u8\"d\"", 'u8"d'), ("= {1, {2.0", "= {1, {2.0 3")])
def test_broken_cpp(old, new):
    if old == new:
        return
    assert old in CPP and not grammar_cpp.valid(CPP.replace(old, new, 1))


def test_broken_python():
    for bad in ("def f(\n", "if True\n    pass\n", 'print "x"\n', "x = foo(1, [2, 3)\n", "def f():\n    x = 1\n  \ty = 2\n", "<<<<<<< HEAD\nx = 1\n", "x = “a”\n"):
        assert not grammar_python.valid(bad)


def test_judge():
    assert judge(GO, "go") == (True, "go") and judge(GO, "python") == (False, "go") and judge(CPP, "go") == (False, "cpp")
    assert judge("def f(\n", "python") == (False, None) and judge("<<<", "markdown") == (True, "markdown")
    assert judge("", "cpp") == (True, "cpp") and judge(None, "cpp") == (None, None) and judge("x", None) == (None, None)


def test_operator_and_rates(spark):
    schema = "p string, r string, language string, content string, valid string"
    rows = [("a", "r", "go", GO, ""), ("b", "r", "go", CPP, ""), ("c", "r", "python", "def f(\n", ""), ("c", "r", "python", "def f(\n", ""), (None, None, "cpp", None, ""), ("d", "r", "x", "?", ""), ("e", "r", "python", "x = 1\n" * 50_000, "")]
    judged = judge_files(spark.createDataFrame(rows, schema), key=["p", "r", "language"], text="content", language="language")
    assert sorted(((r.p, r.verdict) for r in judged.collect()), key=str) == [("a", "valid"), ("b", "wrong_extension"), ("c", "corrupt"), ("c", "corrupt"), ("d", None), ("e", "valid"), (None, None)]
    rates = {r.language: (r.files, r.invalid, r.invalid_rate) for r in invalid_rates(judged, ["r", "language"]).collect()}
    assert rates == {"go": (2, 1, 0.5), "python": (3, 2, 2 / 3)}
    assert judge_files(spark.createDataFrame([], schema), key=["p"], text="content", language="language").count() == 0


def test_macros_around_declarations():
    text = 'MY_BEGIN_DECLS\nMY_API_FUNC(int) my_call(MY_TYPE *a, int b) MY_NOTHROW;\nextern MY_API int x;\nclass MY_EXPORT A {\n public:\n  MY_DISALLOW_COPY(A);\n  int f() MY_CONST_CALL { return MAX_SIZE + 1; }\n};\nMY_END_DECLS\n'
    assert grammar_cpp.valid(text)
    assert not grammar_cpp.valid(text.replace("return MAX_SIZE + 1;", "return MAX_SIZE + ;")) and not grammar_cpp.valid(text.replace("int b)", "int b"))
    assert not grammar_cpp.valid("int f() {\n  const std::string API_TOKEN = \n}\n")


def test_every_grammar_is_tried(spark):
    both = "x = (1);\n"
    rows = [("a", "python", both), ("b", "cpp", "int x = (1);\n"), ("c", "markdown", GO), ("d", "markdown", "# Title\n\nplain prose, nothing else\n"), ("e", None, GO), ("f", "go", " \n")]
    got = {r.p: r for r in judge_files(spark.createDataFrame(rows, "p string, language string, content string"), key=["p"], text="content", language="language").collect()}
    assert got["a"].accepted_by == ["python"] and got["b"].accepted_by == ["cpp"] and got["f"].accepted_by == [] and got["f"].verdict == "valid"
    assert (got["c"].valid, got["c"].verdict, got["c"].parses_as) == (True, "wrong_extension", "go") and got["d"].verdict == "valid" and got["e"].accepted_by == ["go"]


@pytest.mark.parametrize("tail, ok", [("", True), ("int g( {\n", False), ("int h() { return 1 + ; }\n", False), ("@", False)])
def test_errors_far_behind_the_start(tail, ok):
    assert grammar_cpp.valid("int f(int a) { return a + 1; }\n" * 400 + tail) == ok


@pytest.mark.parametrize(
    "text",
    [
        "int f(int v, int m) {\n  if (v < 0 || v > 0x3F) return 1;\n  return v < 0 || v > m;\n}\n",
        "void f() { auto g = [=](int a) { return a; }; auto h = [=, &x] { return 1; }; }\n",
        "void (*get(const S *s))(int);\ntypedef int fn(int a);\nstruct { int a; } __attribute__((packed)) hdr;\n",
        "struct A { using B = const long long int; friend C; bool operator!=(A o) { return !operator==(o); } };\n",
        'typedef struct st *MY_TYPE;\nDECLARE_SET(MY_TYPE)\nDECLARE_MAP(MY_TYPE, int)\ntypedef struct { MY_TYPE A, B; } MY_PAIR;\nMY_API const MY_PAIR *get(const MY_PAIR *p) MY_PURE;\nMY_LIST(MY_PAIR) *(*fn)(void *db);\nextern const MY_PAIR MY_NULL;\nconst char *s = "a" FMT_LONG "b";\nint x = 1 + \\\n  2;\n',
    ],
)
def test_further_forms_of_cpp(text):
    assert grammar_cpp.valid(text)


@pytest.mark.parametrize("bad", ["int f() { return 1 }\n", "int x = ;\n", "int a b c;\n", "typedef int\n", "MY_API int f(MY_TYPE *a {\n", "DECLARE_SET(A_B\nint x;\n", "void f() { auto g = [=(int a) { return a; }; }\n", "MY_TYPE x = MY_NULL +;\n"])
def test_broken_forms_of_cpp(bad):
    assert not grammar_cpp.valid(bad)

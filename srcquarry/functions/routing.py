"""Which language reads a file, and which files are skipped."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Language(NamedTuple):
    name: str
    extensions: tuple[str, ...]
    skip_dirs: tuple[str, ...]
    skip_names: tuple[str, ...]


# File suffixes, skipped directories and skipped file names of each language, in the order of routing.
LANGUAGES = (
    Language(
        "cpp",
        tuple("cpp cc cxx c h hpp hxx hh inl ipp".split()),
        tuple(
            "test tests testing unittest unittests unit_test unit_tests gtest gmock mock mocks benchmark benchmarks example examples sample samples "
            "demo demos doc docs documentation third_party thirdparty 3rdparty external vendor deps boost build cmake-build cmake-build-debug "
            "cmake-build-release out output bin lib obj .git .svn .hg __pycache__ node_modules".split()
        ),
        (
            r"_test\.(?:cpp|cc|cxx|c|h|hpp)$",
            r"_unittest\.(?:cpp|cc|cxx|c|h|hpp)$",
            r"test_.*\.(?:cpp|cc|cxx|c|h|hpp)$",
            r"_mock\.(?:cpp|cc|cxx|c|h|hpp)$",
            r"_benchmark\.(?:cpp|cc|cxx|c|h|hpp)$",
            r"_example\.(?:cpp|cc|cxx|c|h|hpp)$",
        ),
    ),
    Language(
        "python",
        ("py",),
        tuple(
            "test tests testing unittest unittests unit_test unit_tests benchmark benchmarks example examples sample samples demo demos doc docs "
            "documentation third_party thirdparty 3rdparty external vendor deps build dist out output .git .svn .hg __pycache__ .pytest_cache "
            ".mypy_cache .tox .venv venv node_modules".split()
        ),
        (r"test_.*\.py$", r"_test\.py$", r"_benchmark\.py$", r"_example\.py$"),
    ),
    Language(
        "go",
        ("go",),
        tuple(
            "test tests testing unittest unittests unit_test unit_tests benchmark benchmarks example examples sample samples demo demos doc docs "
            "documentation third_party thirdparty 3rdparty external vendor deps build dist out output .git .svn .hg __pycache__ node_modules".split()
        ),
        (r"_test\.go$", r"_benchmark\.go$", r"_example\.go$"),
    ),
    Language(
        "markdown",
        tuple("md markdown mdown mkd mdx".split()),
        tuple(
            ".git .svn .hg .pytest_cache .mypy_cache .tox .venv venv __pycache__ node_modules bower_components third_party thirdparty 3rdparty "
            "external vendor deps build dist out output target bazel-bin bazel-out _build site .docusaurus .next .nuxt".split()
        ),
        (r"\.generated\.md$",),
    ),
)
#: Directories never walked into outside version control.
WALK_SKIP = tuple(".git .svn .hg .venv venv __pycache__ node_modules vendor third_party build dist".split())


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def skipped(path: Column, language: Language, *, skip_dirs: tuple[str, ...] | None = None, skip_names: tuple[str, ...] | None = None) -> Column:
    """Whether a language leaves a file alone: other suffix, a skipped directory, or a skipped name.

    Patterns may match anywhere in the file name, and case does not matter. Custom sets replace the
    language's; an empty set skips nothing.
    """
    dirs = language.skip_dirs if skip_dirs is None else skip_dirs
    names = language.skip_names if skip_names is None else skip_names
    parts = F.transform(F.split(path, "/"), F.lower)
    out = ~suffix(path).isin(*language.extensions)
    if dirs:
        out = out | F.arrays_overlap(parts, F.array(*[F.lit(d) for d in dirs]))
    if names:
        out = out | F.element_at(F.split(path, "/"), -1).rlike("(?i)" + "|".join(f"(?:{n})" for n in names))
    return out


def route_language(path: Column) -> Column:
    """The first language that does not skip the file, or null."""
    out = F.when(~skipped(path, LANGUAGES[0]), LANGUAGES[0].name)
    for language in LANGUAGES[1:]:
        out = out.when(~skipped(path, language), language.name)
    return out

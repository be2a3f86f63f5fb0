from pyspark.sql import functions as F

from srcquarry.operators.markdown import clean_title, headings, numbered_lines, sections


def heads(spark, text):
    df = spark.createDataFrame([("f", text)], "k string, t string")
    return [(r.line_no, r.level, r.title) for r in headings(numbered_lines(df, key="k", text="t"), key="k").orderBy("line_no").collect()]


def test_fences(spark):
    assert heads(spark, "```\n~~~\n# fake\n```\n# real\n") == [(5, 1, "real")]
    assert heads(spark, "````\n```\n# fake\n````\n# real\n") == [(5, 1, "real")]
    assert heads(spark, "# a\n~~~ info `x`\n# no\n") == [(1, 1, "a")]
    assert heads(spark, "``` a`b\n# yes\n") == [(2, 1, "yes")]


def test_forms(spark):
    assert heads(spark, "Title\n===\nSub\r\n---\r\n\n---\n####### no\n## a  **b** ##\n## ##\n") == [(1, 1, "Title"), (3, 2, "Sub"), (8, 2, "a **b"), (9, 2, "#")]


def test_sections_and_paths(spark):
    df = spark.createDataFrame([("p/x.md", "pre\n# A\nx\n### C\n## B\n"), ("y.md", "no heading"), ("z.md", " \n")], "k string, t string")
    got = sections(df, key="k", text="t", name=F.element_at(F.split("k", "/"), -1)).orderBy("k", "start_line").collect()
    assert [(r.k, r.start_line, r.end_line, r.level, r.heading_path) for r in got] == [
        ("p/x.md", 1, 1, 0, "x.md"), ("p/x.md", 2, 3, 1, "A"), ("p/x.md", 4, 4, 3, "A > C"), ("p/x.md", 5, 5, 2, "A > B"), ("y.md", 1, 1, 0, "y.md"),
    ]
    assert got[1].body == "# A\nx\n"


def test_title(spark):
    df = spark.createDataFrame([(" `a`   b_ ",), ("**",)], "t string")
    assert [r[0] for r in df.select(clean_title(F.col("t"))).collect()] == ["a`   b".replace("   ", " "), "<untitled>"]

"""Building, updating, planning and searching an index of a small repository."""

import json
import os
import subprocess

import pytest

from srcquarry.plans import index, store
from srcquarry.sources.repository import safe_source, source_paths


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "readme.md").write_text("# title\noriginal\n")
    (root / "__init__.py").write_text("")
    (root / "a.py").write_text("import os\nMARKER = 1\n\n# why\ndef f():\n    return os\n")
    return root


def test_discovery(tmp_path):
    root = tmp_path / "r"
    (root / "vendor").mkdir(parents=True)
    (root / "vendor" / "x.py").write_text("x")
    (root / "_a.py").write_text("")
    (root / "big.py").write_text("x" * (1024 * 1024 + 1))
    (root / "real").mkdir()
    (root / "real" / "code.py").write_text("y")
    os.symlink(root / "real", root / "link")
    assert list(source_paths(str(root))) == ["_a.py", os.path.join("real", "code.py")]
    assert not safe_source(str(root), str(root / "link" / "code.py")) and not safe_source(str(root), str(tmp_path / "o.py"))
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / ".gitignore").write_text("real/\n")
    assert list(source_paths(str(root))) == [".gitignore", "_a.py", os.path.join("vendor", "x.py")]


def test_build_cycle(spark, repo, tmp_path):
    db = str(tmp_path / "db")
    assert index.plan(spark, str(repo), db)["status"] == "first_build" and not os.path.exists(db)
    first = index.build(spark, str(repo), db)
    assert first["mode"] == "full" and first["parsed_files"] == 3
    assert index.build(spark, str(repo), db)["mode"] == "skip"
    assert not os.path.exists(os.path.join(db, store.PENDING))
    (repo / "other.md").write_text("# other\nmore words here\n")
    (repo / "a.py").write_text("def g():\n    return 2\n")
    plan = index.plan(spark, str(repo), db)
    assert dict(map(tuple, plan["changed_files"].select("relative_path", "change").collect())) == {"other.md": "A", "a.py": "M"} and plan["changes"] == {"A": 1, "M": 1} and plan["recommended_mode"] == "incremental"
    second = index.build(spark, str(repo), db)
    assert (second["parsed_files"], second["reused_files"]) == (2, 2)
    (repo / "other.md").unlink()
    assert index.build(spark, str(repo), db)["deleted_files"] == 1
    hits = index.query(spark, db, "title original", k=3).collect()
    assert hits[0]["relative_path"] == "readme.md" and hits[0]["source_text"] == "# title\noriginal\n"
    assert index.query(spark, db, "title", path="absent").collect() == [] and index.query(spark, db, "...").collect() == []
    assert all("a.py" in h["file_path"] for h in index.query(spark, db, "return", path="a.py").collect())


def test_failure_keeps_the_active_generation(spark, repo, tmp_path):
    db = str(tmp_path / "db")
    index.build(spark, str(repo), db)
    before = json.load(open(os.path.join(db, store.ACTIVE)))
    (repo / "a.py").write_text("def broken(\n")
    with pytest.raises(Exception, match="syntax error"):
        index.build(spark, str(repo), db)
    assert json.load(open(os.path.join(db, store.ACTIVE))) == before
    with pytest.raises(ValueError, match="full build"):
        index.build(spark, str(repo), db, max_tokens=128)


def test_guards(spark, repo, tmp_path):
    db = str(tmp_path / "db")
    with pytest.raises(ValueError):
        index.build(spark, str(repo), str(repo / "db"))
    for text, k in (("valid", 0), (" ", 5), ("valid", -1), ("x" * 300, 1)):
        with pytest.raises(ValueError):
            index.query(spark, db, text, k=k)
    os.makedirs(db)
    with store.operation_lock(db, create=True), pytest.raises(RuntimeError, match="busy"), store.operation_lock(db, create=True):
        pass
    with open(os.path.join(db, store.ACTIVE), "w") as f:
        f.write("{broken")
    with pytest.raises(json.JSONDecodeError):
        store.active_index(db)


def test_query_guards_and_output(spark, repo, tmp_path, capsys):
    from srcquarry import cli
    from srcquarry.plans.render import hits_as_json, hits_as_text

    db = str(tmp_path / "db")
    index.build(spark, str(repo), db)
    for other in ({"max_tokens": 128}, {"embedding": "other"}, {"tokenizer": "/opt/tokenizers/byte_bpe_50k.json"}):
        with pytest.raises(RuntimeError, match="another chunker or embedding"):
            index.query(spark, db, "title", **other)
    hits = index.query(spark, db, "title original", k=2)
    page = hits_as_text(hits, "title original")
    assert page.startswith("## 2 results") and "```markdown\n# title\noriginal\n" in page and "- Score: 0." in page
    first = json.loads(hits_as_json(hits))[0]
    assert first["code"] == "# title\noriginal\n" and first["language"] == "markdown" and first["char_offset_scope"] == "body"
    assert hits_as_text(index.query(spark, db, "title", path="absent"), "title") == "Nothing found for 'title'."
    for form in ("text", "json"):
        assert cli.main(["query", "--repo", str(repo), "--db", db, "--query", "title", "--format", form]) == 0
    assert cli.main(["plan", "--repo", str(repo), "--db", db]) == 0 and "no_changes" in capsys.readouterr().out


def test_token_budget(spark, repo, tmp_path):
    db, tokenizer = str(tmp_path / "db"), "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(tokenizer):
        pytest.skip("no tokenizer files here")
    (repo / "long.md").write_text("# long\n" + "many words in a row " * 400)
    index.build(spark, str(repo), db, max_tokens=64, tokenizer=tokenizer)
    rows = index.query(spark, db, "many words in a row", k=50, max_tokens=64, tokenizer=tokenizer).collect()
    assert max(r.token_count for r in rows) <= 64 and sum(r.relative_path == "long.md" for r in rows) > 20
    assert max(len(r.source_text) for r in rows) > 128  # tokens, not characters
    with pytest.raises(ValueError, match="budget"):
        index.query(spark, db, "many words " * 60, max_tokens=64, tokenizer=tokenizer)
    with pytest.raises(ValueError, match="full build"):
        index.build(spark, str(repo), db, max_tokens=64)


def test_other_data_needs_a_full_build(spark, repo, tmp_path):
    db = tmp_path / "db"
    db.mkdir()
    (db / "old.sqlite3").write_text("x")
    (db / store.LOCK).write_text("")
    assert index.plan(spark, str(repo), str(db))["status"] == "migration_required"
    with pytest.raises(ValueError, match="full build"):
        index.build(spark, str(repo), str(db))
    assert index.build(spark, str(repo), str(db), full=True)["mode"] == "full" and index.plan(spark, str(repo), str(db))["status"] == "no_changes"


def test_rows_of_reused_files_are_checked(spark, repo, tmp_path):
    db = str(tmp_path / "db")
    built = index.build(spark, str(repo), db)
    rows, files = index._tables(db, built["collection_name"])
    moved = spark.createDataFrame([("readme.md", 0), ("a.py", 9), ("__init__.py", 0)], "relative_path string, chunks long")
    spark.read.parquet(files).drop("chunks").join(moved, "relative_path").write.parquet(str(tmp_path / "files"))
    os.rename(files, str(tmp_path / "before"))
    os.rename(str(tmp_path / "files"), files)
    (repo / "new.md").write_text("# new\n")
    with pytest.raises(RuntimeError, match="unchanged file"):
        index.build(spark, str(repo), db)


def test_failing_version_control_is_an_error(tmp_path):
    (tmp_path / ".git").write_text("gitdir: /nowhere")
    with pytest.raises(subprocess.CalledProcessError):
        source_paths(str(tmp_path))

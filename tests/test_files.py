import difflib
import io
import os
import tarfile
import zipfile

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from conftest import values
from runledger.functions import columns as c
from runledger.functions.fixed_values import LAYOUTS
from runledger.operators import cards, catalog, diffs, mining, retention
from runledger.sources import filetree, tables, texts


@pytest.fixture
def tree(tmp_path):
    """A project with hidden names, caches, copies and an empty folder."""
    for path, content in {
        "data/train.csv": "a,b\n1,2\n", "data/copy.CSV": "a,b\n1,2\n", "models/m.pt": "x" * 2000, "models/m2.pt": "x" * 2000,
        "models/other.pt": "y" * 2000, ".hidden": "h", "src/__pycache__/a.pyc": "c", "src/__pycache__/note.txt": "n",
        "src/main.py": "import os\n", "logs/run.log": "short", "logs/.DS_Store": "s", "noext": "", "train.pipeline.yaml": "stages: {}\n",
    }.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    (tmp_path / "empty/deeper").mkdir(parents=True)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe ok")
    (tmp_path / "link").symlink_to(tmp_path / "nowhere")
    return tmp_path


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_file_catalog_sees_what_a_walk_sees(spark, tree, partitions):
    got = filetree.file_catalog(spark, str(tree), partitions)
    expected = sorted((os.path.relpath(p, tree), p.is_dir(), p.stat().st_size) for p in tree.rglob("*") if p.exists())
    assert values(got, "path", "is_dir", "size") == expected
    one = got.filter("path = 'models/m.pt'").first()
    assert (one["name"], one["ext"], one["permissions"]) == ("m.pt", ".pt", oct(os.stat(tree / "models/m.pt").st_mode & 0o777))


def test_missing_root(spark, tmp_path):
    with pytest.raises(Exception, match="directory not found"):
        filetree.file_catalog(spark, str(tmp_path / "none")).count()


def test_contents_and_duplicates(spark, tree):
    listed = filetree.file_catalog(spark, f"file://{tree}", 4)
    candidates = catalog.same_size_files(listed, 1024)
    assert values(candidates, "path") == [("models/m.pt",), ("models/m2.pt",), ("models/other.pt",)]
    loaded = filetree.file_contents(candidates, str(tree))
    group = catalog.duplicate_groups(loaded).collect()
    assert [(r["n"], r["size"], r["first_path"]) for r in group] == [(2, 2000, "models/m.pt")]
    assert values(catalog.duplicate_members(loaded), "path") == [("models/m.pt",), ("models/m2.pt",)]
    readable = filetree.text_contents(filetree.file_contents(listed, str(tree)))
    assert "bad.txt" not in {r["path"] for r in readable.collect()}


def test_listing_and_search(spark, tree):
    listed = filetree.file_catalog(spark, str(tree), 4)
    assert values(catalog.list_files(listed, "*")) == sorted((p.name,) for p in tree.iterdir() if p.exists())
    assert values(catalog.list_files(listed, "*.pt", recursive=True)) == [("models/m.pt",), ("models/m2.pt",), ("models/other.pt",)]
    assert values(catalog.search_files(listed, "*", ".CSV", 8, 8)) == [("data/copy.CSV", 8), ("data/train.csv", 8)]
    assert catalog.search_files(listed, "*", ".csv", 9).isEmpty()
    assert values(catalog.list_pipelines(listed)) == [("train.pipeline.yaml",)]
    assert values(catalog.find_dataset_files(listed), "path") == [("data/copy.CSV",), ("data/train.csv",)]
    summary = {r["extension"]: (r["file_count"], r["total_bytes"], r["directory_count"]) for r in catalog.directory_summary(listed).collect()}
    files = [p for p in tree.rglob("*") if p.is_file()]
    assert summary[None] == (len(files), sum(p.stat().st_size for p in files), sum(p.is_dir() for p in tree.rglob("*")))
    assert summary[".csv"][:2] == (2, 16) and summary["<no_ext>"][0] == 3


@pytest.mark.parametrize("pattern,name,fits", [
    ("*", "x", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[!a-c]x", "dx", True),
    ("*.p[yt]", "m.pt", True), ("a.c", "abc", False), ("[", "[", True), ("x$(1)", "x$(1)", True), ("[]]", "]", True)])
def test_globs(make, pattern, name, fits):
    assert make([(name,)], "n string").select(F.col("n").rlike(c.glob_to_regex(pattern))).first()[0] is fits


@pytest.mark.parametrize("name,ext", [("a.CSV", ".csv"), (".bashrc", ""), ("x.", ""), ("a.tar.gz", ".gz"), ("plain", ""), ("a.b\n.c", ".c")])
def test_suffix(make, name, ext):
    assert make([(name,)], "n string").select(c.suffix(F.col("n"))).first()[0] == ext


@pytest.mark.parametrize("ext,category,framework,artifact", [
    (".feather", "dataset", "unknown", "dataset"), (".ckpt", "model", "pytorch", "model"), (".ipynb", "notebook", "unknown", "artifact"),
    (".ini", "config", "unknown", "artifact"), (".bash", "script", "unknown", "artifact"), (".rst", "doc", "unknown", "artifact"),
    (".webp", "image", "unknown", "artifact"), (".out", "log", "unknown", "artifact"), (".pb", "other", "tensorflow", "artifact"),
    (".joblib", "model", "sklearn", "model"), (".txt", "doc", "unknown", "text"), ("", "other", "unknown", "artifact")])
def test_suffix_tables(make, ext, category, framework, artifact):
    col = F.col("e")
    assert tuple(make([(ext,)], "e string").select(c.category(col), c.framework(col), c.artifact_type(col)).first()) == (
        category, framework, artifact)


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc\n\n", "x\u2028y\u0085z\x0bq\x0c", "\n", "a\x1cb\x1d\x1e"])
def test_lines_like_python(make, text):
    assert make([(text,)], "t string").select(c.lines_of(F.col("t"))).first()[0] == text.splitlines()


def test_search_content(make):
    df = make([("b.log", "b.log", "line1\nERROR something failed\nline3"), ("a.txt", "a.txt", "match\n" * 50)], "path string, name string, content string")
    assert [tuple(r) for r in catalog.search_content(df, "error").collect()] == [("b.log", 2, "ERROR something failed", False)]
    assert catalog.search_content(df, "error", case_sensitive=True).isEmpty()
    assert catalog.search_content(df, r"^err\w+ .*ed$", is_regex=True).count() == 1
    cut = catalog.search_content(df, "match", max_matches=10).collect()
    assert len(cut) == 10 and all(r["truncated"] for r in cut) and cut[-1]["line"] == 10
    assert all(r["truncated"] for r in catalog.search_content(df, "match", max_matches=50).collect())
    assert catalog.search_content(df, "match", file_pattern="*.log").isEmpty()


def test_history(make):
    audit = make([(i, f"op{i}") for i in range(1200)], "seq bigint, operation string")
    assert [r["seq"] for r in catalog.operation_history(audit, 3).collect()] == [1197, 1198, 1199]
    assert catalog.operation_history(audit, 5000).count() == 1200 and catalog.operation_history(audit, 0).isEmpty()
    assert catalog.operation_history(audit, None).count() == 1200
    with pytest.raises(ValueError):
        catalog.operation_history(audit, -1)


def test_batch_classify_and_discovery(make):
    files = make([("a.csv", "a.csv", ".csv", False), ("d", "d", "", True), ("m.onnx", "m.onnx", ".onnx", False)], "path string, name string, ext string, is_dir boolean")
    good, bad = catalog.batch_classify(files, make([("a.csv",), ("d",), ("gone",)], "path string"))
    assert values(good) == [("a.csv", ".csv", "dataset")]
    assert values(bad) == [("d", "path is not a file"), ("gone", "file not found")]
    registry = make([("net", "prod")], "name string, current_stage string")
    assert values(catalog.discover_models(registry, files)) == [("registry", "net", "prod")]
    assert values(catalog.discover_models(registry.limit(0), files)) == [("filesystem", "m.onnx", ".onnx")]


def test_notebook(make):
    text = """{"cells": [{"cell_type": "markdown", "source": "t"}, {"cell_type": "code", "execution_count": 1},
      {"cell_type": "code", "execution_count": 2}, {"cell_type": "code", "execution_count": null}]}"""
    df = make([("n", text), ("empty", '{"cells": []}'), ("broken", "{")], "path string, content string")
    assert values(catalog.notebook_summary(df)) == [("broken", 0, 0, 0, None), ("empty", 0, 0, 0, None), ("n", 4, 3, 1, 2)]


def test_tree_diff(make):
    a = make([("same", "x"), ("changed", "1"), ("left", "")], "path string, content string")
    b = make([("same", "x"), ("changed", "2"), ("right", "")], "path string, content string")
    assert values(diffs.tree_diff(a, b)) == [("changed", "different_content"), ("left", "only_in_a"), ("right", "only_in_b")]


def test_text_diff_and_line_delta(make):
    pairs = [("1", "a", "b", "x\ny\n", "x\nz\n++q\n"), ("2", "a", "b", "same", "same"), ("3", "a", "b", "x", "x\n"), ("4", "a", "b", "u\nu\nv", "v\nu")]
    df = make(pairs, "key string, name_a string, name_b string, text_a string, text_b string")
    got = {r["key"]: r for r in diffs.text_diff(df).collect()}
    for key, name_a, name_b, text_a, text_b in pairs:
        lines = list(difflib.unified_diff(text_a.splitlines(), text_b.splitlines(), name_a, name_b, lineterm=""))
        assert list(got[key]["diff_lines"]) == lines and got[key]["identical"] is (not lines)
    assert (got["1"]["added"], got["1"]["removed"]) == (1, 1)         # "++q" shows up as "+++q": listed, not counted
    assert values(diffs.line_delta_counts(df)) == [("1", 2, 1), ("4", 0, 1)]


def test_requirements_diff(make):
    files = make([("base", "requests==2.28.0\n# c\n\nNumPy==1.0\nold\nrequests == 2.28.1\n"), ("target", "requests==2.31.0\nnumpy==1.0\nflask")],
                 "file string, content string")
    parsed = diffs.parse_requirements(files)
    base, target = (parsed.filter(F.col("file") == f) for f in ("base", "target"))
    assert values(diffs.compare_requirements(base, target)) == [
        ("flask", "added", None, None), ("old", "removed", None, None), ("requests", "version_changed", "2.28.1", "2.31.0")]


def test_layouts(make):
    entries = [("p", d, True) for d in LAYOUTS["nlp"]["dirs"] if d != "models"] + [("p", f, False) for f in LAYOUTS["nlp"]["files"]] + [("p", "models", False)]
    tree = make(entries, "project string, path string, is_dir boolean")
    assert values(diffs.layout_check(tree, make([("p", "nlp")], "project string, template string"))) == [("p", "nlp", "models", True)]
    with pytest.raises(ValueError, match="unknown template"):
        diffs.layout_check(tree, make([("p", "nope")], "project string, template string"))


def test_required_keys(make):
    needed = diffs.parse_keys(make([("s", "A=\nB=1\n # x\n\nC\nD=\n")], "file string, content string")).withColumnRenamed("file", "scope")
    provided = make([("s", "A", 1, "v"), ("s", "B", 0, ""), ("s", "B", 1, "v"), ("s", "C", 1, ""), ("other", "D", 0, "v")],
                    "scope string, key string, priority int, value string")
    assert values(diffs.required_keys(needed, provided)) == [("s", "B"), ("s", "C"), ("s", "D")]


def test_read_write_tables(spark, make, tmp_path):
    df = make([(1, 'say "hi", ok', 1.5), (2, None, 2.0)], "a int, s string, x double")
    for kind in (".csv", ".parquet"):
        tables.write_table(df, str(tmp_path / f"out{kind}"))
        assert values(tables.read_table(spark, str(tmp_path / f"out{kind}"))) == values(df)
    with pytest.raises(ValueError, match="must end with"):
        tables.write_table(df, str(tmp_path / "out.json"))
    with pytest.raises(ValueError, match="can't read dataset type: .xlsx"):
        tables.read_table(spark, "a.xlsx")
    (tmp_path / "t.tsv").write_text("name\tscore\na\t1.5\n")
    (tmp_path / "j.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "odd.csv").write_text("NSE_EQ|INE585B01010,b.c\n1,2\n")
    assert values(tables.read_table(spark, str(tmp_path / "t.tsv"))) == [("a", 1.5)]
    assert values(tables.read_table(spark, str(tmp_path / "j.json"))) == values(tables.read_table(spark, str(tmp_path / "j.jsonl"))) == [(1,), (2,)]
    assert tables.read_table(spark, str(tmp_path / "odd.csv")).columns == ["NSE_EQ|INE585B01010", "b.c"]
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n')
    assert values(tables.read_table(spark, str(tmp_path / "q.csv"), quoted_breaks=True)) == [(1, "x\ny")]
    tables.export_csv(df, str(tmp_path / "one.csv"))
    assert len(list((tmp_path / "one.csv").glob("part-*"))) == 1


def test_feather(spark, tmp_path):
    for i in range(3):
        feather.write_feather(pa.table({"a": [i, None], "s": [f"v{i}", "w"], "x": [[1.0], []]}), str(tmp_path / f"f{i}.feather"))
    got = tables.read_table(spark, str(tmp_path / "*.feather"))
    assert got.dtypes == [("a", "bigint"), ("s", "string"), ("x", "array<double>")]
    assert got.count() == 6 and values(got.filter("a IS NOT NULL"), "a", "s") == [(0, "v0"), (1, "v1"), (2, "v2")]
    assert tables.read_table(spark, str(tmp_path / "f0.feather"), "s string").columns == ["s"]


def test_mining(make):
    sources = make([("a.py", "import os, numpy.linalg\nfrom .rel import y\nfrom . import z\nif True:\n    import pandas as pd\n"), ("bad.py", "def ("),
                    ("f.py", 'def predict(x, y=1, *a) -> list[int]:\n    "Doc."\nasync def no(): pass\nclass C:\n    def m(self): pass\n')], "path string, content string")
    parsed = mining.parse_imports(sources)
    modules = mining.scan_imports(parsed)
    assert values(modules) == [("numpy",), ("pandas",), ("rel",)]
    assert values(mining.import_errors(parsed), "path") == [("bad.py",)]
    packages = make([("numpy", "NumPy", "2.0"), ("numpy", "numpy-mkl", "1.0"), ("pandas", "pandas", None)], "module string, dist string, version string")
    assert [r[0] for r in mining.requirements(modules, packages, True).collect()] == ["NumPy==2.0", "pandas", "rel"]
    assert values(mining.api_index(sources)) == [("f.py", "predict", ["x", "y"], "list[int]", "Doc.")]
    lines = {(r["section"], r["item"]): r["line"] for r in cards.api_docs(mining.api_index(sources), "src").collect()}
    assert lines[(1, "f.py/predict/2")] == "- Args: ['x', 'y']" and lines[(1, "f.py/predict/4")] == "- Doc: Doc."


def test_archives(make):
    def zipped(names):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as handle:
            for name in names:
                handle.writestr(name, "x")
        return buffer.getvalue()

    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as handle:
        handle.addfile(tarfile.TarInfo("in/side.txt"), io.BytesIO())
    archives = make([("a.zip", zipped(["ok.txt", "../escape.txt", "x/../../../up", "/abs", "a/../b"])), ("b.tgz", buffer.getvalue()), ("c.bin", b"junk")],
                    "path string, content binary")
    got = {(r["archive"], r["entry"]): (r["archive_type"], r["unsafe"], r["error"]) for r in mining.archive_entries(archives).collect()}
    assert [got[("a.zip", n)][1] for n in ("ok.txt", "../escape.txt", "x/../../../up", "/abs", "a/../b")] == [False, True, True, True, False]
    assert got[("b.tgz", "in/side.txt")] == ("tar", False, None) and got[("c.bin", None)][2] == "unsupported archive type"


def test_stage_files(make):
    files = make([("ok", "stages:\n  prep: {cmd: run, outs: [data.csv]}\n  train:\n    deps: [data.csv]\n  odd: 3\n"), ("none", "a: 1"), ("broken", "stages: [")],
                 "path string, content string")
    got = texts.read_pipelines(files)
    assert values(got.filter("error IS NULL"), "pipeline", "ord", "stage", "cmd", "deps", "outs") == [
        ("ok", 0, "prep", "run", [], ["data.csv"]), ("ok", 1, "train", None, ["data.csv"], [])]
    assert values(got.filter("error IS NOT NULL"), "pipeline", "stage") == [("broken", None), ("ok", "odd")]


def test_project_retention(spark, tree):
    (tree / "old/sub").mkdir(parents=True)
    (tree / "old/sub/x.tmp").write_text("t")
    listed = filetree.file_catalog(spark, str(tree), 4)
    got = {r["path"]: r["rule"] for r in retention.retention_project(listed).collect()}
    assert got == {"src/__pycache__": "directory", "src/__pycache__/a.pyc": "file", "src/__pycache__/note.txt": "inside_directory",
                   "logs/run.log": "file", "logs/.DS_Store": "file", "logs": "empty_directory", "empty": "empty_directory",
                   "empty/deeper": "empty_directory", "old": "empty_directory", "old/sub": "empty_directory", "old/sub/x.tmp": "file"}
    plain = {r["path"] for r in retention.retention_project(listed, simulate=False).collect()}
    assert "logs" not in plain and "empty/deeper" in plain and "empty" not in plain


def test_checkpoint_and_log_retention(make):
    files = make([("r", f"{n}.ckpt", f"{n}.ckpt", ".ckpt", False, 1000 + i, 10) for i, n in enumerate("abcd")] +
                 [("r", "z.ckpt", "z.ckpt", ".ckpt", False, 1002, 10), ("r", "note.txt", "note.txt", ".txt", False, 9999, 1),
                  ("s", "one.pt", "one.pt", ".pt", False, 5, 1)], "root string, path string, name string, ext string, is_dir boolean, mtime int, size bigint")
    got = {r["path"]: r["action"] for r in retention.retention_checkpoints(files, 2).collect()}
    assert got == {"d.ckpt": "keep", "c.ckpt": "keep", "z.ckpt": "remove", "b.ckpt": "remove", "a.ckpt": "remove", "one.pt": "keep"}
    assert {r["action"] for r in retention.retention_checkpoints(files, 0).collect()} == {"remove"}
    with pytest.raises(ValueError):
        retention.retention_checkpoints(files, -1)
    logs = make([("a.log", "a.log", False, 99), ("b.log", "b.log", False, 100), ("c.txt", "c.txt", False, 1)], "path string, name string, is_dir boolean, size bigint")
    assert values(retention.retention_logs(logs), "path", "action") == [("a.log", "remove"), ("b.log", "keep")]
    with pytest.raises(ValueError):
        retention.retention_logs(logs, -1)


def test_documents(spark, make, tmp_path):
    df = make([(2, "b"), (1, "a")], "id bigint, s string")
    lines = cards.dataset_card(df, "d", "d.csv", ["id"], 1)
    text = [r["line"] for r in lines.orderBy("section", "item").collect()]
    assert text[:6] == ["# DATASET_CARD", "", "- Name: d", "- Path: d.csv", "- Rows: 2", "- Columns: 2"]
    assert text[-3:] == ["", "## Sample Rows", '{"id":1,"s":"a"}'] and "- s: 0" in text and "- id: bigint" in text
    written = cards.write_documents(lines, str(tmp_path / "docs")).first()
    parts = sorted((tmp_path / "docs").glob("doc=d/part-*"))
    content = "".join(p.read_text() for p in parts)
    assert content.splitlines() == text and written["bytes_written"] == len(content)
    assert cards.render(df, "{{ id }}-{{ s }}").orderBy("id").first()["text"] == "1-a"
    summary = make([("<no_ext>", 1, 5, 0), (None, 1, 5, 2)], "extension string, file_count bigint, total_bytes bigint, directory_count bigint")
    readme = [r["line"] for r in cards.project_readme(summary, make([], "module string"), "p").orderBy("section", "item").collect()]
    assert readme[-1] == "- None" and "- Total Size (bytes): 5" in readme

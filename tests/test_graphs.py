import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from conftest import values
from runledger.operators import lineage, stages

RECORDS = "seq bigint, output string, inputs array<string>, run_id string, ts bigint"
STAGES = "pipeline string, ord bigint, stage string, cmd string, deps array<string>, outs array<string>"


def reach(records, root):
    by_output = defaultdict(list)
    for _, output, inputs, _, _ in records:
        by_output[output] += inputs
    seen, queue = set(), deque([root])
    while queue:
        node = queue.popleft()
        if node not in seen:
            seen.add(node)
            queue.extend(by_output.get(node, []))
    return seen, {n for n in seen if n not in by_output}


@pytest.mark.parametrize("seed", range(3))
def test_provenance_on_random_graphs(make, seed):
    rng = random.Random(seed)
    records = [(i, f"n{rng.randint(0, 14)}", [f"n{rng.randint(0, 20)}" for _ in range(rng.randint(1, 3))], "r", i) for i in range(25)]
    roots = [f"n{i}" for i in range(0, 15, 2)] + ["ghost"]
    df, starts = make(records, RECORDS), make([(r,) for r in roots], "root string")
    assert values(lineage.ancestors(df, starts)) == sorted(((r, n) for r in roots for n in reach(records, r)[0]), key=repr)
    assert values(lineage.source_artifacts(df, starts)) == sorted(((r, n) for r in roots for n in reach(records, r)[1]), key=repr)
    expected = sorted((r, rec[0]) for r in roots for rec in records if rec[1] in reach(records, r)[0])
    assert values(lineage.provenance(df, starts), "root", "seq") == sorted(expected, key=repr)


def test_long_chains_and_shared_nodes(make):
    chain = make([(i, f"n{i}", [f"n{i + 1}"], "r", i) for i in range(12)], RECORDS)
    assert values(lineage.ancestors(chain, make([("n0",)], "root string"))) == sorted(("n0", f"n{i}") for i in range(13))
    # one node that every root is made from
    shared = make([(i, f"root{i}", ["hub"], "r", i) for i in range(500)] + [(600, "hub", ["a", "b"], "r", 1)], RECORDS)
    roots = make([(f"root{i}",) for i in range(500)], "root string")
    assert lineage.ancestors(shared, roots).groupBy("root").count().filter("count = 4").count() == 500


def test_lineage_details(make):
    records = make([(0, "features.parquet", ["raw.csv"], "r1", 10), (1, "model.pt", ["features.parquet", "cfg.yaml"], "r2", 20),
                    (2, "model.pt", ["features.parquet"], "r3", 30), (3, "x", ["raw.csv"], "r4", 40)], RECORDS)
    assert values(lineage.lineage_artifacts(records)) == [("cfg.yaml", "config", 20), ("features.parquet", "dataset", 10), ("model.pt", "model", 30),
                                                          ("raw.csv", "dataset", 10), ("x", "artifact", 40)]
    files = make([("features.parquet",), ("raw.csv",)], "path string")
    assert values(lineage.lineage_integrity(records, files)) == [("model.pt", "cfg.yaml", "r2")]
    lines = lineage.lineage_mermaid(records, make([("model.pt",), ("ghost.pt",)], "root string"))
    text = [r["line"] for r in lines.filter("root = 'model.pt'").orderBy("section", F.when(F.col("section") == 2, F.col("seq")), F.desc("item")).collect()]
    assert text[:5] == ["graph TD", "    raw.csv[raw.csv]", "    model.pt[model.pt]", "    features.parquet[features.parquet]", "    cfg.yaml[cfg.yaml]"]
    assert sorted(text[5:]) == sorted(["    raw.csv --> features.parquet", "    features.parquet --> model.pt", "    cfg.yaml --> model.pt", "    features.parquet --> model.pt"])
    assert [r["line"] for r in lines.filter("root = 'ghost.pt'").orderBy("section").collect()] == ["graph TD", "    ghost.pt[ghost.pt]"]
    batch = make([(0, " ", ["a"], "r", 1), (1, "o", [], "r", 1), (2, "o", ["a"], "", 1), (3, "o", ["a"], "r", 1), (4, None, None, None, 1)], RECORDS)
    assert [r["reason"] for r in lineage.record_lineage(batch).orderBy("seq").collect()] == [
        "output must not be empty", "inputs must not be empty", "run_id must not be empty", None, "output must not be empty"]


def cyclic(edges):
    nodes = {n for e in edges for n in e}
    degree = {n: sum(1 for e in edges if e[1] == n) for n in nodes}
    queue = [n for n in nodes if degree[n] == 0]
    done = 0
    while queue:
        node = queue.pop()
        done += 1
        for src, dst in edges:
            if src == node:
                degree[dst] -= 1
                if degree[dst] == 0:
                    queue.append(dst)
    return done != len(nodes)


def test_cycles_in_random_graphs(make):
    rng = random.Random(1)
    graphs = {f"p{k}": {(a, b) for a, b in ((f"s{rng.randint(0, 6)}", f"s{rng.randint(0, 6)}") for _ in range(rng.randint(1, 8))) if a != b} for k in range(40)}
    graphs["diamond"] = {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")}
    edges = make([(p, a, b) for p, g in graphs.items() for a, b in g], "pipeline string, src string, dst string")
    assert values(stages.has_cycle(edges)) == sorted(((p,) for p, g in graphs.items() if g and cyclic(g)), key=repr)


@pytest.fixture
def table(make):
    return make([("p", 0, "prep", "run", [], ["data.csv"]), ("p", 1, "train", "fit", ["data.csv", "ext"], ["model.pkl", "data.csv2"]),
                 ("p", 2, "redo", None, ["model.pkl", "own"], ["data.csv", "own"]), ("q", 0, "only", "", None, None)], STAGES)


def test_stage_edges_and_validation(make, table):
    # the last stage that lists data.csv produces it; a stage never feeds itself
    assert values(stages.stage_edges(table)) == [("p", "redo", "train"), ("p", "train", "redo")]
    files = make([("ext", 1), ("model.pkl", 1), ("own", 1)], "path string, mtime bigint")
    assert values(stages.validate_pipelines(table, files)) == sorted([
        ("p", "redo", "missing cmd", None), ("q", "only", "missing cmd", None), ("p", "train", "missing dependency", "data.csv"),
        ("p", None, "circular dependency detected", None)], key=repr)


def test_status(make):
    table = make([("p", 0, "fresh", "c", ["in"], ["out"]), ("p", 1, "stale", "c", ["new"], ["out"]), ("p", 2, "lost", "c", ["in"], ["out", "z", "a"]),
                  ("p", 3, "source", "c", [], ["out"]), ("p", 4, "sink", "c", ["gone"], []), ("p", 5, "equal", "c", ["out"], ["out"])], STAGES)
    files = make([("in", 10), ("out", 20), ("new", 30)], "path string, mtime bigint")
    got = {r["stage"]: (r["status"], r["reason"], r["missing_outputs"]) for r in stages.pipeline_status(table, files).collect()}
    fine = ("up-to-date", None, None)
    assert got == {"fresh": fine, "stale": ("stale", "deps_newer_than_outs", None), "lost": ("stale", "missing_outputs", "a,z"),
                   "source": fine, "sink": fine, "equal": fine}


def test_editing_stages(make, table):
    batch = make([("p", 3, "train", "x", [], []), ("p", 4, "new", "x", [], []), ("p", 5, "new", "x", [], [])], STAGES)
    assert values(stages.add_stage(batch, table), "stage", "ord", "reason") == [
        ("new", 4, None), ("new", 5, "stage already exists"), ("train", 3, "stage already exists")]
    removals = make([("p", "train"), ("p", "ghost"), ("q", "only")], "pipeline string, stage string")
    assert values(stages.remove_stage(table, removals), "pipeline", "removed", "found", "dependent") == [
        ("p", "ghost", False, None), ("p", "train", True, "redo"), ("q", "only", True, None)]
    assert values(stages.without_stages(table, removals), "stage") == [("prep",), ("redo",)]
    with pytest.raises(ValueError):
        stages.create_pipelines(table.limit(0))


def test_diagram_and_document(table):
    diagram = [r["line"] for r in stages.pipeline_mermaid(table).filter("pipeline = 'p'").orderBy("section", "ord", "item").collect()]
    assert diagram == ["graph TD", "    prep[prep]", "    train[train]", "    redo[redo]", "    train --> redo", "    redo --> train"]
    document = [r["line"] for r in stages.pipeline_docs(table).filter("pipeline = 'p'").orderBy("section", "ord", "item").collect()]
    assert document[:8] == ["# PIPELINE", "- Pipeline File: p", "- Stage Count: 3", "## Stages", "### prep", "- cmd: run", "- deps: []", "- outs: ['data.csv']"]
    assert document[-6:] == diagram[1:] or document[-6:] == diagram[-6:]

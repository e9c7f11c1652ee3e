"""Reachability and cycles in deep graphs: answers, rounds, and what is stored."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import values
from runledger.operators import graphs, lineage, stages


@pytest.fixture
def stored(monkeypatch):
    """Rows of every table the graph operators store."""
    rows, cut = [], graphs.cut_lineage

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graphs, "cut_lineage", counted)
    return rows


def records(spark, n, last):
    """n records, each made from the next; the last one from ``last``."""
    following = F.when(F.col("id") == n - 1, F.lit(last)).otherwise(F.concat(F.lit("n"), F.col("id") + 1))
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("n"), "id").alias("output"), F.array(following).alias("inputs"),
                                 F.lit("r").alias("run_id"), F.col("id").alias("ts"))


@pytest.mark.parametrize("last, size", [("source", 10_001), ("n0", 10_000)])
def test_chain_and_ring_of_ten_thousand(spark, make, stored, last, size):
    found = lineage.ancestors(records(spark, 10_000, last), make([("n0",)], "root string"))
    assert found.count() == size == found.distinct().count()
    assert len(stored) <= 2 * 15 + 2 and max(stored) <= 10 * size


def test_sources_of_a_long_chain(spark, make):
    chain, roots = records(spark, 300, "raw"), make([("n0",), ("n299",), ("ghost",)], "root string")
    assert values(lineage.source_artifacts(chain, roots)) == [("ghost", "ghost"), ("n0", "raw"), ("n299", "raw")]
    reached = lineage.ancestors(chain, roots)
    assert lineage.provenance(chain, roots, reached).count() == 301


@pytest.mark.parametrize("growth", [0, 1, 8])
def test_walks_in_steps_where_doubling_would_outgrow_the_links(make, stored, monkeypatch, growth):
    monkeypatch.setattr(graphs, "GROWTH", growth)
    monkeypatch.setattr(graphs, "PIECES", 3)
    n = 60
    links = [(i, j) for i in range(n) for j in (i + 1, i + 2, i + 5) if j < n] + [(n - 1, n - 4)]
    found = graphs.reach(make([(f"{a:03}", f"{b:03}") for a, b in links], "src string, dst string"), make([("000",), ("055",)], "node string"))
    got = values(found, "start", "node")
    assert got == sorted([("000", f"{i:03}") for i in range(n)] + [("055", f"{i:03}") for i in range(55, n)])
    assert max(stored) <= 9 * (len(links) + len(got))


def test_chain_of_twenty_thousand_stages(spark, make, stored):
    chain = spark.range(20_000).select(F.lit("deep").alias("pipeline"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert stages.has_cycle(chain).count() == 0
    assert len(stored) < 20 and max(stored) <= 20_000
    back = make([("deep", 19_000, 100), ("ring", 1, 2), ("ring", 2, 3), ("ring", 3, 1), ("line", 1, 2)], "pipeline string, src bigint, dst bigint")
    assert values(stages.has_cycle(chain.unionByName(back))) == [("deep",), ("ring",)]


@pytest.mark.parametrize("growth", [0, 1, 8])
def test_cycles_whatever_the_growth(make, monkeypatch, growth):
    monkeypatch.setattr(graphs, "GROWTH", growth)
    rng = random.Random(growth)
    rows = [("full", a, b) for a in range(6) for b in range(6) if a < b]
    rows += [("knot", a, b) for a in range(6) for b in range(6) if a < b] + [("knot", 5, 3), ("self", 1, 1), ("two", 1, 2), ("two", 2, 1)]
    rows += [("tail", a, a + 1) for a in range(30)] + [("tail", 30, 28)] + [("layers", 10 * k + a, 10 * k + 10 + b) for k in range(5) for a in range(4) for b in range(4)]
    rng.shuffle(rows)
    assert values(stages.has_cycle(make(rows, "pipeline string, src bigint, dst bigint"))) == [("knot",), ("self",), ("tail",), ("two",)]
    assert values(stages.has_cycle(make([], "pipeline string, src bigint, dst bigint"))) == []

"""Every core query against its SQL twin, and the promises of the entry points."""

import ast
import pathlib

import pytest

import __spark_entry__ as entry
from cohortloom.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_sql(spark, sf, compare, name):
    got, want = compare(core.QUERIES[name](spark, sf), core.ORACLE[name], sf)
    assert got == want


def test_entry_and_rows_only_queries(spark, sf):
    assert entry.entry(spark).count() > 0
    grid = core.QUERIES["context_grid"](spark, sf)
    assert grid.where("condition = 'zero_shot' AND size(anchor_ids) > 0").isEmpty()
    assert not grid.where("condition = 'full_trimodal_gated' AND size(components) = 1").isEmpty()
    assert core.QUERIES["rouge_l"](spark, sf).where("rouge_l < 0 OR rouge_l > 1").isEmpty()


def test_core_does_not_import_the_llm_subpackage():
    root = pathlib.Path(core.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("cohortloom.llm") for n in names), f


def test_plans_push_filters_and_columns(spark, sf):
    plan = core.QUERIES["split_leakage"](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(subject_id,1)" in plan
    assert "ecg_path" not in plan

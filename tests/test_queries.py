"""Every registered query of the engine against its SQL in DuckDB, and the driver's contract."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare
from rallyline.plans import registry

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_and_sql_agree(spark, sf_dir, name):
    assert compare.differences(spark, sf_dir, [name]) == {}


def test_alignment_costs_its_distance(spark, sf_dir):
    distance = {r["user_id"]: r["distance"] for r in registry.QUERIES["q27_alignment_distance"](spark, sf_dir).collect()}
    errors = {r["user_id"]: r["wrong_outcome"] + r["missing"] + r["extra"] for r in registry.QUERIES["q30_sequence_counts"](spark, sf_dir).collect()}
    assert errors == distance


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_nothing_outside_needs_the_training_data_package():
    """The entry module alone names it, behind a look whether it is there."""
    package = "rallyline" + r"\.(?:llm)"
    for path in [*ROOT.glob("*.py"), *ROOT.glob("rallyline/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.parts and path.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert not re.search(rf"(?:from|import) {package}", path.read_text()), path

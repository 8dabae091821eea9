"""A rule of the front end that fails, or whose rows can't be written, fails the query: without them fewer rows would look like the result."""

import pytest
from pyspark.sql import functions as F

from factgraph.plans import parsed
from factgraph.sources import rules

QUERIES = ["parsed_carried_spans", "parsed_cleanup", "parsed_diagnostics", "parsed_unanswered_smells"]


@pytest.mark.parametrize("name", QUERIES)
def test_rows_that_cannot_be_written_are_no_empty_result(spark, sf_dir, monkeypatch, name):
    def full(_):
        raise OSError("no space left")

    monkeypatch.setattr(rules, "cut_lineage", full)
    with pytest.raises(OSError, match="no space left"):
        parsed.QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("rule", ["unused_locals", "empty_catches"])
def test_a_rule_that_fails_in_its_job_fails_the_query(spark, sf_dir, monkeypatch, name, rule):
    monkeypatch.setitem(rules.RULES, rule, lambda p: p["statements"].select(F.raise_error(F.lit("broken rule")).cast("string").alias("code")))
    with pytest.raises(Exception, match="broken rule"):
        parsed.QUERIES[name](spark, sf_dir).collect()

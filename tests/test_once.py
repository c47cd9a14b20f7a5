"""What several branches of a step read is computed once, and reads are dealt once for what they are marked by."""

from fusewright.plans.demo import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_pair_support_reads_its_events_once(spark):
    for name in ("reciprocal_pairs", "both_spliced_threshold"):
        assert "lineitem.parquet" not in plan(spark, name)


def test_coverage_reads_events_and_edges_once(spark):
    assert "lineitem.parquet" not in plan(spark, "coverage_by_edges")


def test_multimappers_are_dealt_by_fragment_only(spark):
    for name in ("multimapper_reads", "multimapper_events"):
        assert "hashpartitioning(read_key" not in plan(spark, name) and "hashpartitioning(read_group" in plan(spark, name)


def test_operations_are_parsed_once(spark):
    assert plan(spark, "split_at_introns").count("regexp_extract_all(") == 1


def test_junctions_are_dealt_by_read_once(spark):
    p = plan(spark, "splice_aware_genes")
    assert "hashpartitioning(key#" not in p and p.count("Exchange hashpartitioning(read_key#") == 2

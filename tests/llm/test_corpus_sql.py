import compare
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", ["op1_cover_tree", "op3_feistel_shards", "op4_jaccard_rtree", "op5_personal_data", "op8_hierarchical_budget", "op9_line_frequency", "op10_segment_edit_join"])
def test_sql(spark, con, name):
    from echolattice.llm import queries

    assert not compare.difference(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


def test_one_query_an_operator():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()

import pytest

from planarix.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.check(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_sql_on_hard_cases(spark, tmp_path):
    """The same comparison over hand-made documents: nulls, repeats, empty and long texts."""
    from tests.llm import cases

    cases.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for t in oracle.TABLES:
        if t != "documents":
            spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("op3_exact_dedup", "op4_substring_dedup", "op9_mixing"):
        oracle.check(spark, str(tmp_path), queries.queries()[name], queries.oracle_sql()[name])

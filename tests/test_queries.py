"""Every registered query outside the training-data package against its SQL in DuckDB, at sf0.001."""

import duckdb
import pytest

from quarry.plans import feature_queries, model_queries, operator_queries, relational_queries  # noqa: F401
from quarry.plans.registry import ORACLE, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple("NULL" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(db.sql(ORACLE[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys() - {"recommender_session", "classification_pipeline"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

"""All registered queries and their oracles."""

from rankforge.plans import pages  # noqa: F401 - registers its queries
from rankforge.plans import queries as match_queries


def flagship(spark, sf_dir):
    return match_queries.flagship(spark, sf_dir)


def queries():
    return dict(match_queries.QUERIES)


def oracle_sql():
    return dict(match_queries.ORACLES)

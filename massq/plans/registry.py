"""All registered queries and their SQL."""

from massq.plans import engine, entrap, files, matching, proteins, signals, tools

_PARTS = (matching, proteins, signals, entrap, files, engine, tools)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}


def flagship(spark, sf_dir):
    return matching.target_decoy_search(spark, sf_dir)

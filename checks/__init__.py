"""Registered queries over the given tables, each with the SQL that has to agree with it."""

from checks import market_checks, metric_checks, post_checks, report_checks, run_checks, term_checks

PARTS = (market_checks, post_checks, term_checks, metric_checks, report_checks, run_checks)


def all_queries():
    return {name: query for part in PARTS for name, query in part.QUERIES.items()}


def all_oracles():
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}

"""The catalogue of named queries."""

from . import audit, checks, contacts, leads, lists, outreach, pages, reports, rules, sites

PARTS = [audit, outreach, leads, contacts, checks, reports, pages, sites, lists, rules]


def queries():
    """name -> function of (spark, folder of tables)."""
    from ..sources.views import Views

    def bound(make):
        return lambda spark, sf_dir: make(Views(spark, sf_dir))

    return {name: bound(make) for part in PARTS for name, (make, _) in part.CATALOGUE.items()}


def oracle_sql():
    return {name: sql for part in PARTS for name, (_, sql) in part.CATALOGUE.items() if sql}

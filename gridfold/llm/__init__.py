"""Operators for preparing training text: mixing, surrogates for personal
data, language identification, packing, license scans, near-duplicates, URL
filters, quality rules, fingerprints and token counts.

Nothing outside this subpackage imports it.  ``queries()`` and
``oracle_sql()`` list its registered queries."""


def queries():
    from gridfold.llm import catalog
    return catalog.queries()


def oracle_sql():
    from gridfold.llm import catalog
    return catalog.oracle_sql()

"""The driver contract: every query of the library has an oracle, and the entry
registers all of them."""

import __spark_entry__ as E

from tessera.plans import registry


def test_registry_contract():
    qs, oracle = registry.queries(), registry.oracle_sql()
    assert set(oracle) == set(qs)
    assert all(callable(f) for f in qs.values())
    assert all(isinstance(s, str) and s.strip() for s in oracle.values())
    assert set(qs) <= set(E.queries()) and set(oracle) <= set(E.oracle_sql())

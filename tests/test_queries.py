"""Every registered core query: against its SQL where it has one, else that it runs."""

import pytest
from oracle import DATA, check

from factweave.plans import association_queries, corpus_queries, derived_queries, fact_queries, graph_queries, pattern_queries, relational, rule_queries, search_queries, selection_queries, text_queries

MODULES = [corpus_queries, fact_queries, graph_queries, search_queries, rule_queries, association_queries, derived_queries, relational, text_queries, pattern_queries, selection_queries]
ALL = [(m, n) for m in MODULES for n in m.QUERIES]


@pytest.mark.parametrize("module,name", ALL, ids=[n for _, n in ALL])
def test_query(spark, module, name):
    if name in module.SQL:
        check(spark, module.QUERIES[name], module.SQL[name])
    else:
        df = module.QUERIES[name](spark, DATA)
        assert df.columns
        df.collect()


def test_names_are_unique():
    names = [n for _, n in ALL]
    assert len(names) == len(set(names))

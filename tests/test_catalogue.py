"""Every registered query with SQL gives the rows of DuckDB; the others run."""

import pytest

from conftest import SMALL, same_rows
from recollect.plans import catalogue_index as catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SMALL), duck, catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_odd_ids_and_all_facts_count(spark):
    from recollect.sources import adapters

    m = {r.id: r.layer for r in adapters.memories(spark, SMALL, False).collect()}
    up = {r.id: r.layer for r in catalogue.QUERIES["promote_rows"](spark, SMALL).collect()}
    assert set(up) == set(m) and {int(i) % 2 for i in up if up[i] != m[i]} == {0, 1}
    named = {r.memory_id for r in adapters.facts(spark, SMALL).collect()}
    assert {r.id for r in catalogue.QUERIES["memories_without_facts"](spark, SMALL).collect()} == {i for i in m if m[i] >= 2 and i not in named}


def test_chains_start_from_every_subject(spark):
    from recollect.sources import adapters

    every = {r.subject for r in adapters.facts(spark, SMALL).collect()}
    assert {r.entity for r in catalogue.QUERIES["facts_multihop"](spark, SMALL).collect()} == every


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

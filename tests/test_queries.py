"""Every core query against its SQL; those without SQL must run and give rows of a stable schema."""

from __future__ import annotations

import importlib

import pytest

import __spark_entry__ as entry

MODULES = [importlib.import_module(m) for m in entry.CORE]
CHECKED = [(n, m) for m in MODULES for n in m.QUERIES if n in m.SQL]
OTHERS = [(n, m) for m in MODULES for n in m.QUERIES if n not in m.SQL]


@pytest.mark.parametrize(("name", "module"), CHECKED, ids=[n for n, _ in CHECKED])
def test_same_as_sql(spark, data, same_rows, name, module):
    same_rows(module.QUERIES[name](spark, data), module.SQL[name])


@pytest.mark.parametrize(("name", "module"), OTHERS, ids=[n for n, _ in OTHERS])
def test_runs_twice_alike(spark, data, name, module):
    first, second = (sorted(map(str, module.QUERIES[name](spark, data).collect())) for _ in range(2))
    assert first == second


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

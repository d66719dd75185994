"""Registered queries against their DuckDB statements, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from matchloom.plans import fusion_oracles, rule_oracles, text_oracles

SMALL = "/root/testdata/sf0.001"
STATEMENTS = {**rule_oracles.RULE_ORACLES, **text_oracles.TEXT_ORACLES, **fusion_oracles.FUSION_ORACLES, **rule_oracles.CLOSE, **fusion_oracles.CLOSE}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def ordered(df: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    df = df[names].astype(object).where(df[names].notna(), None)
    keys = [n for n in names if not any(isinstance(v, (float, np.floating)) for v in df[n])] + [n for n in names if any(isinstance(v, (float, np.floating)) for v in df[n])]
    return df.sort_values(keys, key=lambda c: c.map(lambda v: (v is None, v if isinstance(v, str) else float(v or 0))), ignore_index=True)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_its_statement(spark, tables, name):
    said, found = tables.execute(STATEMENTS[name]).df(), entry.queries()[name](spark, SMALL).toPandas()
    names = sorted(found.columns)
    assert names == sorted(said.columns) and len(found) == len(said)
    for name in names:
        for a, b in zip(ordered(found, names)[name], ordered(said, names)[name], strict=True):
            assert a == b if a is None or isinstance(a, str) else b == pytest.approx(a, abs=1.1e-6)

"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from tendon.jobs import registry, validation_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def reference():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_ledger():
    """The reports read one ledger of this session, which is made once for all of them."""
    made, make = {}, validation_queries._ledger

    def once(spark, sf_dir):
        if sf_dir not in made:
            made[sf_dir] = make(spark, sf_dir)
        return made[sf_dir]

    validation_queries._ledger = once
    yield
    validation_queries._ledger = make


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, reference, name):
    df = registry.QUERIES[name](spark, SF)
    found = reference.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = Counter(tuple(map(plain, row)) for row in found.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == want


def test_every_query_is_sql_or_tested_by_hand():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"orientations"}


def test_one_exchange_on_the_episode_serves_the_motion_checks(spark):
    plan = registry.QUERIES["joint_position_checks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(episode_id") <= 2


def test_partition_count_does_not_matter(spark):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, registry.QUERIES["joint_position_checks"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]

"""Test fixtures: one local session, small tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    import oracle

    spark = oracle.session()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

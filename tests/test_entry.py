import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(sql.strip().upper().startswith(("SELECT", "WITH")) for sql in entry.oracle_sql().values())


@here
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_needs_the_llm_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "corpusloom")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read().replace("llm_", ""), f"{folder}/{name}"

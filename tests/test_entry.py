"""Registered queries agree with their SQL on the smallest data, and the entry works without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLOW = {"seed_map_approximate", *(n for n in entry.oracle_sql() if "_traceback_" in n and not n.startswith("gotoh"))}
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n not in SLOW]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    found = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in found.select(*[f"`{n}`" for n in names]).collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_without_the_corpus_subpackage(tmp_path):
    root = os.path.dirname(entry.__file__)
    shutil.copytree(os.path.join(root, "seqspark"), tmp_path / "seqspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [str(len([n for n in entry.queries() if not n.startswith('op') and n != 'pipeline'])), "False"], out.stderr

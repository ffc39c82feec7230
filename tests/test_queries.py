import hashlib
import os

import duckdb
import pytest

from reelframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v for v in row)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(map(repr, map(plain, cursor.fetchall())))
    assert sorted(repr(plain(r)) for r in got.select(*columns).collect()) == want


def test_restore_digest_holds_no_stream(spark, tmp_path):
    rows = [(i * 7 % 3000, f"text {i} " * 20, "hot") for i in range(3000)] + [(1, "b", "odd"), (1, "a", "odd"), (2, None, "odd"), (3, "", "odd"), (4, "ü", None), (5, None, "void"), (6, "", "bare")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.restore_digest(spark, str(tmp_path))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    hot = "".join(t for _, t, s in sorted(rows[:3000]))
    assert {r["source"]: r["digest"] for r in got.collect()} == {"hot": sha(hot), "odd": sha("ab"), None: sha("ü"), "void": None, "bare": sha("")}
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "raise_error" not in plan


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_import_the_optional_part():
    root = os.path.dirname(catalogue.__file__) + "/.."
    for folder, _, files in os.walk(root):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "reelframe.llm" not in text.read()

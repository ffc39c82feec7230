import duckdb
import pytest

import corpus_pipeline
from reelframe.llm import pipeline, registry
from reelframe.llm.common import read
from tests.llm.helpers import odd_documents
from tests.test_queries import TABLES, plain


def test_stages(spark, sf, tmp_path):
    docs, sizes = read(spark, sf, "documents"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert after.columns == corpus_pipeline.COLUMNS
        if i < 3:
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        sizes.append(after.count())
        docs = after
    assert sizes[0] >= 195 and sizes[0] > sizes[1] > sizes[2] > 100 and sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]


def test_stages_on_odd_rows(spark, sf):
    docs = odd_documents(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() >= 0
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_languages_keep_clean_texts_in_several_languages(spark, sf):
    rows = read(spark, sf, "documents").where("length(text) >= 200").orderBy("doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r["text"][:200])
    mixed = [(i, "\n".join(parts), "en", "s", 1) for i, parts in enumerate(zip(*by.values(), strict=False))][:30]
    assert len(by) >= 4 and len(mixed) >= 10
    docs = spark.createDataFrame([*mixed, (100, "12345 -- !!", "en", "s", 1), (101, None, "en", "s", 1)], read(spark, sf, "documents").schema)
    assert {r["doc_id"] for r in pipeline.languages(spark, docs, sf).collect()} == {m[0] for m in mixed}


def test_near_duplicates_keep_one_of_each_group(spark, sf):
    rows = [(i, "one two three four five six seven " + ("x" if i < 4 else str(i) * 3), "en", "s", 1) for i in range(8)] + [(2, "one two three four five six seven x", "en", "s", 1)]
    rows += [(None, "no id", "en", "s", 1), (None, "nor this", "en", "s", 1), (None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, read(spark, sf, "documents").schema)
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, sf).collect()]
    assert sorted(i for i, _ in got if i is not None) == [0, 4, 5, 6, 7]
    assert sorted(t for i, t in got if i is None) == ["no id", "nor this"]


def test_near_duplicates_judge_each_text_of_an_id(spark, sf):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty"
    rows = [(1, near), (2, near + " forty"), (2, "quite another text under the same number two"), (2, None), (3, near), (3, "first of three"), (3, "second of three"), (3, "second of three"), (None, near), (None, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], read(spark, sf, "documents").schema)
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, sf).collect()]
    assert sorted(got, key=repr) == sorted([(1, near), (2, rows[2][1]), (2, None), (3, "first of three"), (3, "second of three"), (None, near)], key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = registry.queries()[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(plain(r)) for r in got.select(*columns).collect()) == sorted(map(repr, map(plain, cursor.fetchall())))


def test_entry_hides_no_missing_module(monkeypatch):
    """Only the absence of the optional part itself is no fault."""
    import builtins
    import importlib
    import sys

    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    real = builtins.__import__

    def broken(name, *a, **b):
        if name == "xxhash":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *a, **b)

    kept = {m: v for m, v in sys.modules.items() if m.startswith("reelframe.llm")}
    for m in kept:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(__spark_entry__)
    monkeypatch.setattr(builtins, "__import__", real)
    sys.modules.update(kept)
    importlib.reload(__spark_entry__)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}

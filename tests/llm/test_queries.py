"""The registered queries against their SQL, and on odd tables."""

from __future__ import annotations

import pytest

from shutterlake.llm import registry

from ..conftest import SF

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, oracle, rows, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(oracle.sql(ORACLE[name]).df())


def test_names():
    have = set(registry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {q[: q.index("_") + 1] for q in have - {"pipeline"}}


DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, host string, word int, chunk int, key int, kind int"
ODD = [
    (1, None, "en", "a", 0, "x", "y", 1, 2, 3, 4),
    (2, "", "en", None, 0, "x", "y", 1, 2, 3, 4),
    (None, "one two three", None, "a", None, "x", "y", 1, 2, 3, 4),
    (3, "Word " * 3000, "en", "a", 15000, "x", "y", 1, 2, 3, 4),
    (4, "a b c d e f g h i j k l m n o p q r s t u v", "en", "a", 43, None, None, None, None, None, None),
    (4, "a b c d e f g h i j k l m n o p q r s t u v", "en", "a", 43, None, None, None, None, None, None),
    (5, "A B c d e f g h i j k l m n o p q r s t u v", "en", "b", 43, None, None, None, None, None, None),
]


def vector(*xs):
    return [float(x) for x in xs] + [0.5] * (64 - len(xs))


VECTORS = [
    (1, None, 0, 7, "x"),
    (2, [], 0, 7, "x"),
    (3, vector(1, float("nan")), 0, 7, "x"),
    (4, vector(float("inf")), 0, 7, "x"),
    (5, [*vector()[:-1], None], 0, 7, "x"),
    (6, vector(1e30), 0, 7, "x"),
    (7, vector(-1), 0, 7, None),
    (7, vector(-1), 0, 7, None),
    (7, vector(2, 3), None, None, "x"),
    (None, vector(-0.001), 0, 7, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def odd_dir(spark, odd, tmp_path_factory):
    """A folder of tables with nulls, repeats and odd texts; and one of the same tables without rows."""
    pages = spark.createDataFrame([(1, None, None, "h"), (None, "http://x.com/a", "", "h"), (3, "no scheme", "<p>cut <b", "h"), (3, "no scheme", "<p>cut <b", "h")], "page_id long, url string, html string, host string")
    tables = {
        "documents": odd,
        "pages": pages,
        "benchmark": spark.createDataFrame([(1, None), (2, ""), (3, "g h i j k l. m n o p")], "item_id long, text string"),
        "labels": spark.createDataFrame([(1, None, None), (3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int"),
        "embeddings": spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int, cluster int, v string"),
        "conversations": spark.createDataFrame([(1, 1, "user", None), (1, 2, None, "x"), (None, None, "tool", "<|end|>\n"), (1, 1, "user", None)], "conv_id long, turn long, role string, text string"),
    }
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "none"))
    for name, df in tables.items():
        df.write.parquet(f"{full}/{name}.parquet")
        df.where("false").write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"op2_decontamination", "op6_chat_format"}))
def test_odd_rows_and_empty_tables(spark, odd_dir, name):
    full, empty = odd_dir
    got = registry.queries()[name](spark, full).collect()
    if name != "pipeline":
        assert len(got) == (4 if name in ("op3_url_filter", "op7_html_extract", "op11_warc", "op13_centroid_clusters") else len(ODD))
    none = registry.queries()[name](spark, empty)
    assert none.collect() == [] and none.columns == registry.queries()[name](spark, SF).columns


def test_odd_conversations(spark, odd_dir):
    got = {r.conv_id: r for r in registry.queries()["op6_chat_format"](spark, odd_dir[0]).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, -7: 2}
    assert [r.conv_id for r in registry.queries()["op6_chat_format"](spark, odd_dir[1]).collect()] == [-7]


def test_odd_decontamination(spark, odd_dir):
    got = registry.queries()["op2_decontamination"](spark, odd_dir[0]).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(4, 3), (4, 3), (5, 3)]
    assert registry.queries()["op2_decontamination"](spark, odd_dir[1]).collect() == []

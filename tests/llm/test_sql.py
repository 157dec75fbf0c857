"""The SQL of the training-data operators gives their rows: on awkward texts and on the smallest tables."""

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

from vartide.llm import oracles, queries  # noqa: E402


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = " ".join(f"word{k % 90}" for k in range(260))
    passage = "\n".join(["first line of a passage", "second line of it, é and 中文", "", "third line"])
    texts = [None, "", " \n\t", "ONE two", "one TWO", base, base.replace("word7 ", "other "), base + " end", f"start\n{passage}\nend", f"{passage}\n\n{base}", "same\n" * 7, "ab" * 700, "x" * 64, base[:600] + base[:600], f"\x85  {passage}\x1f\n" * 2]
    pages = ["<p>small</p>", "<p>small</p>", None, "", "<p>" + "long " * 300, "<p>" + "long " * 300, "é" * 40_000, "y" * 8192, "z" * 32_768]
    where = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(k, t, [None, "en", "a & b"][k % 3], [None, "<news>", "web"][k % 4 % 3]) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(2).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, f"http://x/{k}", x) for k, x in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return {"odd": where, "small": "/root/testdata/sf0.001"}


@pytest.mark.parametrize("folder", ["odd", "small"])
@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, folders, name, folder):
    where = folders[folder]
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet{'/*.parquet' if folder == 'odd' else ''}'")
    got = queries.QUERIES[name](spark, where)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLE_SQL[name]})").fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.select(*columns).collect()) == order(expected)

"""Every specimen query gives what its SQL says, over documents with odd texts."""

import duckdb
import pytest

from marginalia.specimens import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    texts = [None, "", "plain", "a'b\"c`d\\ // x /* y */ # z -- w\n<!-- q -->\r\n日本 é   \x85 {$}(=)?>", "*/ ]] =end EOF X; " * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    return root


@pytest.mark.parametrize("name", QUERIES)
def test_specimens(spark, folder, name):
    got = QUERIES[name](spark, folder)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = con.execute(ORACLE_SQL[name])
        assert sorted(d[0] for d in want.description) == sorted(got.columns)
        names = [d[0] for d in want.description]
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())

"""placement where documents are empty or lack a length, against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from conftest import SF
from fotolake.functions import units as U


def test_empty_documents(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE n_chars END AS n_chars) FROM '{SF}/documents.parquet') "
               f"TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    con.sql(f"CREATE VIEW labels AS SELECT * FROM '{SF}/labels.parquet'")
    want = con.sql(oracle_sql()["placement"])
    got = queries()["placement"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("w,h,want", [(0, 37, (1, 600)), (400, 0, (800, 1)), (0, 0, (1, 600)), (None, 5, (1, 600))])
def test_fit_of_nothing(spark, w, h, want):
    size = [F.lit(v).cast("long") for v in (w, h)]
    assert tuple(spark.range(1).select(*U.fit_inside(*size, 800, 600)).first()) == want

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fotolake.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def image(spark):
    """Pixel table of one numpy array (h, w, 4) or (h, w, 3)."""
    from pyspark.sql import types as T

    names = ["image_id", "width", "height", "x", "y", "r", "g", "b", "a"]
    schema = T.StructType([T.StructField(n, T.LongType() if n == "image_id" else T.IntegerType()) for n in names])

    def make(*arrays):
        rows = []
        for i, a in enumerate(arrays):
            h, w, n = a.shape
            rows += [(i, w, h, x, y, *map(int, a[y, x, :3]), int(a[y, x, 3]) if n == 4 else None)
                     for y in range(h) for x in range(w)]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def array_of():
    import numpy as np

    def get(df, image_id=0):
        rows = df.filter(df.image_id == image_id).collect()
        w, h = rows[0]["width"], rows[0]["height"]
        assert len(rows) == w * h, (len(rows), w, h)
        out = np.full((h, w, 4), -1)
        for r in rows:
            out[r["y"], r["x"]] = [r["r"], r["g"], r["b"], -1 if r["a"] is None else r["a"]]
        assert (out[:, :, :3] >= 0).all()
        return out

    return get

"""Mosaics of images that lack bands: colours that both have decide, by the SQL and by all pairs."""

import pytest

from test_gaps import equal, gappy  # noqa: F401
from test_gaps_ends import cut  # noqa: F401


@pytest.mark.parametrize("name", ["mosaic_fills", "mosaic"])
def test_some_vectors(spark, gappy, name):  # noqa: F811
    equal(spark, gappy, name)


@pytest.mark.parametrize("name", ["mosaic_fills", "mosaic"])
def test_last_image(spark, cut, name):  # noqa: F811
    equal(spark, cut, name)

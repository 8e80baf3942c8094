"""mosaic by many tiles of sections and blocks of fills, against its SQL."""

from conftest import SF
from test_gaps import equal

from fotolake.operators.raster import mosaic as M


def test_mosaic_of_many_blocks(spark, monkeypatch):
    for name, value in {"TILES": 5, "SECTIONS": 100, "FILLS": 10, "HOT": 1}.items():
        monkeypatch.setattr(M, name, value)
    equal(spark, SF, "mosaic")

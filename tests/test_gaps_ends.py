"""A table that ends inside an image: queries against their SQL where the last image has its first two or three vectors."""

import duckdb
import pytest

from conftest import SF
from test_gaps import equal


@pytest.fixture(scope="module", params=[2, 3])
def cut(tmp_path_factory, request):
    folder = str(tmp_path_factory.mktemp("ends"))
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < {8 + request.param}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", [
    "packed_blur",
    "packed_blur_twice",
    "packed_color_to_alpha",
    "packed_brightness",
    "packed_colorize",
    "packed_common",
    "packed_contour_filter",
    "packed_contrast",
    "packed_convert_mode_1",
    "packed_convert_mode_la",
    "packed_crop",
    "packed_darkness",
    "packed_detail",
    "packed_desaturate",
    "packed_edge_enhance",
    "packed_edge_enhance_more",
    "packed_emboss",
    "packed_find_edges",
    "packed_flip_left_right",
    "packed_invert_half",
    "packed_invert",
    "packed_low_contrast",
    "autocontrast_cutoff",
    "background",
    "background_image",
    "blur",
    "blur_twice",
    "border",
    "border_inside",
    "bounding_box",
    "brightness",
    "canvas",
    "canvas_over",
    "caption",
])
def test_last_image(spark, cut, name):
    equal(spark, cut, name)

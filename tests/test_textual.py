"""Configurations, recipes and expected-value tables."""

import pytest

from strandline.sources import textual

GOOD = """
[album]
title = "A"
year = 1999
[[track]]
file = "a.flac"
[[track]]
file = "b.wav"
title = "B"
start_sample = 5
end_sample = 9
"""


def test_config(spark):
    album, tracks = textual.read_config(spark, GOOD)
    assert tuple(album.first())[:4] == ("A", "", 1999, 16384)
    assert [tuple(r) for r in tracks.orderBy("idx").collect()] == [(0, "a.flac", None, None, None, None), (1, "b.wav", "B", None, 5, 9)]


@pytest.mark.parametrize("bad", ["[other]\nx = 1\n" + GOOD, GOOD.replace('title = "A"\n', ""), GOOD.replace("end_sample = 9", ""), GOOD.replace("= 9", "= 4"), GOOD.replace("1999", "1.5"), '[album]\ntitle = "A"', "[[", GOOD + "[out]\nrate_hz = 32768\n", GOOD.replace('"a.flac"', '" "')])
def test_config_refusals(spark, bad):
    with pytest.raises(textual.ConfigError):
        textual.read_config(spark, bad)


def test_recipe_is_applied(spark):
    x = spark.range(100).selectExpr("id as n", "cast(100 as double) as x")
    got = {r.n: r.x for r in textual.apply_recipe(x, "n", "x", 10, 2.0, 6.0, 1.0, 0.5).collect()}
    assert len(got) == 40 and got[0] == 50 and got[39] == 5 and got[34] == 30


def test_key_value_lines(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("frame=1 bits=20",), ("frame=2 bits=31",)], "value string")
    assert [r.fields for r in textual.key_values(lines).collect()] == [{"frame": "1", "bits": "20"}, {"frame": "2", "bits": "31"}]

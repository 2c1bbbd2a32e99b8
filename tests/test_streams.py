"""Streams that emit what is open when the input ends, against SQL without a cut."""

import pytest

import __spark_entry__ as entry
from checks import compare
from waferlake.streaming import live


@pytest.mark.parametrize("name", ["stream_spec_share_whole", "stream_silent_lots_whole"])
def test_whole(spark, sf, name):
    con = compare.connect(sf)
    got = entry.queries()[name](spark, sf).toPandas()
    assert got["n"].sum() == con.execute("SELECT count(*) FROM events").fetchone()[0]
    assert compare.difference(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_lateness_is_asked_for():
    with pytest.raises(TypeError):
        live.silent_lots(None, "6 hours")
    with pytest.raises(TypeError):
        live.live_spec_share(None, None, 250.0)

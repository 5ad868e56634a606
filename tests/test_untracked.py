"""Albums whose releases list no tracks."""

import micro
from pyspark.sql import functions as F

from sleevenotes.operators import album


def test_tracks_that_no_release_lists_are_not_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(album, "written", lambda df: (stored.append(df.columns), df)[1])
    cat = micro.catalog(spark)
    ids = cat["release_group"].filter("id < 12").select("id")
    whole = {r.id: r for r in album.album_docs(cat, ids).select("id", "artistids", F.col("Releases.Id").alias("releases")).collect()}
    assert any("mediumnumber" in columns for columns in stored)
    stored.clear()
    docs = album.album_docs(cat, ids, embedded={"artists": ("id",), "Releases": ("Id",)})
    assert docs.schema["Releases"].dataType.elementType.names == ["Id"]
    assert not any("mediumnumber" in columns for columns in stored), stored
    assert whole and {r.id: r for r in docs.select("id", "artistids", F.col("Releases.Id").alias("releases")).collect()} == whole

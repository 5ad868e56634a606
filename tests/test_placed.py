"""Tracks with their releases."""

import re

import micro
from pyspark.sql import functions as F

from sleevenotes.operators.release import placed_tracks, track_rows


def test_tracks_carry_the_gid_of_their_release(spark):
    cat = micro.catalog(spark)
    gids = {r.id: r.gid for r in cat["release"].collect()}
    by_id = sorted((gids[r.release], r.track) for r in track_rows(cat).collect())
    assert by_id and sorted((r.release, r.track) for r in track_rows(cat, placed=placed_tracks(cat, by_gid=True)).collect()) == by_id


def test_tracks_get_wide_columns_last(spark):
    plan = track_rows(micro.catalog(spark))._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join (?:Inner|LeftOuter), \((\w+)#", plan)  # from the top
    tracks = [j for j in joins if j in ("recording", "artist_credit", "id", "medium")]
    assert tracks.index("recording") < tracks.index("artist_credit") < tracks.index("id") < tracks.index("medium"), joins
    assert track_rows(micro.catalog(spark)).filter(F.size("track.oldids") > 0).count() == 1

"""Track queries over users of any id."""

import datetime

from loomgrid.plans import spatial


def test_tracks_hold_all_users(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(u * 10 + i, u, at + datetime.timedelta(hours=i), float(i * i * 7)) for u in (1, 199, 200, 1500) for i in range(4)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    for query in (spatial.simplify_lines, spatial.convex_hulls):
        assert {r["user_id"] for r in query(spark, str(tmp_path)).collect()} == {1, 199, 200, 1500}, query.__name__

"""Matching modes and tracks over skipped frames."""

import pytest

from driftloom.operators import joins as jn
from driftloom.operators import regions as reg

INF = float("inf")


def regions(spark, rows):
    return spark.createDataFrame(rows, "position long, frame_number long, label long, cy double, cx double, area double")


def links(spark, rows, metrics, **more):
    return sorted((r.label, r.next_label, round(r.distance, 6)) for r in jn.metric_links(regions(spark, rows), metrics, **more).collect())


FILM = [(0, 0, 1, 0.0, 0.0, 10.0), (0, 0, 2, 0.0, 3.0, 20.0), (0, 1, 5, 0.0, 1.0, 10.0), (0, 1, 6, 0.0, 1.4, 90.0), (0, 1, 7, 50.0, 50.0, 20.0)]
CENTRE = {"centroid": (["cy", "cx"], 2.0)}


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        ("forward", [(1, 5, 1.0), (2, 6, 1.6)]),
        ("from_reference", [(1, 5, 1.0), (2, 6, 1.6)]),
        ("reverse", [(1, 5, 1.0), (1, 6, 1.4)]),
        ("to_reference", [(1, 5, 1.0), (1, 6, 1.4)]),
        ("reciprocal", [(1, 5, 1.0)]),
    ],
)
def test_modes(spark, mode, want):
    assert links(spark, FILM, CENTRE, mode=mode) == want


def test_modes_look_the_other_way_for_earlier_frames(spark):
    back = {mode: links(spark, FILM, CENTRE, mode=mode, step=-1) for mode in jn.MODES}
    assert back["forward"] == back["to_reference"] == [(5, 1, 1.0), (6, 2, 1.6)]
    assert back["reverse"] == back["from_reference"] == [(5, 1, 1.0), (6, 1, 1.4)]
    with pytest.raises(ValueError):
        links(spark, FILM, CENTRE, mode="sideways")


def test_metrics_beyond_their_limits_are_left_out(spark):
    both = CENTRE | {"area": (["area"], 5.0)}
    assert links(spark, FILM, both, mode="from_reference") == [(1, 5, 0.5), (2, 7, 0.0)]
    assert links(spark, FILM, both, mode="from_reference", every=True) == [(1, 5, 0.5)]
    free = CENTRE | {"area": (["area"], INF)}
    assert links(spark, FILM, free, mode="from_reference") == [(1, 5, 0.5), (2, 7, 0.0)]
    assert links(spark, FILM, {"area": (["area"], 0.0)}, mode="to_reference") == [(1, 5, 0.0), (2, 7, 0.0)]


def test_null_metrics_and_ties(spark):
    rows = [(0, 0, 1, None, 0.0, 10.0), (0, 0, 2, 1.0, 1.0, None), (0, 1, 3, 1.0, 0.0, 10.0), (0, 1, 4, 1.0, 2.0, 10.0)]
    both = CENTRE | {"area": (["area"], 5.0)}
    assert links(spark, rows, both, mode="from_reference") == [(1, 3, 0.0), (2, 3, 1.0)]
    assert links(spark, [], both) == []


def test_tiles_equal_all_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [(0, f, k, rng.uniform(-9, 9), rng.uniform(-9, 9), float(rng.randrange(40))) for f in range(2) for k in range(60)]
    metrics = {"centroid": (["cy", "cx"], 2.5), "area": (["area"], 3.0)}
    for every in (False, True):
        want = {}
        for a in rows[:60]:
            for b in rows[60:]:
                d = [((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5, abs(a[5] - b[5])]
                near = [x for x, m in zip(d, (2.5, 3.0), strict=True) if x <= m]
                if len(near) >= (2 if every else 1):
                    want[a[2]] = min(want.get(a[2], (INF, 0)), (sum(near) / len(near), b[2]))
        found = links(spark, rows, metrics, mode="from_reference", every=every)
        assert found == sorted((a, b, round(d, 6)) for a, (d, b) in want.items())


def tracks(spark, labels, tolerance):
    """Labels by frame; a label is a pixel at its own place, so that it overlaps itself in other frames only."""
    px = spark.createDataFrame([(0, f, 0, x, x) for f, row in enumerate(labels) for x in row], "position long, frame_number long, y long, x long, label long")
    found = reg.nearest_links([jn.overlap_links(px, k) for k in range(1, tolerance + 2)])
    nodes = px.select("position", "frame_number", "label")
    out = {}
    for r in reg.tracks(found, nodes).collect():
        out.setdefault(r.track_id, []).append((r.frame_number, r.label))
    fresh = {(r.frame_number, r.label) for r in reg.unmatched_labels(nodes, found).collect()}
    assert fresh == {min(v) for v in out.values()}
    return sorted(sorted(v) for v in out.values())


def test_tracks_go_on_over_skipped_frames(spark):
    film = [[1, 2], [1], [1, 2], [], [1, 2], [1], [1], [1, 2]]
    assert tracks(spark, film, 0) == [[(0, 1), (1, 1), (2, 1)], [(0, 2)], [(2, 2)], [(4, 1), (5, 1), (6, 1), (7, 1)], [(4, 2)], [(7, 2)]]
    one = [(f, 1) for f in (0, 1, 2, 4, 5, 6, 7)]
    assert tracks(spark, film, 1) == [one, [(0, 2), (2, 2), (4, 2)], [(7, 2)]]
    assert tracks(spark, film, 2) == [one, [(f, 2) for f in (0, 2, 4, 7)]]


def test_the_newest_record_wins(spark):
    frame = "position long, frame_number long, label long, next_label long"
    # Label 3 of frame 2 is linked from frame 1 (label 2) and from frame 0 (label 1); label 1 then goes on to frame 3.
    by_gap = [spark.createDataFrame(rows, frame) for rows in ([(0, 1, 2, 3)], [(0, 0, 1, 3)], [(0, 0, 1, 4), (0, 1, 2, 9)])]
    found = sorted((r.frame_number, r.label, r.next_frame, r.next_label) for r in reg.nearest_links(by_gap).collect())
    assert found == [(0, 1, 3, 4), (1, 2, 2, 3)]


def test_links_in_a_circle_are_refused(spark):
    link = "position long, frame_number long, label long, next_frame long, next_label long"
    nodes = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 1)], "position long, frame_number long, label long")
    with pytest.raises(ValueError):
        reg.tracks(spark.createDataFrame([(0, k, 1, (k + 1) % 3, 1) for k in range(3)], link), nodes, rounds=4)

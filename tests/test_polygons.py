"""Cutting, repair and tiles of polygons, against tests of single places."""

import numpy as np
import pytest

from vesselflow.operators import polygons as P

SQUARE = lambda a, b: np.array([[a, a], [b, a], [b, b], [a, b]], float)
U = np.array([[0, 0], [3, 0], [3, 3], [2, 3], [2, 1], [1, 1], [1, 3], [0, 3]], float)


def holds(rings, points):
    """Inside an odd number of rings, for each point."""
    out = np.zeros(len(points), int)
    for r in rings:
        a, b = r, np.roll(r, -1, axis=0)
        x, y = points[:, 0, None], points[:, 1, None]
        with np.errstate(all="ignore"):
            at = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        out += (((a[:, 1] > y) != (b[:, 1] > y)) & (x < at)).sum(axis=1) % 2
    return out % 2 == 1


def whole(pieces):
    return sum(P.area(r) for p in pieces for r in p)


def test_concave_rings_fall_into_parts():
    tops = list(P.pieces([U], [(0, 2, 3, 4)], 256))
    assert len(tops) == 2 and whole(tops) == 2 and all(len(p) == 1 for p in tops)
    assert len(list(P.pieces([U], [(0, 0, 3, 2)], 256))) == 1 and not list(P.pieces([U], [(1, 1.5, 2, 3)], 256))


def test_holes_stay_holes_or_open_at_the_cut():
    ring = [SQUARE(0, 4), SQUARE(1, 3)]
    (half,) = P.pieces(ring, [(0, 0, 2, 4)], 256)
    (full,) = P.pieces(ring, [(-9, -9, 9, 9)], 256)
    assert len(half) == 1 and P.area(half[0]) == 6 and len(full) == 2 and P.area(full[1]) == -4
    island = list(P.pieces([*ring, SQUARE(1.5, 2)], [(-9, -9, 9, 9)], 256))
    assert sorted(len(p) for p in island) == [1, 2] and whole(island) == 12.25


def test_crossed_rings_are_mended():
    bow = np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float)
    got = list(P.pieces([bow], [(-1, -1, 3, 3)], 256))
    assert whole(got) == 2 and not any(P.crosses(p) for p in got)
    assert P.crosses([bow]) and not P.crosses([U]) and P.crosses([SQUARE(0, 2), SQUARE(1, 3)])
    assert whole(P.pieces([SQUARE(0, 2), SQUARE(1, 3)], [(-1, -1, 4, 4)], 256)) == 6


def test_odd_rings_go():
    for ring in (np.zeros((0, 2)), np.array([[0, 0], [1, 1]], float), np.array([[0, 0], [1, 1], [2, 2]], float), np.array([[0, 0], [1, np.nan], [2, 0]]), np.zeros((5, 2))):
        assert not list(P.pieces([ring], [(-9, -9, 9, 9)], 256)) and not list(P.tiles([ring], 1.0, 0.1, 0.1))
    doubled = np.repeat(SQUARE(0, 1), 3, axis=0)
    assert whole(P.pieces([doubled], [(0, 0, 1, 1)], 256)) == 1


def test_no_piece_has_too_many_corners():
    turn = np.linspace(0, 2 * np.pi, 5001)[:-1]
    star = np.stack([np.cos(turn), np.sin(turn)], axis=1) * (1 + 0.3 * (np.arange(5000) % 2))[:, None]
    got = list(P.pieces([star], [(-2, -2, 2, 2)], 256))
    assert max(sum(map(len, p)) for p in got) <= 256 and abs(whole(got) - P.area(star)) < 1e-9 and len(got) > 20


def test_union_of_boxes():
    box = lambda *v: dict(zip(("west", "south", "east", "north"), v))
    assert P.disjoint([box(0, 0, 2, 2), box(1, 1, 3, 3), box(5, 0, 6, 1)]) == [(0, 0, 1, 2), (1, 0, 2, 3), (2, 1, 3, 3), (5, 0, 6, 1)]
    assert P.disjoint([box(0, 0, 1, 1), box(1, 0, 2, 1)]) == [(0, 0, 2, 1)] and P.disjoint([]) == []


@pytest.mark.parametrize("seed", range(40))
def test_pieces_and_tiles_hold_the_same_places(seed):
    """Stars, and rings that cross themselves, in two overlapping boxes and in tiles."""
    rng = np.random.default_rng(seed)
    n = rng.integers(3, 40)
    turn, out = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.2, 1, n)
    rings = [np.stack([out * np.cos(turn), out * np.sin(turn)], axis=1)]
    if seed % 3 == 0:
        rings = [rng.uniform(-1, 1, (rng.integers(3, 9), 2))]
    if seed % 4 == 1:
        rings.append(rings[0] * 0.4)
    boxes = P.disjoint([{"west": -0.6, "south": -0.4, "east": 0.3, "north": 0.5}, {"west": 0.0, "south": -0.2, "east": 0.8, "north": 0.9}])
    got = list(P.pieces(rings, boxes, int(rng.choice([6, 20, 256]))))
    points = rng.uniform(-1, 1, (1500, 2))
    inside = holds(rings, points)
    in_box = np.any([(points[:, 0] >= w) & (points[:, 0] <= e) & (points[:, 1] >= s) & (points[:, 1] <= n) for w, s, e, n in boxes], axis=0)
    assert (np.sum([holds(p, points) for p in got], axis=0) == (inside & in_box)).all() if got else not (inside & in_box).any()
    assert not any(P.crosses(p) for p in got) and all(P.area(p[0]) > 0 and all(P.area(h) < 0 for h in p[1:]) for p in got)
    tiles = {(x, y): (own, edges) for x, y, own, edges in P.tiles(rings, 0.25, 0.01, 0.01)}
    cells = np.floor(points / 0.25).astype(int)
    for x, y in {tuple(c) for c in cells.tolist()}:
        here = (cells == (x, y)).all(axis=1)
        own, edges = tiles.get((x, y), (None, np.zeros((0, 4))))
        want = np.ones(here.sum(), bool) if own == [] else holds(own or [], points[here])
        assert (want == inside[here]).all()
        assert len(edges) <= sum(map(len, rings))


def test_tiles_keep_slivers_and_gaps_at_a_cells_border():
    """A polygon may end, or begin, a rounding away from a cell's border, on which places lie."""
    box = lambda w, e: np.array([[w, 43.3], [e, 43.3], [e, 44.0], [w, 44.0]])
    tiles = {t[:2]: t[2] for t in P.tiles([box(13.1, 14.000000000000002)], 0.5, 0.01, 0.01)}
    assert holds(tiles[28, 87], np.array([[14.0, 43.6]])).all() and not holds(tiles[28, 87], np.array([[14.000000000000004, 43.6]])).any()
    tiles = {t[:2]: t[2] for t in P.tiles([box(14.000000000000002, 15.0)], 0.5, 0.01, 0.01)}
    assert tiles[28, 87] != [] and not holds(tiles[28, 87], np.array([[14.0, 43.6]])).any() and tiles[29, 87] == []


@pytest.mark.parametrize("seed", range(20))
def test_settled_polygons_are_as_cut_one_by_one(seed):
    """Boxes, notches, holes, crossed and odd rings, at, in and beyond two boxes."""
    rng = np.random.default_rng(seed)
    shapes = [[SQUARE(0, 1)], [SQUARE(0, 1)[::-1]], [SQUARE(0, 1), SQUARE(0.25, 0.75)], [SQUARE(0, 1), SQUARE(1, 2)], [np.array([[0, 0], [1, 1], [1, 0], [0, 1]], float)], [np.array([[0, 0], [1, 0], [2, 0]], float)],
              [np.array([[0, 0], [1, np.nan], [0, 1]])], [], [np.zeros((0, 2))], [np.array([[0, 0], [1, 0], [1, 1], [0.75, 1], [0.75, 0.5], [0.25, 0.5], [0.25, 1], [0, 1]])]]
    polygons = [[r * rng.choice([0.5, 1.0]) + rng.integers(-4, 9, 2) / 2 for r in shapes[k]] for k in rng.integers(0, len(shapes), 300)]
    polygons += [[rng.uniform(0, 3, (n, 2))] for n in rng.integers(3, 7, 50)]
    boxes = [(0.0, 0.0, 2.0, 3.0), (2.0, 1.0, 4.0, 2.5)]
    done = P.settled(polygons, boxes, 256)
    assert len(done) > 100
    for i, got in done.items():
        want = list(P.pieces(polygons[i], boxes, 256))
        assert [[r.tolist() for r in p] for p in got] == [[r.tolist() for r in p] for p in want]

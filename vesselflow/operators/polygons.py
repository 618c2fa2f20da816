"""Polygons as arrays of corners: cutting along lines, parts with their holes, repair, tiles.

A polygon is a list of rings, each an (n, 2) array of longitude and latitude without
the closing point; a place is inside if it is inside an odd number of rings. Every
cut is by one meridian or parallel: the pieces of rings on the kept side are joined
along the line in pairs of neighbouring crossings, so that concave rings and holes
give as many parts as they have, without bridges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Square degrees below which a ring is nothing.
NO_AREA = 1e-14

Rings = list[np.ndarray]


def area(ring: np.ndarray) -> float:
    """Square degrees, positive if the ring runs anticlockwise; taken from the first corner, so that small rings keep their digits."""
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clean(ring: np.ndarray, least: float = NO_AREA) -> np.ndarray | None:
    """The ring without repeated corners or closing point; none if it lies on a line (is nowhere thicker than `least` tells) or is not finite."""
    if len(ring) < 3 or not np.isfinite(ring).all():
        return None
    ring = ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)]
    if len(ring) < 3:
        return None
    out = ring - ring[0]
    far = out[(out**2).sum(axis=1).argmax()]
    return ring if np.abs(out[:, 0] * far[1] - out[:, 1] * far[0]).max() > least else None


def _edges(rings: Rings) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])


def crosses(rings: Rings) -> bool:
    """Some two edges of the rings cross inside both, or lie on one another."""
    a, b = _edges(rings)
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    for i in range(0, len(a), 512):
        p, q = a[i : i + 512, None], b[i : i + 512, None]
        s1, s2, s3, s4 = side(p, q, a[None]), side(p, q, b[None]), side(a[None], b[None], p), side(a[None], b[None], q)
        if ((s1 * s2 < 0) & (s3 * s4 < 0)).any():
            return True
        flat = (s1 == 0) & (s2 == 0)
        if flat.any():
            k, j = np.nonzero(flat)
            k += i
            longer = np.abs(b[k] - a[k]).argmax(axis=1)
            at = lambda x, rows: x[rows, longer]
            low, high = np.minimum(at(a, k), at(b, k)), np.maximum(at(a, k), at(b, k))
            over = np.minimum(high, np.maximum(at(a, j), at(b, j))) > np.maximum(low, np.minimum(at(a, j), at(b, j)))
            if (over & (k != j)).any():
                return True
    return False


def half(rings: Rings, axis: int, bound: float, sign: int, least: float = NO_AREA) -> Rings:
    """The part on one side of a line: coordinates of `axis` at least `bound`, or at most if `sign` is -1; slivers below `least` go."""
    out, chains = [], []
    for ring in rings:
        inside = sign * (ring[:, axis] - bound) >= 0
        if inside.all():
            out.append(ring)
            continue
        if not inside.any():
            continue
        change = np.flatnonzero(inside != np.roll(inside, -1))
        nxt = (change + 1) % len(ring)
        p, q = ring[change], ring[nxt]
        t = (bound - p[:, axis]) / (q[:, axis] - p[:, axis])
        cut = p + t[:, None] * (q - p)
        cut[:, axis] = bound
        enter = np.flatnonzero(~inside[change])
        for k in enter:
            leave = (k + 1) % len(change)
            first, last = nxt[k], change[leave]
            between = ring[first : last + 1] if first <= last else np.concatenate([ring[first:], ring[: last + 1]])
            chains.append(np.concatenate([cut[k : k + 1], between, cut[leave : leave + 1]]))
    if chains:
        ends = np.array([[c[0, 1 - axis], c[-1, 1 - axis]] for c in chains]).ravel()
        order = np.argsort(ends, kind="stable")
        partner = np.empty(len(order), np.int64)
        partner[order[::2]], partner[order[1::2]] = order[1::2], order[::2]
        used = np.zeros(len(chains), bool)
        for start in range(len(chains)):
            if used[start]:
                continue
            ring, end = [], 2 * start
            while not used[end // 2]:
                used[end // 2] = True
                chain = chains[end // 2]
                ring.append(chain if end % 2 == 0 else chain[::-1])
                end = int(partner[end ^ 1])
            out.append(np.concatenate(ring))
    return [r for r in (clean(ring, least) for ring in out) if r is not None]


def within(rings: Rings, west: float, south: float, east: float, north: float) -> Rings:
    for axis, bound, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        rings = half(rings, axis, bound, sign)
    return rings


def box_of(rings: Rings) -> tuple[float, float, float, float]:
    every = np.concatenate(rings)
    return (*every.min(axis=0), *every.max(axis=0))


def split(rings: Rings, most: int):
    """The polygon in pieces of at most `most` corners, halved across its longer side."""
    if not rings:
        return
    if sum(map(len, rings)) <= most:
        yield rings
        return
    west, south, east, north = box_of(rings)
    axis = 0 if east - west >= north - south else 1
    middle = (west + east) / 2 if axis == 0 else (south + north) / 2
    for sign in (1, -1):
        yield from split(half(rings, axis, middle, sign), most)


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return bool((((a[:, 1] > y) != (b[:, 1] > y)) & (x < at)).sum() % 2)


def _border(ring: np.ndarray) -> tuple[float, float]:
    """The middle of the ring's longest edge: rings that do not cross may touch there at most by chance."""
    a, b = ring, np.roll(ring, -1, axis=0)
    k = int(((b - a) ** 2).sum(axis=1).argmax())
    return tuple(((a[k] + b[k]) / 2).tolist())


def parts(rings: Rings) -> list[Rings]:
    """The polygon's parts, each an anticlockwise outer ring and the clockwise rings of its holes."""
    places = [_border(r) for r in rings]
    holders = [[j for j, o in enumerate(rings) if j != i and _holds(o, *places[i])] for i in range(len(rings))]
    turned = lambda r, way: r if (area(r) > 0) == way else r[::-1]
    outer = [i for i in range(len(rings)) if len(holders[i]) % 2 == 0]
    out = {i: [turned(rings[i], True)] for i in outer}
    for i in range(len(rings)):
        if len(holders[i]) % 2:
            own = max((j for j in holders[i] if j in out), key=lambda j: len(holders[j]))
            out[own].append(turned(rings[i], False))
    return list(out.values())


def repaired(rings: Rings) -> list[Rings]:
    """Valid parts: those of the rings, or, where edges cross, the trapezoids between the heights of all corners and crossings."""
    if not crosses(rings):
        return parts(rings)
    a, b = _edges(rings)
    d, heights = b - a, [np.concatenate(rings)[:, 1]]
    for i in range(len(a)):
        den = d[i, 0] * d[:, 1] - d[i, 1] * d[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((a[:, 0] - a[i, 0]) * d[:, 1] - (a[:, 1] - a[i, 1]) * d[:, 0]) / den
            u = ((a[:, 0] - a[i, 0]) * d[i, 1] - (a[:, 1] - a[i, 1]) * d[i, 0]) / den
        hit = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        heights.append(a[i, 1] + t[hit] * d[i, 1])
    levels, out = np.unique(np.concatenate(heights)), []
    for low, high in zip(levels, levels[1:]):
        own = (np.minimum(a[:, 1], b[:, 1]) <= low) & (np.maximum(a[:, 1], b[:, 1]) >= high)
        at = lambda y: a[own, 0] + (y - a[own, 1]) / d[own, 1] * d[own, 0]
        bottom, top = at(low), at(high)
        order = np.argsort(bottom + top, kind="stable")
        for i, j in zip(order[::2], order[1::2]):
            right = [x[i] if abs(x[j] - x[i]) < 1e-12 else x[j] for x in (bottom, top)]
            ring = np.array([[bottom[i], low], [right[0], low], [right[1], high], [top[i], high]])
            if area(ring) > NO_AREA:
                out.append([clean(ring)])
    return out


def pieces(rings: Rings, boxes: list[tuple[float, float, float, float]], most: int):
    """Valid parts of the polygon inside disjoint boxes (west, south, east, north), of at most `most` corners before repair."""
    rings = [r for r in map(clean, rings) if r is not None]
    for box in boxes:
        if not rings:
            return
        west, south, east, north = box_of(rings)
        if west < box[2] and east > box[0] and south < box[3] and north > box[1]:
            for piece in split(within(rings, *box), most):
                yield from repaired(piece)


def settled(polygons: list[Rings], boxes: list[tuple[float, float, float, float]], most: int) -> dict[int, list[Rings]]:
    """What `pieces` gives, by place in the list, for the polygons that no box cuts and that need no repair, tested
    together if their rings have equal numbers of corners. The others are left out."""
    out: dict[int, list[Rings]] = {}
    alike: dict[tuple[int, ...], list[int]] = {}
    for i, rings in enumerate(polygons):
        alike.setdefault(tuple(map(len, rings)), []).append(i)
    for sizes, at in alike.items():
        corners = sum(sizes)
        if not sizes or min(sizes) < 3 or corners > min(most, 64):
            continue
        ends, step = np.cumsum(sizes), max(1, 200_000 // corners**2)
        for first in range(0, len(at), step):
            rows = np.array(at[first : first + step])
            a = np.stack([np.concatenate(polygons[i]) for i in rows])
            nxt = np.arange(1, corners + 1)
            nxt[ends - 1] = ends - np.array(sizes)
            b = a[:, nxt]
            fit = np.isfinite(a).all(axis=(1, 2)) & (a != b).any(axis=2).all(axis=1)
            with np.errstate(invalid="ignore", over="ignore"):
                areas = []
                for start, end in zip(ends - np.array(sizes), ends):
                    d = a[:, start:end] - a[:, start : start + 1]
                    far = d[np.arange(len(d)), (d**2).sum(axis=2).argmax(axis=1)][:, None]
                    fit &= np.abs(d[..., 0] * far[..., 1] - d[..., 1] * far[..., 0]).max(axis=1) > NO_AREA
                    e = np.roll(d, -1, axis=1)
                    areas.append((d[..., 0] * e[..., 1] - e[..., 0] * d[..., 1]).sum(axis=1))
                low, high = a.min(axis=1), a.max(axis=1)
                reached, held = np.zeros(len(a), bool), np.zeros(len(a), bool)
                for west, south, east, north in boxes:
                    reached |= (low[:, 0] < east) & (high[:, 0] > west) & (low[:, 1] < north) & (high[:, 1] > south)
                    held |= (low[:, 0] >= west) & (high[:, 0] <= east) & (low[:, 1] >= south) & (high[:, 1] <= north)
            for i in rows[fit & ~reached].tolist():
                out[i] = []
            own = np.flatnonzero(fit & held & reached)
            p, q, r, t = a[own][:, :, None], b[own][:, :, None], a[own][:, None], b[own][:, None]
            side = lambda u, v, w: (v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0])
            s1, s2, s3, s4 = side(p, q, r), side(p, q, t), side(r, t, p), side(r, t, q)
            # Edges on one line go the longer way round, which tells whether they overlap.
            aside = ((s1 * s2 < 0) & (s3 * s4 < 0)) | ((s1 == 0) & (s2 == 0) & ~np.eye(corners, dtype=bool))
            for k in own[~aside.any(axis=(1, 2))].tolist():
                rings = polygons[rows[k]]
                # The signs of areas that are nearly none are taken as everywhere else.
                single = len(rings) == 1 and abs(areas[0][k]) > NO_AREA
                out[int(rows[k])] = [[rings[0] if areas[0][k] > 0 else rings[0][::-1]]] if single else parts(rings)
    return out


def disjoint(boxes: list[dict]) -> list[tuple[float, float, float, float]]:
    """The union of boxes as disjoint ones: strips between all borders in longitude, in each the joined spans of latitude; equal neighbours merge."""
    xs = sorted({b[k] for b in boxes for k in ("west", "east")})
    open_, out = [], []
    for west, east in zip(xs, xs[1:]):
        spans: list[list[float]] = []
        for south, north in sorted((b["south"], b["north"]) for b in boxes if b["west"] <= west and b["east"] >= east):
            if spans and south <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], north)
            else:
                spans.append([south, north])
        now = []
        for s, n in spans:
            same = next((o for o in open_ if o[1:] == (s, n)), None)
            now.append((same[0] if same else west, s, n))
        out += [(o[0], o[1], west, o[2]) for o in open_ if o not in now]
        open_ = now
    return out + [(o[0], o[1], xs[-1], o[2]) for o in open_] if boxes else []


def touched(a: np.ndarray, b: np.ndarray, size: float, margin_x: float, margin_y: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, cx, cy) for every grid cell of `size` degrees that an edge a-b touches when the cell is widened by the margins."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    margin = np.array([margin_x, margin_y])
    first, last = np.floor((low - margin) / size).astype(np.int64), np.floor((high + margin) / size).astype(np.int64)
    span = last - first + 1
    count = span[:, 0] * span[:, 1]
    edge = np.repeat(np.arange(len(a)), count)
    k = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
    cell = np.stack([first[edge, 0] + k // span[edge, 1], first[edge, 1] + k % span[edge, 1]], axis=1)
    # A cell whose corners are all on one side of the edge's line is not touched.
    middle, reach = (cell + 0.5) * size, size / 2 + margin
    d = (b - a)[edge]
    away = d[:, 0] * (middle[:, 1] - a[edge, 1]) - d[:, 1] * (middle[:, 0] - a[edge, 0])
    near = np.abs(away) <= np.abs(d[:, 0]) * reach[1] + np.abs(d[:, 1]) * reach[0] + 1e-12
    return edge[near], cell[near, 0], cell[near, 1]


def tiles(rings: Rings, size: float, margin_x: float, margin_y: float):
    """(cx, cy, rings, edges) for each grid cell that the polygon reaches into: its rings cut to the cell, none if
    it covers the whole cell; and the uncut edges that touch the widened cell, as (n, 4) numbers. Slivers stay, and
    a cell is covered only if the cut has its very corners: places lie on a cell's border and within a rounding of it."""
    rings = [r for r in map(clean, rings) if r is not None]
    if not rings:
        return
    a, b = _edges(rings)
    edge, cx, cy = touched(a, b, size, margin_x, margin_y)
    order = np.lexsort((edge, cy, cx))
    edge, cx, cy = edge[order], cx[order], cy[order]
    starts = np.flatnonzero(np.append(True, (np.diff(cx) != 0) | (np.diff(cy) != 0))) if len(edge) else np.zeros(0, np.int64)
    near = {(int(cx[i]), int(cy[i])): edge[i:j] for i, j in zip(starts, [*starts[1:].tolist(), len(edge)])}

    def cells(own: Rings, x0: int, x1: int, y0: int, y1: int):
        if not own:
            return
        if x1 - x0 == 1 and y1 - y0 == 1:
            yield (x0, y0), own
            return
        axis = 0 if x1 - x0 >= y1 - y0 else 1
        m = (x0 + x1) // 2 if axis == 0 else (y0 + y1) // 2
        low, high = ((x0, m, y0, y1), (m, x1, y0, y1)) if axis == 0 else ((x0, x1, y0, m), (x0, x1, m, y1))
        yield from cells(half(own, axis, m * size, -1, 0.0), *low)
        yield from cells(half(own, axis, m * size, 1, 0.0), *high)

    west, south, east, north = np.floor(np.array(box_of(rings)) / size).astype(int)
    for cell, own in cells(rings, west, east + 1, south, north + 1):
        edges = near.pop(cell, None)
        borders = {(x * size, y * size) for x in (cell[0], cell[0] + 1) for y in (cell[1], cell[1] + 1)}
        whole = len(own) == 1 and len(own[0]) == 4 and set(map(tuple, own[0].tolist())) == borders
        yield (*cell, [] if whole else own, np.zeros((0, 4)) if edges is None else np.concatenate([a[edges], b[edges]], axis=1))
    for cell, edges in near.items():
        yield (*cell, None, np.concatenate([a[edges], b[edges]], axis=1))


def read_rings(column: pa.Array) -> list[Rings]:
    """The polygons of an Arrow column array<array<struct<lon,lat>>>, by flat coordinates; null is no ring."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    points = flat.flatten()
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat")], axis=1)
    sizes = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    out = []
    for i in range(len(column)):
        own = [xy[cut[k] : cut[k + 1]] for k in range(first[i], first[i + 1])]
        out.append([r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in own])
    return out


def _points(xy: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], ["lon", "lat"])


def write_rings(polygons: list[Rings]) -> pa.Array:
    """The same column type from polygons, rings closed."""
    closed = [np.concatenate([r, r[:1]]) for rings in polygons for r in rings]
    xy = np.concatenate(closed) if closed else np.zeros((0, 2))
    inner = np.concatenate([[0], np.cumsum([len(r) for r in closed])]).astype(np.int32)
    outer = np.concatenate([[0], np.cumsum([len(rings) for rings in polygons])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), _points(xy)))


def write_edges(edges: list[np.ndarray]) -> pa.Array:
    """array<struct<a,b>> of points from (n, 4) numbers."""
    every = np.concatenate(edges) if edges else np.zeros((0, 4))
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in edges])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([_points(every[:, :2]), _points(every[:, 2:])], ["a", "b"]))

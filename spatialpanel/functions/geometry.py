"""Plane geometry: ear clipping of simple polygons, on small rings in Python."""

from __future__ import annotations


def _cross(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _covers(a: tuple, b: tuple, c: tuple, p: tuple) -> bool:
    return _cross(a, b, p) >= 0 and _cross(b, c, p) >= 0 and _cross(c, a, p) >= 0


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles (vertex indices) of a simple polygon, convex or not.

    Repeated neighbouring vertices and a closing vertex are ignored, collinear
    ones are cut off without a triangle. A ring with fewer than three distinct
    corners or without area gives none. A self-crossing ring is no polygon; what
    it gives is undefined, but the call ends.
    """
    left = [i for i in range(len(ring)) if ring[i] != ring[i - 1]]
    if len(left) < 3:
        return []
    if sum(ring[left[k - 1]][0] * ring[i][1] - ring[i][0] * ring[left[k - 1]][1] for k, i in enumerate(left)) < 0:
        left.reverse()
    found = []
    while len(left) > 2:
        for k, i in enumerate(left):
            h, j = left[k - 1], left[(k + 1) % len(left)]
            turn = _cross(ring[h], ring[i], ring[j])
            if turn == 0:
                break
            inside = (p for p in left if ring[p] not in (ring[h], ring[i], ring[j]))
            if turn > 0 and not any(_covers(ring[h], ring[i], ring[j], ring[p]) for p in inside):
                found.append((h, i, j))
                break
        else:
            break
        del left[k]
    return found


def signed_area(ring: list[tuple[float, float]]) -> float:
    """Twice the area, negative where the ring runs clockwise."""
    return sum(ring[k - 1][0] * p[1] - p[0] * ring[k - 1][1] for k, p in enumerate(ring))


def inside(ring: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    """Even-odd rule; on the boundary either may come out."""
    odd = False
    for k, b in enumerate(ring):
        a = ring[k - 1]
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def _crosses(p: tuple, q: tuple, a: tuple, b: tuple) -> bool:
    """Whether the segments meet elsewhere than in a common end."""
    if p in (a, b) or q in (a, b):
        ends = [e for e in (a, b) if e not in (p, q)]  # a common end: only an overlap of both counts
        return any(_cross(p, q, e) == 0 and (e[0] - p[0]) * (e[0] - q[0]) + (e[1] - p[1]) * (e[1] - q[1]) < 0 for e in ends)
    s, t = _cross(p, q, a), _cross(p, q, b)
    u, v = _cross(a, b, p), _cross(a, b, q)
    return (min(s, t) <= 0 <= max(s, t)) and (min(u, v) <= 0 <= max(u, v))


def bridge(outer: list[tuple[float, float]], holes: list[list[tuple[float, float]]]) -> list[tuple[float, float]]:
    """One ring around the outer ring and its holes, joined by bridges walked both ways.

    Each hole is tied to the nearest corner from which it is seen; holes without
    area are left out. What comes out can be ear-clipped like a simple polygon.
    """
    ring = list(outer) if signed_area(outer) > 0 else list(outer)[::-1]
    left = [h if signed_area(h) < 0 else h[::-1] for h in ([p for k, p in enumerate(h) if p != h[k - 1]] for h in holes) if len(h) > 2 and signed_area(h)]
    while left:
        edges = [(r[k - 1], r[k]) for r in [ring, *left] for k in range(len(r))]
        near = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, i, n, j) for i, p in enumerate(ring) for n, h in enumerate(left) for j, q in enumerate(h))
        for _, i, n, j in near:
            p, q = ring[i], left[n][j]
            if p == q or not any(_crosses(p, q, a, b) for a, b in edges):
                h = left.pop(n)
                ring = ring[: i + 1] + h[j:] + h[: j + 1] + ring[i:]
                break
        else:
            break  # no hole is seen: the rings cross and are no polygon
    return ring

"""Shapes with known answers: quads whose corners are welded and cut into two triangles each."""

import numpy as np

BOX = [
    [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)],
    [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
    [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)],
    [(0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)],
    [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)],
    [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)],
]


def turned(quads, *which):
    return [list(reversed(q)) if i in which else q for i, q in enumerate(quads)]


def wall(x0, y0, x1, y1, z0, z1):
    """A standing wall from one end to the other; its front is on the right of the way there."""
    return [(x0, y0, z0), (x1, y1, z0), (x1, y1, z1), (x0, y0, z1)]


def open_box():
    return [wall(0, 0, 10, 0, 0, 5), wall(10, 10, 0, 10, 0, 5), [(0, 0, 5), (10, 0, 5), (10, 10, 5), (0, 10, 5)]]


def flat(x0, y0, x1, y1, z):
    return [(x0, y0, z), (x1, y0, z), (x1, y1, z), (x0, y1, z)]


def courtyard():
    """A ring 30 wide around a court from 10 to 20, roofed, without floor; the court's south wall, the second quad, is wound wrong."""
    outer = [wall(0, 0, 30, 0, 0, 9), wall(30, 0, 30, 30, 0, 9), wall(30, 30, 0, 30, 0, 9), wall(0, 30, 0, 0, 0, 9)]
    court = [wall(10, 10, 20, 10, 0, 9), wall(10, 20, 20, 20, 0, 9), wall(20, 20, 20, 10, 0, 9), wall(10, 10, 10, 20, 0, 9)]
    roof = [flat(0, 0, 30, 10, 9), flat(0, 20, 30, 30, 9), flat(0, 10, 10, 20, 9), flat(20, 10, 30, 20, 9)]
    return [outer[0], *court, *outer[1:], *roof]


def mesh(quads, places=6):
    corners = np.round(np.array(quads, float).reshape(-1, 3), places)
    vertices, index = np.unique(corners, axis=0, return_inverse=True)
    index = index.reshape(-1, 4)
    return vertices, np.concatenate([index[:, [0, 1, 2]], index[:, [0, 2, 3]]], axis=1).reshape(-1, 3)


def normals(vertices, faces):
    a, b, c = (vertices[faces[:, k]] for k in range(3))
    n = np.cross(b - a, c - a)
    return n / np.linalg.norm(n, axis=1, keepdims=True)

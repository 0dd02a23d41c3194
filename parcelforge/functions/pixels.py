"""Pixel work on grey images as NumPy arrays, for use inside mapInPandas."""

from __future__ import annotations

import numpy as np

# Dark and light limits, least sizes of lines, sizes of the brushes.
INK, PAPER = 180, 170
SMALL_PAGE, SMALL_ZONE = 2200, 600
TABLE_BRUSH = 43


def to_grey(rgb: np.ndarray) -> np.ndarray:
    """Luminance of an image with colour channels last."""
    return rgb if rgb.ndim == 2 else np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def autocontrast(grey: np.ndarray) -> np.ndarray:
    low, high = int(grey.min()), int(grey.max())
    return grey if low == high else ((grey.astype(float) - low) * 255 / (high - low)).astype(np.uint8)


def enlarge(grey: np.ndarray, times: int = 2) -> np.ndarray:
    """Bilinear enlargement."""
    h, w = grey.shape

    def grid(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n * times) + 0.5) / times - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = grid(h)
    x0, x1, fx = grid(w)
    g = grey.astype(float)
    top = g[y0][:, x0] * (1 - fx) + g[y0][:, x1] * fx
    bottom = g[y1][:, x0] * (1 - fx) + g[y1][:, x1] * fx
    return np.rint(top * (1 - fy[:, None]) + bottom * fy[:, None]).astype(np.uint8)


def sharpen(grey: np.ndarray) -> np.ndarray:
    """Each inner pixel against its eight neighbours; the border stays."""
    g = grey.astype(int)
    out = g.copy()
    around = sum(g[1 + a : g.shape[0] - 1 + a, 1 + b : g.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
    out[1:-1, 1:-1] = np.clip((32 * g[1:-1, 1:-1] - 2 * around) / 16, 0, 255)
    return out.astype(np.uint8)


def prepared(image: np.ndarray, small: int = SMALL_PAGE) -> tuple[np.ndarray, np.ndarray]:
    """(sharpened grey image, its black-and-white form), enlarged if the image is narrow."""
    grey = autocontrast(to_grey(image))
    if grey.shape[1] < small:
        grey = enlarge(grey)
    sharp = sharpen(grey)
    return sharp, np.where(sharp > PAPER, 255, 0).astype(np.uint8)


def long_runs(mask: np.ndarray, least: int, axis: int) -> np.ndarray:
    """The parts of a mask that lie in runs of at least `least` pixels along an axis."""
    m = mask if axis == 1 else mask.T
    edge = np.zeros((m.shape[0], 1), np.int8)
    step = np.diff(np.concatenate([edge, m.astype(np.int8), edge], axis=1), axis=1)
    row, start = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    keep = stop - start >= least
    marks = np.zeros((m.shape[0], m.shape[1] + 1), np.int32)
    np.add.at(marks, (row[keep], start[keep]), 1)
    np.add.at(marks, (row[keep], stop[keep]), -1)
    out = np.cumsum(marks, axis=1)[:, :-1] > 0
    return out if axis == 1 else out.T


def dilate(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """A mask grown by a rectangle about each pixel."""

    def along(m: np.ndarray, size: int, axis: int) -> np.ndarray:
        before, after = size // 2, size - 1 - size // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (after + 1, before)
        total = np.cumsum(np.pad(m.astype(np.int32), pad), axis=axis)
        n = m.shape[axis]
        return np.take(total, np.arange(size, size + n), axis=axis) > np.take(total, np.arange(n), axis=axis)

    return along(along(mask, width, 1), height, 0)


def component_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of each connected part of a mask, neighbours at corners included."""
    edge = np.zeros((mask.shape[0], 1), np.int8)
    step = np.diff(np.concatenate([edge, mask.astype(np.int8), edge], axis=1), axis=1)
    rows, starts = np.nonzero(step == 1)
    _, stops = np.nonzero(step == -1)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= stops[j] and starts[j] <= stops[i]:
                parent[root(int(j))] = root(int(i))
            if stops[i] < stops[j]:
                i += 1
            else:
                j += 1
    boxes: dict[int, list[int]] = {}
    for k in range(len(rows)):
        b = boxes.setdefault(root(k), [int(starts[k]), int(rows[k]), int(stops[k]), int(rows[k]) + 1])
        b[0], b[1], b[2], b[3] = min(b[0], int(starts[k])), min(b[1], int(rows[k])), max(b[2], int(stops[k])), max(b[3], int(rows[k]) + 1)
    return [(a, b, c - a, d - b) for a, b, c, d in boxes.values()]


def table_regions(grey: np.ndarray, least_area: float = 0.03, least_width: float = 0.2) -> list[tuple[int, int, int, int]]:
    """Boxes round the ruled tables of a page, from top to bottom."""
    h, w = grey.shape
    ink = grey <= INK
    ruled = long_runs(ink, max(w // 8, 100), 1) | long_runs(ink, max(h // 15, 50), 0)
    boxes = component_boxes(dilate(ruled, TABLE_BRUSH, TABLE_BRUSH))
    return sorted((b for b in boxes if b[2] * b[3] >= least_area * w * h and b[2] >= least_width * w), key=lambda b: b[1])


def without_lines(grey: np.ndarray) -> np.ndarray:
    """The page with its ruled lines painted white."""
    h, w = grey.shape
    ink = grey <= INK
    lines = long_runs(ink, max(w // 4, 80), 1) | long_runs(ink, max(h // 8, 40), 0)
    return np.where(dilate(lines, 5, 5), 255, grey).astype(np.uint8)


def text_boxes(probability: np.ndarray, width: int, height: int, threshold: float = 0.3, least_area: int = 100) -> list[tuple[int, int, int, int]]:
    """Boxes of text on a page of the given size out of a detector's map, in reading order."""
    mask = dilate(dilate(probability > threshold, 3, 15), 3, 15)
    sx, sy = width / mask.shape[1], height / mask.shape[0]
    boxes = [(int(x * sx), int(y * sy), int(w * sx), int(h * sy)) for x, y, w, h in component_boxes(mask)]
    return sorted((b for b in boxes if b[2] * b[3] >= least_area), key=lambda b: (b[1], b[0]))

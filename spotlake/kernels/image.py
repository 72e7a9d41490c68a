"""Array kernels on one tile: normalising, smoothing, morphology, labelling, distances and measurement (numpy only)."""

from __future__ import annotations

import numpy as np


def gray(a: np.ndarray) -> np.ndarray:
    """One channel: two channels drop alpha, three or four are weighed by Rec. 709."""
    if a.ndim == 2:
        return a
    if a.shape[2] == 2:
        return a[..., 0]
    return a[..., :3].astype(np.float32) @ np.array([0.2126, 0.7152, 0.0722], np.float32)


def normalize(a: np.ndarray, low: float, high: float, invert: bool = False) -> np.ndarray:
    """float32 in [0, 1] between ``low`` and ``high``; NaN counts as low, infinities as the ends; inverted last."""
    x = np.nan_to_num(a.astype(np.float32), nan=low, posinf=high, neginf=low)
    x = np.clip((x - low) / max(high - low, 1e-12), 0, 1)
    return (1 - x if invert else x).astype(np.float32)


def as_float01(a: np.ndarray) -> np.ndarray:
    """Integers over the range of their type; floats within [0, 1] as they are, else stretched from least to greatest."""
    if np.issubdtype(a.dtype, np.integer):
        return (a / np.iinfo(a.dtype).max).astype(np.float32)
    x = np.nan_to_num(a.astype(np.float32))
    low, high = (float(x.min()), float(x.max())) if x.size else (0.0, 1.0)
    return x if low >= 0 and high <= 1 else normalize(x, low, high)


def median3(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="symmetric")
    return np.median(np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(a.dtype)


def _along(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    r = len(k) // 2
    width = [(0, 0), (0, 0)]
    width[axis] = (r, r)
    p = np.pad(a, width, mode="symmetric")
    n = a.shape[axis]
    return sum(w * np.take(p, range(i, i + n), axis=axis) for i, w in enumerate(k))


def gaussian(a: np.ndarray, sigma: float, order: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Gaussian smoothing or derivative, cut at four sigma, edges mirrored."""
    r = int(4 * sigma + 0.5)
    x = np.arange(-r, r + 1)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    kernels = {0: g, 1: -x / sigma**2 * g, 2: (x**2 / sigma**4 - 1 / sigma**2) * g}
    return _along(_along(a.astype(np.float64), kernels[order[0]][::-1], 0), kernels[order[1]][::-1], 1)


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    return _along(_along(a.astype(np.float64), np.full(size, 1 / size), 0), np.full(size, 1 / size), 1)


def _running(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Running maximum (minimum) of rows over an odd width, edges mirrored, by block-wise running extremes."""
    r = width // 2
    p = np.pad(a, ((0, 0), (r, r)), mode="symmetric")
    n = p.shape[1]
    fill = np.full((p.shape[0], -n % width), np.inf if least else -np.inf, p.dtype)
    b = np.concatenate([p, fill], axis=1).reshape(p.shape[0], -1, width)
    f = np.minimum if least else np.maximum
    ahead = f.accumulate(b, axis=2).reshape(p.shape[0], -1)
    back = f.accumulate(b[:, :, ::-1], axis=2)[:, :, ::-1].reshape(p.shape[0], -1)
    return f(back[:, : n - width + 1], ahead[:, width - 1 : n])


def disc_extreme(a: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Grey dilation (erosion) by a disc of odd diameter: rows of the disc are running extremes of their width."""
    r = size // 2
    p = np.pad(a, ((r, r), (0, 0)), mode="symmetric")
    out = None
    f = np.minimum if least else np.maximum
    for dy in range(-r, r + 1):
        half = int(np.sqrt(max(0.0, (r + 0.5) ** 2 - dy**2)))
        row = _running(p[r + dy : r + dy + a.shape[0]], 2 * min(half, r) + 1, least)
        out = row if out is None else f(out, row)
    return out


def closing(a: np.ndarray, size: int) -> np.ndarray:
    return disc_extreme(disc_extreme(a, size, False), size, True)


def opening(a: np.ndarray, size: int) -> np.ndarray:
    return disc_extreme(disc_extreme(a, size, True), size, False)


def dark_response(a: np.ndarray, valid: np.ndarray | None = None, background: int = 101, sigma: float = 1.0, contrast: float = 0.0, stripes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(response, background): how much darker than its closed surroundings; 0 outside the valid mask.

    Invalid pixels are filled with the median of the valid ones; then, if asked for, local equalisation (clipped at
    ``contrast``) and stripe suppression over ``stripes`` pixels; then median, Gaussian and closing.
    """
    a = a.astype(np.float32)
    if valid is not None and not valid.all():
        a = np.where(valid, a, np.median(a[valid]) if valid.any() else 0).astype(np.float32)
    if contrast:
        a = clahe(a, contrast)
    if stripes:
        a = suppress_stripes(a, stripes)
    work = gaussian(median3(a), sigma).astype(np.float32)
    back = closing(work, background)
    out = np.maximum(back - work, 0)
    return (out if valid is None else np.where(valid, out, 0)), back


def reach(background: int, sigma: float = 1.0) -> int:
    """Pixels around a pixel on which its ``dark_response`` depends: median, Gaussian and closing."""
    return 1 + int(4 * sigma + 0.5) + 2 * (background // 2)


def blackhat(a: np.ndarray, sizes: tuple[int, ...] = (9, 17, 31)) -> np.ndarray:
    """How much darker a pixel is than its surroundings closed at several scales, the greatest of them."""
    out = np.zeros(a.shape, a.dtype)
    for size in sizes:
        np.maximum(out, closing(a, size) - a, out=out)
    return out


def clahe(a: np.ndarray, clip: float = 2.0, grid: int = 8, bins: int = 256) -> np.ndarray:
    """Contrast-limited local equalisation of values in [0, 1]: clipped histograms on a grid, blended between its cells."""
    levels = np.rint(np.clip(a, 0, 1) * (bins - 1)).astype(int)
    h, w = a.shape
    sh, sw = -(-h // grid), -(-w // grid)
    padded = np.pad(levels, ((0, sh * grid - h), (0, sw * grid - w)), mode="reflect" if min(h, w) > grid else "edge")
    limit = max(1, int(clip * sh * sw / bins))
    curves = np.empty((grid, grid, bins))
    for i in range(grid):
        for j in range(grid):
            n = np.bincount(padded[i * sh : (i + 1) * sh, j * sw : (j + 1) * sw].ravel(), minlength=bins)
            extra = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + extra / bins
            curves[i, j] = np.cumsum(n) / (sh * sw)
    y, x = (np.arange(h) + 0.5) / sh - 0.5, (np.arange(w) + 0.5) / sw - 0.5
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - i)[:, None], (x - j)[None, :]
    at = lambda di, dj: curves[np.clip(i + di, 0, grid - 1)[:, None], np.clip(j + dj, 0, grid - 1)[None, :], levels]
    mixed = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
    return np.clip(mixed, 0, 1).astype(np.float32)


def blobs(a: np.ndarray, least: float = 1.0, most: float = 6.0, ratio: float = 1.6, threshold: float = 0.05, overlap: float = 0.5) -> list[tuple[int, int, float]]:
    """(y, x, sigma) of the peaks of Gaussian differences over position and scale.

    Of two discs of radius sqrt(2) sigma of which the smaller is covered by more than ``overlap``, the one of the greater
    sigma stays.
    """
    n = int(np.log(most / least) / np.log(ratio) + 1)
    sigmas = [least * ratio**i for i in range(n + 1)]
    smooth = [gaussian(a, s) for s in sigmas]
    cube = np.stack([(smooth[i] - smooth[i + 1]) / (ratio - 1) for i in range(n)])
    p = np.pad(cube, 1, constant_values=-np.inf)
    around = np.max([p[k : k + n, i : i + a.shape[0], j : j + a.shape[1]] for k in range(3) for i in range(3) for j in range(3)], axis=0)
    found = [(int(y), int(x), float(sigmas[k])) for k, y, x in np.argwhere((cube == around) & (cube > threshold))]
    kept: list[tuple[int, int, float]] = []
    for y, x, s in sorted(found, key=lambda b: (-b[2], b[0], b[1])):
        if all(_covered(np.hypot(y - v, x - u), np.sqrt(2) * t, np.sqrt(2) * s) <= overlap for v, u, t in kept):
            kept.append((y, x, s))
    return kept


def _covered(d: float, large: float, small: float) -> float:
    """Share of the smaller disc that lies in the larger one, centres ``d`` apart."""
    if d >= large + small:
        return 0.0
    if d <= large - small:
        return 1.0
    a = np.arccos(np.clip((d * d + small**2 - large**2) / (2 * d * small), -1, 1))
    b = np.arccos(np.clip((d * d + large**2 - small**2) / (2 * d * large), -1, 1))
    area = small**2 * (a - np.sin(2 * a) / 2) + large**2 * (b - np.sin(2 * b) / 2)
    return float(area / (np.pi * small**2))


def blob_mask(a: np.ndarray, valid: np.ndarray, **how) -> np.ndarray:
    """Discs around the blobs of the valid part."""
    out = np.zeros(a.shape, bool)
    for y, x, s in blobs(np.where(valid, a, 0), **how):
        r = max(1, int(np.ceil(np.sqrt(2) * s)))
        v, u = np.ogrid[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
        v, u = v[: a.shape[0] - max(0, y - r)], u[:, : a.shape[1] - max(0, x - r)]
        out[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] |= (v - y) ** 2 + (u - x) ** 2 <= r * r
    return out & valid


def polygon_mask(shape: tuple[int, int], corners: np.ndarray, x0: float = 0.0, y0: float = 0.0) -> np.ndarray:
    """Pixels whose centre lies inside a polygon (even-odd), or on its boundary's left or upper part."""
    h, w = shape
    crossed = np.zeros((h, w + 1), np.int64)
    points = np.asarray(corners, float).reshape(-1, 2) - [x0, y0]
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0), strict=True):
        low, high = (ay, by) if ay < by else (by, ay)
        ys = np.arange(max(0, int(np.ceil(low))), min(h, int(np.ceil(high))))
        if len(ys):
            xs = ax + (ys - ay) * (bx - ax) / (by - ay)
            np.add.at(crossed, (ys, np.clip(np.ceil(xs), 0, w).astype(int)), 1)
    return np.cumsum(crossed, axis=1)[:, :w] % 2 == 1


def ring_background(raw: np.ndarray, labels: np.ndarray, k: int, valid: np.ndarray, ring: int) -> float:
    """Median of the valid pixels around component ``k`` that no component holds; NaN if there are none."""
    ys, xs = np.nonzero(labels == k)
    if not len(ys):
        return float("nan")
    part = np.s_[max(0, ys.min() - ring) : ys.max() + ring + 1, max(0, xs.min() - ring) : xs.max() + ring + 1]
    own = labels[part] == k
    near = disc_extreme(np.pad(own, ring).astype(np.float32), 2 * ring + 1, False)[ring:-ring, ring:-ring] > 0
    values = raw[part][near & (labels[part] == 0) & valid[part]]
    return float(np.median(values)) if len(values) else float("nan")


def suppress_stripes(a: np.ndarray, size: int = 51) -> np.ndarray:
    """Row and column profiles (medians) less their own sliding median, taken out."""
    for axis in (1, 0):
        profile = np.median(a, axis=axis)
        p = np.pad(profile, size // 2, mode="edge")
        smooth = np.median(np.lib.stride_tricks.sliding_window_view(p, size), axis=1)
        a = a - np.expand_dims(profile - smooth, axis)
    return a


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components in raster order: runs of rows, joined where they touch the runs above."""
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    d = np.diff(flat, axis=1)
    ry, rs = np.nonzero(d == 1)
    _, re = np.nonzero(d == -1)
    n = len(ry)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ry, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if rs[i] <= re[j] and rs[j] <= re[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if re[i] < re[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(n)], dtype=np.int64)
    names, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w), np.int32)
    for y, s, e, k in zip(ry, rs, re, number, strict=True):
        out[y, s:e] = k + 1
    return out, len(names)


def edt(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of every true pixel to the nearest false one, the outside counting as false."""
    m = np.pad(mask, 1)
    h, w = m.shape
    far = float(h + w)
    up = np.full((h, w), far)
    up[0] = np.where(m[0], far, 0)
    for y in range(1, h):
        up[y] = np.where(m[y], up[y - 1] + 1, 0)
    for y in range(h - 2, -1, -1):
        up[y] = np.minimum(up[y], up[y + 1] + 1)
    square = up**2
    best = square.copy()
    top = int(min(w, np.sqrt(square.max()) + 1))
    for dx in range(1, top + 1):
        if dx * dx >= best.max():
            break
        best[:, dx:] = np.minimum(best[:, dx:], square[:, :-dx] + dx * dx)
        best[:, :-dx] = np.minimum(best[:, :-dx], square[:, dx:] + dx * dx)
    return np.sqrt(best)[1:-1, 1:-1]


def hull_area(ys: np.ndarray, xs: np.ndarray) -> float:
    """Area of the convex hull of pixel squares."""
    corners = np.unique(np.concatenate([np.column_stack([xs + a, ys + b]) for a in (0, 1) for b in (0, 1)]), axis=0)

    def chain(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(chain(corners.tolist()) + chain(corners[::-1].tolist()), float)
    x, y = hull[:, 0], hull[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def measure(labels: np.ndarray, n: int, raw: np.ndarray, response: np.ndarray, background: np.ndarray, distance: np.ndarray) -> list[dict]:
    """Sums and moments per component; ratios and rules are left to column expressions."""
    if not n:
        return []
    ys, xs = np.nonzero(labels)
    order = np.argsort(labels[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    cuts = np.searchsorted(labels[ys, xs], np.arange(1, n + 2))
    border = np.pad(labels, 1)
    out = []
    for k in range(n):
        y, x = ys[cuts[k] : cuts[k + 1]], xs[cuts[k] : cuts[k + 1]]
        cy, cx = y.mean(), x.mean()
        mu = np.array([[((x - cx) ** 2).mean() + 1 / 12, ((x - cx) * (y - cy)).mean()], [((x - cx) * (y - cy)).mean(), ((y - cy) ** 2).mean() + 1 / 12]])
        small, large = np.linalg.eigvalsh(mu)
        inner = border[1 + y, x] == k + 1, border[1 + y, x + 2] == k + 1, border[y, x + 1] == k + 1, border[y + 2, x + 1] == k + 1
        edge = ~(inner[0] & inner[1] & inner[2] & inner[3])
        sides = 4 * len(y) - int(sum(i.sum() for i in inner))
        out.append({
            "area_px": len(y), "centroid_x_px": float(cx), "centroid_y_px": float(cy), "perimeter_px": sides * np.pi / 4, "border_px": int(edge.sum()),
            "major_axis_length_px": 4 * float(np.sqrt(large)), "minor_axis_length_px": 4 * float(np.sqrt(small)),
            "eccentricity": float(np.sqrt(max(0.0, 1 - small / large))), "solidity": min(1.0, len(y) / max(hull_area(y, x), 1e-9)),
            "mean_gray_raw": float(raw[y, x].mean()), "mean_dark_response": float(response[y, x].mean()), "local_background_gray": float(background[y, x].mean()),
            "min_boundary_px": float(distance[y, x].min()), "bounding_box": [int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1],
        })
    return out


def clean(mask: np.ndarray, min_area: int) -> tuple[np.ndarray, int]:
    labels, n = label(mask)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    keep = sizes >= min_area
    keep[0] = False
    names = np.cumsum(keep) * keep
    return names[labels].astype(np.int32), int(keep.sum())


def split_touching(labels: np.ndarray, n: int, spacing: int = 5, min_area: int = 20, max_eccentricity: float = 0.92) -> tuple[np.ndarray, int]:
    """Cut round components that hold several distance peaks between the peaks; elongated ones stay whole."""
    out, count = labels.copy(), n
    for k in range(1, n + 1):
        ys, xs = np.nonzero(labels == k)
        if len(ys) < min_area:
            continue
        cov = np.cov(np.stack([xs, ys])) + np.eye(2) / 12
        small, large = np.linalg.eigvalsh(cov)
        if np.sqrt(max(0.0, 1 - small / large)) > max_eccentricity:
            continue
        y0, x0 = ys.min(), xs.min()
        part = labels[y0 : ys.max() + 1, x0 : xs.max() + 1] == k
        d = gaussian(edt(part), 1.0) * part
        peaks = []
        for i in np.argsort(-d[part], kind="stable"):
            y, x = np.argwhere(part)[i]
            if d[y, x] < 0.35 * d.max():
                break
            if all(max(abs(y - a), abs(x - b)) >= spacing for a, b in peaks) and d[y, x] >= d[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max():
                peaks.append((y, x))
        if len(peaks) > 1:
            yy, xx = np.nonzero(part)
            near = np.argmin([(yy - a) ** 2 + (xx - b) ** 2 for a, b in peaks], axis=0)
            for j in range(1, len(peaks)):
                count += 1
                out[yy[near == j] + y0, xx[near == j] + x0] = count
    return out, count


def pixel_features(a: np.ndarray) -> np.ndarray:
    """17 channels per pixel: raw, three Gaussians, two differences, two local means and deviations, gradient, two
    Laplacians, Hessian trace and determinant, coherence, and darkness against the widest mean. No coordinates."""
    a = a.astype(np.float64)
    g = [gaussian(a, s) for s in (0.7, 1.5, 3.0)]
    local = []
    for size in (5, 11):
        m = box_mean(a, size)
        local += [m, np.sqrt(np.maximum(box_mean(a * a, size) - m * m, 0))]
    dx, dy = gaussian(a, 1.0, (0, 1)), gaussian(a, 1.0, (1, 0))
    laplace = [gaussian(a, s, (2, 0)) + gaussian(a, s, (0, 2)) for s in (1.5, 3.0)]
    hyy, hxx, hxy = gaussian(a, 1.5, (2, 0)), gaussian(a, 1.5, (0, 2)), gaussian(a, 1.5, (1, 1))
    jxx, jyy, jxy = gaussian(dx * dx, 1.5), gaussian(dy * dy, 1.5), gaussian(dx * dy, 1.5)
    coherence = np.sqrt((jxx - jyy) ** 2 + 4 * jxy**2) / (jxx + jyy + 1e-12)
    return np.stack([a, *g, g[0] - g[1], g[1] - g[2], *local, np.hypot(dx, dy), *laplace, hxx + hyy, hxx * hyy - hxy**2, coherence, np.maximum(local[2] - a, 0)], axis=-1)


HALO = 18  # reach of the widest filter of pixel_features


def fit_circle(ys: np.ndarray, xs: np.ndarray, rounds: int = 20) -> tuple[float, float, float, float]:
    """(cx, cy, r, rms residual) of a circle through boundary points, far points weighed down (soft L1)."""
    weight = np.ones(len(xs))
    for _ in range(rounds):
        m = np.column_stack([xs, ys, np.ones(len(xs))])
        b = xs**2 + ys**2
        sol = np.linalg.lstsq(m * weight[:, None], b * weight, rcond=None)[0]
        cx, cy = sol[0] / 2, sol[1] / 2
        r = np.sqrt(max(0.0, sol[2] + cx**2 + cy**2))
        res = np.hypot(xs - cx, ys - cy) - r
        scale = max(np.median(np.abs(res)), 1e-6)
        weight = (1 + (res / scale) ** 2) ** -0.25
    return float(cx), float(cy), float(r), float(np.sqrt((res**2).mean()))

"""Per-image NumPy helpers. One image at a time; Spark partitions the collection."""

from __future__ import annotations

import numpy as np

# Luma weights for red, green, blue.
LUMA = np.array([0.299, 0.587, 0.114])
# 3x3 smoothing kernel behind sharpness, and the strong edge-enhance kernel.
SMOOTH = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13.0
EDGE_MORE = np.array([[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]], dtype=float)
WHITE = 255.0


def to_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """Pixels as float HxWxC in RGB(A) order from the blue-green-red bytes of the image source."""
    if data is None or height is None or height <= 0 or width <= 0 or len(data) != height * width * channels:
        return None
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(float)
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    order = [2, 1, 0] + ([3] if channels == 4 else [])
    return a[:, :, order]


def to_bytes(a: np.ndarray) -> bytes:
    """Back to blue-green-red bytes with three channels."""
    return np.clip(np.rint(a[:, :, [2, 1, 0]]), 0, 255).astype(np.uint8).tobytes()


def gray(a: np.ndarray) -> np.ndarray:
    return np.rint(a[:, :, :3] @ LUMA)


def filter3(a: np.ndarray, kernel: np.ndarray, border: str = "edge") -> np.ndarray:
    pad = ((1, 1), (1, 1)) + ((0, 0),) * (a.ndim - 2)
    p = np.pad(a, pad, mode="edge" if border == "reflect" and min(a.shape[:2]) < 2 else border)
    h, w = a.shape[:2]
    return sum(kernel[i, j] * p[i : i + h, j : j + w] for i in range(3) for j in range(3))


def blur_score(a: np.ndarray) -> float:
    laplace = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], dtype=float)
    return float(filter3(gray(a), laplace, "reflect").var())


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with half-pixel centres."""
    h, w = a.shape[:2]

    def axis(n_out: int, n_in: int):
        pos = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        low = np.floor(pos).astype(int)
        return low, np.minimum(low + 1, n_in - 1), pos - low

    y0, y1, fy = axis(height, h)
    x0, x1, fx = axis(width, w)
    fy, fx = fy[:, None, None], fx[None, :, None]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy)


def average_hash(a: np.ndarray) -> str:
    g = gray(resize(a[:, :, :3], 8, 8))
    return "".join("1" if v else "0" for v in (g > g.mean()).ravel())


def channel_stats(a: np.ndarray) -> tuple[float, float]:
    """Mean of the channel means and of the channel deviations."""
    flat = a.reshape(-1, a.shape[2])
    return float(flat.mean(axis=0).mean()), float(flat.std(axis=0).mean())


def brightness_factor(level: float) -> float:
    if level < 50:
        return 1.3
    if level > 200:
        return 0.8
    return max(0.7, min(1.5, 128 / level))


def contrast_factor(spread: float) -> float:
    return 1.4 if spread < 30 else 1.2 if spread < 50 else 1.1


def blend(base: np.ndarray, other: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(np.rint(base + (other - base) * factor), 0, 255)


def sharpen(a: np.ndarray) -> np.ndarray:
    sharp = blend(filter3(a, SMOOTH), a, 1.3)
    return blend(sharp, np.clip(filter3(sharp, EDGE_MORE), 0, 255), 0.3)


def letterbox(a: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = a.shape[:2]
    ratio = min(width / w, height / h)
    nh, nw = max(1, int(h * ratio)), max(1, int(w * ratio))
    out = np.full((height, width, 3), WHITE)
    top, left = (height - nh) // 2, (width - nw) // 2
    out[top : top + nh, left : left + nw] = resize(a[:, :, :3], nh, nw)
    return out


def flatten_alpha(a: np.ndarray) -> np.ndarray:
    if a.shape[2] != 4:
        return a
    alpha = a[:, :, 3:] / 255.0
    return np.rint(a[:, :, :3] * alpha + WHITE * (1 - alpha))


def features(a: np.ndarray) -> list[float]:
    """37 values: colour means and deviations, gray texture, edges, histograms, shape, blur, brightness."""
    rgb = resize(a[:, :, :3], 64, 64)
    g = gray(rgb)
    flat = rgb.reshape(-1, 3)
    sx = filter3(g, np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], dtype=float), "reflect")
    sy = filter3(g, np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]], dtype=float), "reflect")
    edges = float((np.hypot(sx, sy) > 150).mean())
    hists = [np.histogram(flat[:, c], bins=8, range=(0, 256))[0] / len(flat) for c in range(3)]
    std = float(g.std())
    h, w = a.shape[:2]
    return [*flat.mean(axis=0), *flat.std(axis=0), std, 1 / (1 + std), edges, *np.concatenate(hists),
            w / h, h * w / (512 * 512), blur_score(rgb), float(g.mean())]

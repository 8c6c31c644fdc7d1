"""Per-image measurements on numpy arrays: small helpers for the image feature job."""

from __future__ import annotations

import numpy as np

# Grey weights, region names, and metrics reported for unreadable images.
GREY = (0.2989, 0.5870, 0.1140)
REGIONS = ("TL", "TR", "BL", "BR", "C")
FALLBACK_METRICS = {
    "brightness": 0.5,
    "contrast": 0.2,
    "sharpness": 100.0,
    "saturation": 0.3,
    "r_mean": 0.5,
    "g_mean": 0.5,
    "b_mean": 0.5,
    "high_freq_energy": 50.0,
}
METRICS = tuple(FALLBACK_METRICS)


def _cubic(x: np.ndarray) -> np.ndarray:
    x, a = np.abs(x), -0.5
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


KERNELS = {"cubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0)}


def resampling(size_in: int, size_out: int, kernel: str) -> np.ndarray:
    """Weights (size_out x size_in) of an antialiased resize along one axis."""
    function, support = KERNELS[kernel]
    ratio = size_in / size_out
    stretch = max(1.0, ratio)
    centres = (np.arange(size_out) + 0.5) * ratio
    offsets = (np.arange(size_in)[None, :] + 0.5 - centres[:, None]) / stretch
    weights = np.where(np.abs(offsets) <= support, function(offsets), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, kernel: str = "cubic") -> np.ndarray:
    """Resize an 8-bit image, rounding to 8 bits after each axis."""
    def axis(data: np.ndarray, size: int) -> np.ndarray:
        if data.shape[0] == size:
            return data
        mixed = np.tensordot(resampling(data.shape[0], size, kernel), data.astype(np.float64), axes=1)
        return np.clip(np.floor(mixed + 0.5), 0, 255).astype(np.uint8)

    across = axis(image.swapaxes(0, 1), width).swapaxes(0, 1)
    return axis(across, height)


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Raw BGR(A) or grey bytes to an RGB array."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1]


def luma(rgb: np.ndarray) -> np.ndarray:
    """8-bit grey by integer weights."""
    r, g, b = (rgb[:, :, i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def _grey(scaled: np.ndarray) -> np.ndarray:
    return sum(w * scaled[:, :, i] for i, w in enumerate(GREY))


def visual_vector(rgb: np.ndarray) -> np.ndarray:
    """15 numbers: channel means and deviations of the whole and the centre, two channel
    ratios and the gradient energy."""
    pixels = resize(rgb, 64, 64).astype(np.float32) / 255.0
    centre = pixels[16:48, 16:48]
    r, g, b = centre.mean(axis=(0, 1))
    grey = _grey(pixels)
    energy = np.abs(np.diff(grey, axis=1)).mean() + np.abs(np.diff(grey, axis=0)).mean()
    parts = [pixels.mean(axis=(0, 1)), pixels.std(axis=(0, 1)), centre.mean(axis=(0, 1)), centre.std(axis=(0, 1))]
    return np.hstack([*parts, [b / (r + 1e-4), r / (g + 1e-4), energy]]).astype(np.float32)


def image_metrics(rgb: np.ndarray) -> dict[str, float]:
    """Brightness, contrast, sharpness, saturation, channel means, corner FFT energy."""
    small = resize(rgb, 128, 128)
    pixels = small.astype(np.float32) / 255.0
    grey = _grey(pixels)
    eight = np.pad((grey * 255).astype(np.uint8).astype(np.float64), 1, mode="reflect")
    laplacian = eight[:-2, 1:-1] + eight[2:, 1:-1] + eight[1:-1, :-2] + eight[1:-1, 2:] - 4 * eight[1:-1, 1:-1]
    top = small.max(axis=2).astype(np.float64)
    spread = top - small.min(axis=2)
    saturation = np.where(top > 0, np.floor(255.0 * spread / np.maximum(top, 1) + 0.5), 0.0)
    spectrum = 20 * np.log(np.abs(np.fft.fftshift(np.fft.fft2(grey))) + 1e-7)
    red, green, blue = (float(pixels[:, :, i].mean()) for i in range(3))
    return {
        "brightness": round(float(grey.mean()), 4),
        "contrast": round(float(grey.std()), 4),
        "sharpness": round(float(laplacian.var()), 2),
        "saturation": round(float(saturation.mean() / 255.0), 4),
        "r_mean": round(red, 4),
        "g_mean": round(green, 4),
        "b_mean": round(blue, 4),
        "high_freq_energy": round(float(spectrum[:32, :32].mean()), 3),
    }


def patch_vectors(rgb: np.ndarray, size: int = 16) -> dict[str, np.ndarray]:
    """Unit vectors of the corner and centre patches; flat patches are left out."""
    pixels = resize(rgb, 128, 128).astype(np.float32) / 255.0
    low, high, mid = 0, 128 - size, 64 - size // 2
    corners = {"TL": (low, low), "TR": (low, high), "BL": (high, low), "BR": (high, high), "C": (mid, mid)}
    out = {}
    for name in REGIONS:
        top, left = corners[name]
        patch = pixels[top : top + size, left : left + size]
        length = np.linalg.norm(patch)
        if patch.std() >= 0.10 and length > 0:
            out[name] = patch.ravel() / length
    return out


def _bits(flags: np.ndarray) -> int:
    value = int("".join("1" if f else "0" for f in flags.ravel()), 2)
    return value - (1 << 64) if value >> 63 else value


def cosine_basis(size: int) -> np.ndarray:
    """Unscaled DCT-II matrix."""
    k, n = np.arange(size)[:, None], np.arange(size)[None, :]
    return 2.0 * np.cos(np.pi * k * (2 * n + 1) / (2 * size))


def frequency_hash(rgb: np.ndarray) -> int:
    """64 bits: which of the 8x8 lowest DCT terms exceed their median."""
    grey = resize(luma(rgb), 32, 32, "lanczos").astype(np.float64)
    basis = cosine_basis(32)[:8]
    low = basis @ grey @ basis.T
    return _bits(low > np.median(low))


def gradient_hash(rgb: np.ndarray) -> int:
    """64 bits: whether each of 8x9 grey cells is darker than its right neighbour."""
    grey = resize(luma(rgb), 8, 9, "lanczos").astype(np.int16)
    return _bits(grey[:, 1:] > grey[:, :-1])

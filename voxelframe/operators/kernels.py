"""Image kernels on numpy arrays, and the batch function that runs them over image rows.

Images are (n, h, w) float arrays. Nothing here holds more than one Arrow
batch of images.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def per_image(images: DataFrame, function, width: str = "w", pixels: str = "px", key: str = "image_ix", batch: int = 64) -> DataFrame:
    """(key, f): function of stacked images(key, w, px array) as one feature row each; images of one size together."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                sizes = part.column(1).to_numpy()
                out: list = [None] * part.num_rows
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    x = np.stack([part.column(2)[int(i)].values.to_numpy(zero_copy_only=False) for i in at]).astype(float)
                    for i, row in zip(at, np.asarray(function(x.reshape(len(at), -1, int(size)))).reshape(len(at), -1), strict=True):
                        out[i] = row
                ends = np.cumsum([0, *map(len, out)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out), pa.float64()))], [key, "f"])

    kind = dict(images.dtypes)[key]
    return images.select(key, width, pixels).mapInArrow(run, f"{key} {kind}, f array<double>")


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, sample points at pixel centres."""
    for axis, size in ((-2, height), (-1, width)):
        n = x.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high, f = np.minimum(low + 1, n - 1), at - low
        f = f if axis == -1 else f[:, None]
        x = np.take(x, low, axis) * (1 - f) + np.take(x, high, axis) * f
    return x


def resize_crop(x: np.ndarray, size: int) -> np.ndarray:
    """Scale the shorter side to size and cut the middle."""
    h, w = x.shape[-2:]
    s = size / min(h, w)
    x = resize(x, max(size, round(h * s)), max(size, round(w * s)))
    top, left = (x.shape[-2] - size) // 2, (x.shape[-1] - size) // 2
    return x[..., top : top + size, left : left + size]


def sine_wave(freq: float, theta: float, phase: float, n: int) -> np.ndarray:
    """freq cycles over the image, along theta degrees."""
    line = np.linspace(-0.5, 0.5, n)
    x, y = np.meshgrid(line, line)
    t = np.deg2rad(theta)
    return np.sin(2 * np.pi * freq * (x * np.cos(t) + y * np.sin(t)) + phase)


def blob(centre: tuple[float, float], sigma: float, n: int) -> np.ndarray:
    line = np.linspace(-0.5, 0.5, n)
    x, y = np.meshgrid(line, line)
    return np.exp(-((x - centre[0]) ** 2 + (y - centre[1]) ** 2) / (2 * sigma**2))


def gabor_pair(freq: float, theta: float, centre: tuple[float, float], sigma: float, n: int) -> np.ndarray:
    """Complex Gabor; the even part has no mean."""
    g = blob(centre, sigma, n)
    even, odd = (sine_wave(freq, theta, p, n) * g for p in (np.pi / 2, 0.0))
    return (even - g * even.sum() / g.sum()) + 1j * odd


def gabor_bank(orientations: int = 12, frequencies: int = 8, low: float = 3, high: float = 72) -> list[tuple[float, float]]:
    """(cycles an image, degrees), orientations within frequencies; frequencies even in the logarithm."""
    return [(float(f), 180 * k / orientations) for f in np.geomspace(low, high, frequencies) for k in range(orientations)]


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Circular convolution with a kernel centred on the pixel."""
    h, w = x.shape[-2:]
    full = np.zeros((h, w), complex)
    kh, kw = kernel.shape
    full[:kh, :kw] = kernel
    full = np.roll(full, (-(kh // 2), -(kw // 2)), (0, 1))
    return np.fft.ifft2(np.fft.fft2(x) * np.fft.fft2(full))


def gabor_energy(x: np.ndarray, orientations: int = 12, frequencies: int = 8, cycles: float = 3.0, compress: bool = True) -> np.ndarray:
    """(n, filters, h, w) magnitudes, with log(1 + sqrt) when compressed. Each frequency has a kernel of a few cycles."""
    n = min(x.shape[-2:])
    out = []
    for freq, theta in gabor_bank(orientations, frequencies, high=min(72.0, n / 2)):
        size = min(n, max(5, int(2 * cycles * n / freq) | 1))
        kernel = gabor_pair(freq * size / n, theta, (0, 0), 1 / 6, size)
        out.append(np.abs(convolve(x, kernel / np.abs(kernel).sum())))
    out = np.stack(out, 1)
    return np.log1p(np.sqrt(out)) if compress else out


def max_pool(x: np.ndarray, size: int) -> np.ndarray:
    h, w = (s // size * size for s in x.shape[-2:])
    x = x[..., :h, :w]
    return x.reshape(*x.shape[:-2], h // size, size, w // size, size).max(axis=(-3, -1))


def block_means(x: np.ndarray, n: int) -> np.ndarray:
    """Means over n by n blocks with borders floor(k * side / n)."""
    rows, cols = (np.arange(n + 1) * s // n for s in x.shape[-2:])
    out = np.empty((*x.shape[:-2], n, n))
    for i in range(n):
        for j in range(n):
            out[..., i, j] = x[..., rows[i] : max(rows[i + 1], rows[i] + 1), cols[j] : max(cols[j + 1], cols[j] + 1)].mean(axis=(-2, -1))
    return out


def prefilter(x: np.ndarray, cutoff: float = 4.0, pad: int = 5) -> np.ndarray:
    """Logarithm, whitening and local contrast normalisation, mirrored at the edges; x from 0 to 255."""
    h, w = x.shape[-2:]
    x = np.pad(np.log(x + 1), [(0, 0)] * (x.ndim - 2) + [(pad, pad)] * 2, "symmetric")
    n = max(x.shape[-2:]) + max(x.shape[-2:]) % 2
    x = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(0, n - x.shape[-2]), (0, n - x.shape[-1])], "symmetric")
    f = np.fft.fftfreq(n) * n
    low = np.exp(-(f[:, None] ** 2 + f[None, :] ** 2) / (cutoff / np.sqrt(np.log(2))) ** 2)
    smooth = lambda v: np.real(np.fft.ifft2(np.fft.fft2(v) * low))
    x = x - smooth(x)
    x = x / (0.2 + np.sqrt(np.abs(smooth(x * x))))
    return x[..., pad : pad + h, pad : pad + w]


def gist_filters(height: int, width: int, orientations: tuple[int, ...]):
    """Transfer functions of the scene descriptor, laid out as by fft2; scales from fine to coarse."""
    fy, fx = np.fft.fftfreq(height)[:, None], np.fft.fftfreq(width)[None, :]
    radius, angle = np.hypot(fx, fy), np.arctan2(fy, fx)
    for scale, n in enumerate(orientations):
        for k in range(n):
            turned = np.mod(angle + np.pi * k / n + np.pi, 2 * np.pi) - np.pi
            yield np.exp(-10 * 0.35 * (radius / (0.3 / 1.85**scale) - 1) ** 2 - 2 * (16 * n**2 / 32**2) * np.pi * turned**2)


def gist(x: np.ndarray, orientations: tuple[int, ...] = (8, 8, 8, 8), blocks: int = 4, pad: int = 32, most: int = 1 << 26) -> np.ndarray:
    """Scene descriptor: block means of filter magnitudes, scales from fine to coarse.

    Images whose filters, at the longer side, take at most so many bytes as
    matrices are multiplied by those, larger ones are filtered by Fourier
    transforms; the results are the same up to rounding errors.
    """
    x = prefilter(x)
    h, w = x.shape[-2:]
    side = max(h, w)
    if 8 * sum(orientations) * 16 * ((side + 1) // 2) ** 2 * ((side + 2 * pad) // 2 + 1) <= most:
        return gist_products(x.reshape(-1, h, w), tuple(orientations), blocks, pad).reshape(*x.shape[:-2], -1)
    x = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(pad, pad)] * 2, "symmetric")
    spectrum, out = np.fft.fft2(x), []
    for g in gist_filters(*x.shape[-2:], orientations):
        a = np.abs(np.fft.ifft2(spectrum * g))[..., pad : pad + h, pad : pad + w]
        out.append(block_means(a, blocks).reshape(*a.shape[:-2], -1))
    return np.concatenate(out, axis=-1)


def mirrored_waves(n: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cosine and sine sums (frequency, n) of n samples with mirrored margins, and cosines and sines (frequency,
    half) at their second half, divided by the full length; places count from the middle, frequencies from 0."""
    full = n + 2 * pad
    t = 2 * np.pi / full * np.outer(np.arange(full // 2 + 1), np.arange(full) - (full - 1) / 2)
    mirrored, half = np.pad(np.eye(n), [(pad, pad), (0, 0)], "symmetric"), t[:, pad + n // 2 : pad + n]
    return np.cos(t) @ mirrored, np.sin(t) @ mirrored, np.cos(half) / full, np.sin(half) / full


def both_signs(g: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and differences of the values at a frequency and its negative; 0 and a lone edge frequency count once."""
    g = np.moveaxis(g, axis, 0)
    k = np.arange(len(g) // 2 + 1)
    plus, minus = g[k % len(g)], g[-k]
    plus[0] = 0
    if len(g) % 2 == 0:
        plus[-1] = 0
    difference = plus - minus
    difference[0] = 0
    return np.moveaxis(plus + minus, 0, axis), np.moveaxis(difference, 0, axis)


@lru_cache(maxsize=2)
def gist_matrices(h: int, w: int, orientations: tuple[int, ...], pad: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each filter, what it does along the rows' axis at each frequency of the other: two (frequency, 4 parts, 2 parts)
    arrays, a part being a half of the axis; see gist_products for the parts."""
    cos_in, sin_in, cos, sin = mirrored_waves(h, pad)
    cos_in, sin_in = cos_in[:, h // 2 :], sin_in[:, h // 2 :]
    line = lambda a, g, b: np.einsum("ku,kl,kx->lux", a, g, b, optimize=True)
    join = lambda *rows: np.ascontiguousarray(np.concatenate([np.concatenate(r, axis=2) for r in rows], axis=1))
    out = []
    for g in gist_filters(h + 2 * pad, w + 2 * pad, orientations):
        (ep, em), (op, om) = (both_signs(v, 1) for v in both_signs(g, 0))
        # real parts keep even and odd halves apart, imaginary parts exchange them
        even, odd, to_even, to_odd = line(cos, ep, cos_in), line(sin, ep, sin_in), -line(cos, op, sin_in), line(sin, op, cos_in)
        even2, odd2, to_even2, to_odd2 = line(cos, em, cos_in), line(sin, em, sin_in), -line(cos, om, sin_in), line(sin, om, cos_in)
        out.append((join((even, to_even2), (to_odd, -odd2), (-to_odd2, odd), (even2, to_even)), join((odd, to_odd2), (to_even, -even2), (-to_even2, even), (odd2, to_odd))))
    return out


def half_means(n: int, blocks: int) -> np.ndarray:
    """Weights (blocks, places) of block_means along one axis, for its second half and then its first half backwards."""
    at = np.arange(blocks + 1) * n // blocks
    m = np.zeros((blocks, n))
    for i in range(blocks):
        m[i, at[i] : max(at[i + 1], at[i] + 1)] = 1 / max(at[i + 1] - at[i], 1)
    second, first = m[:, n // 2 :], m[:, : (n + 1) // 2][:, ::-1].copy()
    first[:, : n % 2] = 0  # the middle counts once
    return np.concatenate([second, first], axis=1)


def gist_products(x: np.ndarray, orientations: tuple[int, ...], blocks: int, pad: int) -> np.ndarray:
    """Scene descriptors of prefiltered images (n, h, w) by real products, without the margins' pixels.

    Halves that are even or odd about the middle are filtered apart: a filter
    is a sum of waves along the columns' axis, times a matrix along the rows'
    axis for each wave. The first pair of arrays takes (cosine of even, sine of
    odd) to (cosine real even, cosine imaginary odd, sine real odd, sine
    imaginary even), the second one the same with even and odd exchanged.
    """
    n, h, w = x.shape
    rows, columns = (h + 1) // 2, (w + 1) // 2
    cos_in, sin_in, cos, sin = mirrored_waves(w, pad)
    second, first = x[:, h // 2 :], x[:, :rows][:, ::-1]
    even, odd = second + first, second - first
    if h % 2:
        even[:, 0] /= 2
    waves = lambda a, b: np.ascontiguousarray(np.concatenate([np.einsum("lw,nuw->lun", f, v, optimize=True) for f, v in ((cos_in, a), (sin_in, b))], axis=1))
    in1, in2 = waves(even, odd), waves(odd, even)
    by_row, by_column = half_means(h, blocks), half_means(w, blocks)
    size, out = np.empty((2, columns, 2, rows, n)), np.empty((n, sum(orientations), blocks, blocks))

    def put(f, part):
        return (f.T @ part.reshape(len(f), -1)).reshape(columns, 2, rows, n).swapaxes(0, 1)

    for k, (m1, m2) in enumerate(gist_matrices(h, w, orientations, pad)):
        out1, out2 = m1 @ in1, m2 @ in2
        (cos_re_even, cos_im_odd), (sin_re_odd, sin_im_even) = put(cos, out1[:, : 2 * rows]), put(sin, out1[:, 2 * rows :])
        (cos_re_odd, cos_im_even), (sin_re_even, sin_im_odd) = put(cos, out2[:, : 2 * rows]), put(sin, out2[:, 2 * rows :])
        for j, side in enumerate((np.add, np.subtract)):
            re_even, re_odd = side(cos_re_even, sin_re_even), side(cos_re_odd, sin_re_odd)
            im_even, im_odd = side(cos_im_even, sin_im_even), side(cos_im_odd, sin_im_odd)
            for i, end in enumerate((np.add, np.subtract)):
                re, im = end(re_even, re_odd), end(im_even, im_odd)
                re *= re
                im *= im
                np.sqrt(np.add(re, im, out=re), out=size[j, :, i])
        means = by_row @ (by_column @ size.reshape(2 * columns, -1)).reshape(blocks, 2 * rows, n)
        out[:, k] = means.transpose(2, 1, 0)
    return out.reshape(n, -1)


def expand(x: np.ndarray, factor: int) -> np.ndarray:
    """Enlarge by zero-padding the spectrum; the mean is kept."""
    h, w = x.shape[-2:]
    f = np.fft.fftshift(np.fft.fft2(x), axes=(-2, -1))
    out = np.zeros((*x.shape[:-2], h * factor, w * factor), complex)
    top, left = (h * factor) // 2 - h // 2, (w * factor) // 2 - w // 2
    out[..., top : top + h, left : left + w] = f
    if h % 2 == 0:  # the edge frequency is shared between both signs
        out[..., top, :] /= 2
        out[..., top + h, :] = out[..., top, :]
    if w % 2 == 0:
        out[..., :, left] /= 2
        out[..., :, left + w] = out[..., :, left]
    out = np.fft.ifft2(np.fft.ifftshift(out, axes=(-2, -1))) * factor**2
    return out if np.iscomplexobj(x) else out.real


def shrink(x: np.ndarray, factor: int) -> np.ndarray:
    """Reduce by cutting the spectrum; the mean is kept."""
    h, w = (s // factor for s in x.shape[-2:])
    f = np.fft.fftshift(np.fft.fft2(x), axes=(-2, -1))
    top, left = x.shape[-2] // 2 - h // 2, x.shape[-1] // 2 - w // 2
    f = f[..., top : top + h, left : left + w].copy()
    if h % 2 == 0:
        f[..., 0, :] = 0
    if w % 2 == 0:
        f[..., :, 0] = 0
    out = np.fft.ifft2(np.fft.ifftshift(f, axes=(-2, -1))) / factor**2
    return out if np.iscomplexobj(x) else out.real


def auto_correlation(x: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Centre size by size of the weighted, mean-free circular autocorrelation; zero-padded when the patch is smaller."""
    w = weights / weights.sum()
    d = (x - (x * w).sum(axis=(-2, -1), keepdims=True)) * np.sqrt(w)
    a = np.fft.fftshift(np.real(np.fft.ifft2(np.abs(np.fft.fft2(d)) ** 2)), axes=(-2, -1))
    out = np.zeros((*x.shape[:-2], size, size))
    src, dst = [], []
    for n in x.shape[-2:]:
        half = min(size // 2, (n - 1) // 2)
        src.append(slice(n // 2 - half, n // 2 + half + 1))
        dst.append(slice(size // 2 - half, size // 2 + half + 1))
    out[..., dst[0], dst[1]] = a[..., src[0], src[1]]
    return out


def unique_correlations(a: np.ndarray) -> np.ndarray:
    """The (h^2 + 1) / 2 different values of a point-symmetric h by h map, h odd."""
    h = a.shape[-1]
    i, j = np.triu_indices(h, 1)
    k = np.arange((h + 1) // 2)
    return np.concatenate([a[..., i, j], a[..., k, k]], axis=-1)


def bent_kernel(frequency: float, bend: float, orientation: float, size: int, curved: bool = True, sigma_x: float = 1.0, sigma_y: float = 2.0) -> np.ndarray:
    """Gabor whose axis bends: along a parabola (curved) or in two straight arms. Free of mean, unit absolute sum."""
    line = np.arange(size) - (size - 1) / 2
    x, y = np.meshgrid(line, line)
    t = np.deg2rad(orientation)
    u, v = x * np.cos(t) + y * np.sin(t), -x * np.sin(t) + y * np.cos(t)
    u = u + bend * (v**2 if curved else np.abs(v))
    g = np.exp(-(frequency**2) / 2 * (u**2 / sigma_x**2 + (v**2) / sigma_y**2))
    wave = np.exp(2j * np.pi * frequency * u / 2)
    k = g * (wave - (g * wave).sum() / g.sum())
    return k / np.abs(k).sum()


def filter_power(x: np.ndarray, kernels: list[np.ndarray]) -> np.ndarray:
    """(n, kernels): mean square root of the filter power, scaled by each kernel's norm."""
    return np.stack([np.sqrt(np.abs(convolve(x, k)) ** 2).mean(axis=(-2, -1)) / np.linalg.norm(k) for k in kernels], axis=-1)


def curvature_scores(x: np.ndarray, curved: list[np.ndarray], angular: list[np.ndarray], linear: list[np.ndarray]) -> np.ndarray:
    """(n, 6): mean response of each family, and whether each family has the best kernel."""
    sets = [filter_power(x, k) for k in (curved, angular, linear)]
    means = np.stack([s.mean(axis=-1) for s in sets], axis=-1)
    best = np.stack([s.max(axis=-1) for s in sets], axis=-1).argmax(axis=-1)
    return np.concatenate([means, np.eye(3)[best]], axis=-1)


def steerable_pyramid(x: np.ndarray, scales: int = 4, orientations: int = 4) -> dict:
    """high residual, bands[scale] of (n, orientation, h, w) complex, low residual, and recon[scale]: the image
    put together from that scale and all coarser ones (the last is the low residual alone).

    Raised-cosine radial masks an octave wide and cosine-power angular masks
    over half the plane, so a band's real part is its even response; each
    scale has half the side.
    """
    def masks(shape, shift):
        fy, fx = np.meshgrid(np.fft.fftfreq(shape[0]) * 2, np.fft.fftfreq(shape[1]) * 2, indexing="ij")
        r = np.log2(np.maximum(np.hypot(fx, fy), 1e-12))
        low = np.cos(np.clip((r + 1 + shift), 0, 1) * np.pi / 2)
        return low, np.sqrt(np.maximum(1 - low**2, 0)), np.arctan2(fy, fx)

    f = np.fft.fft2(x)
    low, high, _ = masks(x.shape[-2:], 0)
    out = {"high": np.fft.ifft2(f * high).real, "bands": [], "recon": []}
    f, passed = f * low, low
    from math import factorial

    norm = np.sqrt(2 ** (2 * (orientations - 1)) * factorial(orientations - 1) ** 2 / (orientations * factorial(2 * (orientations - 1))))
    for _ in range(scales):
        low, high, angle = masks(f.shape[-2:], 1)
        out["recon"].append(np.fft.ifft2(f * passed).real)
        bands = []
        for k in range(orientations):
            turned = np.mod(angle - np.pi * k / orientations + np.pi, 2 * np.pi) - np.pi
            bands.append(np.fft.ifft2(f * high * 2 * norm * np.cos(turned) ** (orientations - 1) * (np.abs(turned) < np.pi / 2) * (-1j) ** (orientations - 1)))
        out["bands"].append(np.stack(bands, axis=1))
        h, w = f.shape[-2:]
        middle = lambda v: np.fft.ifftshift(np.fft.fftshift(v, axes=(-2, -1))[..., h // 4 : h // 4 + h // 2, w // 4 : w // 4 + w // 2], axes=(-2, -1))  # noqa: B023, E731
        f, passed = middle(f * low) / 4, middle(passed * low)
    out["low"] = np.fft.ifft2(f).real
    out["recon"].append(np.fft.ifft2(f * passed).real)
    return out


#: Sides of the autocorrelations, from the low residual to the finest scale of four.
AUTO_SIZES = (3, 3, 5, 7, 7)
#: Rolls (rows, columns) of the low residual.
SHIFTS = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))


def field_patch(field: tuple[float, float, float], n: int, least: int, sd: float = 2.0) -> tuple[slice, slice]:
    """Rows and columns of the square about a field's centre, sd deviations to each side, at least so large, moved and cut to the image."""
    x, y, sigma = field
    side = min(n, max(least, int(np.ceil(2 * sd * sigma * n)) | 1))

    def part(c):
        first = int(round((c + 0.5) * (n - 1))) - side // 2
        first = min(max(first, 0), n - side)
        return slice(first, first + side)

    return part(-y), part(x)


def texture_statistics(x: np.ndarray, field: tuple[float, float, float], scales: int = 4, orientations: int = 4) -> dict[str, np.ndarray]:
    """(n, columns) arrays by group name, in the order of the texture dictionary: statistics of a steerable pyramid
    under a field (x, y, sigma) whose weights are taken anew at each resolution.

    Scales go from coarse to fine. Autocorrelations are of the square about the
    field; covariances between maps are over the whole image, divided by its
    pixels. The coarser map's phase is doubled before real parts are compared.
    """
    pyramid = steerable_pyramid(x, scales, orientations)
    bands, recon, n = pyramid["bands"][::-1], pyramid["recon"][::-1], len(x)
    sizes = (AUTO_SIZES[-1:] * scales + AUTO_SIZES)[-(scales + 1) :] if scales > 4 else AUTO_SIZES[-(scales + 1) :]
    weights = {side: blob((field[0], -field[1]), field[2], side) for side in {v.shape[-1] for v in (x, *recon, *bands)}}
    weights = {side: w / max(w.sum(), 1e-300) for side, w in weights.items()}
    flat = lambda parts: np.concatenate([p.reshape(n, -1) for p in parts], axis=-1)

    def mean(v):
        return (v * weights[v.shape[-1]]).sum(axis=(-2, -1))

    def moments(v):
        d = v - mean(v)[..., None, None]
        var = mean(d**2) + 1e-6
        return np.stack([mean(v), var, mean(d**3) / var**1.5, mean(d**4) / var**2], axis=-1)

    def auto(v, size):
        rows, cols = field_patch(field, v.shape[-1], size)
        w = weights[v.shape[-1]][rows, cols]
        return unique_correlations(auto_correlation(v[..., rows, cols], w, size) * w.sum())

    def cross(a, b):
        w = weights[a.shape[-1]]
        a, b = (v - mean(v)[..., None, None] for v in (a, b))
        return np.einsum("nihw,njhw,hw->nij", a, b, w) / w.size

    mags = [np.abs(b) for b in bands]
    parents = [expand(b, 2) for b in bands[:-1]]
    turned = [np.abs(p) * np.exp(2j * np.angle(p)) for p in parents]
    i, j = np.triu_indices(orientations, 1)
    coarse = expand(pyramid["low"], 2)
    moved = np.stack([np.roll(coarse, s, axis=(-2, -1)) for s in SHIFTS], axis=1)
    k, m = np.triu_indices(len(SHIFTS), 1)
    return {
        "pixel_stats": np.concatenate([moments(x), x.min(axis=(-2, -1))[:, None], x.max(axis=(-2, -1))[:, None]], axis=-1),
        "mean_magnitudes": flat(mean(v) for v in mags),
        "mean_realparts": flat(mean(b.real) for b in bands),
        "marginal_stats_lowpass_recons": flat(moments(v)[..., 2:] for v in recon),
        "variance_highpass_resid": moments(pyramid["high"])[..., 1:2],
        "magnitude_feature_autocorrs": flat(auto(v - v.mean(axis=(-2, -1), keepdims=True), size) for v, size in zip(mags, sizes[1:], strict=True)),
        "lowpass_recon_autocorrs": flat(auto(v, size) for v, size in zip(recon, sizes, strict=True)),
        "highpass_resid_autocorrs": flat([auto(pyramid["high"], sizes[-1])]),
        "magnitude_within_scale_crosscorrs": flat(cross(v, v)[:, i, j] for v in mags),
        "real_within_scale_crosscorrs": flat(cross(b.real, b.real)[:, i, j] for b in bands),
        "magnitude_across_scale_crosscorrs": flat(cross(v, np.abs(p)) for v, p in zip(mags[1:], parents, strict=True)),
        "real_imag_across_scale_crosscorrs": flat(cross(b.real, part) for b, p in zip(bands[1:], turned, strict=True) for part in (p.real, p.imag)),
        "real_spatshift_within_scale_crosscorrs": cross(moved, moved)[:, k, m],
        "real_spatshift_across_scale_crosscorrs": flat([cross(bands[0].real, moved)]),
    }


def inside(polygon: np.ndarray, height: int, width: int) -> np.ndarray:
    """Boolean mask of pixel centres inside a polygon (x, y, x, y, ...), even-odd rule."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    p = np.asarray(polygon, float).reshape(-1, 2)
    out = np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, axis=0), strict=True):
        if y1 != y2:
            out ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def noise_images(n: int, side: int, seed: int, mean: float = 127.5, sd: float = 30.0) -> np.ndarray:
    """Gaussian noise in 0..255."""
    return np.clip(np.random.default_rng(seed).normal(mean, sd, (n, side, side)), 0, 255)

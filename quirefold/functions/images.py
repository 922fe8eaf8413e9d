"""Image kernels in numpy, over arrays (height, width) or (height, width, 3: red, green, blue) of bytes, and as UDFs."""
from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Largest side of a page, of a skew probe; skew's limit, step and least gain.
MAX_SIDE, PROBE_SIDE, SKEW_LIMIT, SKEW_STEP, SKEW_GAIN = 2500, 800, 8.0, 0.5, 1.15
#: Paper of old prints is at least so coloured and at most so bright.
PAPER_COLOUR, PAPER_LIGHT = 15.0, 225.0
#: Size of a recogniser's line.
LINE_HEIGHT, LINE_WIDTH = 32, 256
PNG = b"\x89PNG\r\n\x1a\n"


def encode_png(image: np.ndarray) -> bytes:
    """An image as PNG, grey or colour, without filters."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def unfiltered(raw: np.ndarray, kind: np.ndarray, step: int) -> np.ndarray:
    """A PNG's rows with their filters undone; step: bytes of a pixel."""
    out = np.zeros_like(raw)
    for y in range(len(raw)):
        up = out[y - 1].astype(int) if y else np.zeros(raw.shape[1], int)
        if kind[y] in (0, 2):
            out[y] = (raw[y] + (up if kind[y] else 0)) & 255
            continue
        if kind[y] == 1:
            out[y] = np.cumsum(raw[y].reshape(-1, step), axis=0, dtype=np.int64).ravel() & 255
            continue
        row, line = raw[y].astype(int).tolist(), [0] * raw.shape[1]
        for x, value in enumerate(row):
            left, above, corner = line[x - step] if x >= step else 0, int(up[x]), int(up[x - step]) if x >= step else 0
            if kind[y] == 3:
                guess = (left + above) // 2
            else:
                near = left + above - corner
                guess = min((abs(near - left), 0, left), (abs(near - above), 1, above), (abs(near - corner), 2, corner))[2]
            line[x] = (value + guess) & 255
        out[y] = line
    return out


def decode(content: bytes | None) -> np.ndarray | None:
    """An image of PNG (eight bits a channel, not interlaced) or binary PGM and PPM bytes; None if that can't be read. Alpha
    is dropped."""
    try:
        if content[:2] in (b"P5", b"P6"):
            words = [w for line in content.split(b"\n")[:8] for w in line.split(b"#")[0].split()][:4]
            width, height, most = map(int, words[1:4])
            size = width * height * (3 if words[0] == b"P6" else 1)
            data = np.frombuffer(content[-size:], np.uint8)
            return data.reshape((height, width, 3) if words[0] == b"P6" else (height, width)) if most == 255 and size else None
        if content[:8] != PNG:
            return None
        at, parts, head = 8, [], None
        while at < len(content):
            n = int.from_bytes(content[at : at + 4], "big")
            kind, data = content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", data)
            elif kind == b"IDAT":
                parts.append(data)
            at += 12 + n
        width, height, bits, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        if bits != 8 or interlaced or not width or not height:
            return None
        rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, -1)
        image = unfiltered(rows[:, 1:], rows[:, 0], channels).reshape(height, width, channels)
        return image[:, :, 0].copy() if channels < 3 else image[:, :, :3].copy()
    except (TypeError, ValueError, KeyError, IndexError, zlib.error, struct.error):
        return None


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.round(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image in another size: means over the area where it shrinks, linear between points where it grows."""

    def weights(old: int, new: int) -> np.ndarray:
        edge = np.arange(new + 1) * old / new
        if new <= old:
            cover = np.clip(np.minimum(edge[1:, None], np.arange(1, old + 1)) - np.maximum(edge[:-1, None], np.arange(old)), 0, None)
        else:
            at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
            cover = np.clip(1 - np.abs(at[:, None] - np.arange(old)[None, :]), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    rows, columns = weights(image.shape[0], height), weights(image.shape[1], width)
    out = np.tensordot(columns, np.tensordot(rows, image.astype(np.float64), (1, 0)), (1, 1))
    return np.clip(np.round(np.swapaxes(out, 0, 1)), 0, 255).astype(np.uint8)


def fitted(image: np.ndarray, most: int = MAX_SIDE) -> tuple[np.ndarray, float]:
    """An image whose larger side is at most so long, and the factor."""
    side = max(image.shape[:2])
    if not most or side <= most:
        return image, 1.0
    f = most / side
    return resized(image, max(1, int(image.shape[0] * f)), max(1, int(image.shape[1] * f))), f


def fitted_size(width, height, most: int = MAX_SIDE):
    """struct(width, height, factor) of an image that fitted() would give, as a column."""
    side = F.greatest(width, height)
    f = F.when(side > most, F.lit(float(most)) / side).otherwise(F.lit(1.0))
    return F.struct(F.greatest(F.lit(1), F.floor(width * f)).cast("int").alias("width"), F.greatest(F.lit(1), F.floor(height * f)).cast("int").alias("height"), f.alias("factor"))


def otsu(image: np.ndarray) -> int:
    """The threshold with the largest variance between the classes up to it and above it."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mean = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below / total - mean) ** 2 / (below * (total - below))
    return int(np.argmax(np.nan_to_num(between, nan=0, posinf=0)))


def looks_printed_long_ago(image: np.ndarray | None) -> bool:
    """Whether the paper (what is above the threshold) is tinted and not bright."""
    if image is None or not image.size:
        return False
    light = grey(image)
    paper = light > otsu(light)
    if paper.sum() < 100:
        return False
    colour = image[paper].astype(int)
    tint = (colour.max(axis=1) - colour.min(axis=1)).mean() if image.ndim == 3 else 0.0
    return bool(tint >= PAPER_COLOUR and light[paper].mean() <= PAPER_LIGHT)


def turned(image: np.ndarray, angle: float, fill: int = 0) -> np.ndarray:
    """A plane image turned about its middle by degrees, counter-clockwise, by nearest points."""
    h, w = image.shape
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    dx, dy = (np.arange(w) - w / 2)[None, :], (np.arange(h) - h / 2)[:, None]
    px, py = np.round(c * dx - s * dy + w / 2).astype(int), np.round(s * dx + c * dy + h / 2).astype(int)
    inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
    return np.where(inside, image[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)], fill)


def skew(image: np.ndarray) -> float:
    """The turn in degrees after which the rows of ink differ most, 0 unless it beats no turn clearly."""
    probe, _ = fitted(grey(image), PROBE_SIDE)
    ink = (probe <= otsu(probe)).astype(np.float32)
    score = lambda a: float(np.var(turned(ink, a).sum(axis=1)))
    found = {a: score(a) for a in np.arange(-SKEW_LIMIT, SKEW_LIMIT + 1e-6, SKEW_STEP).round(3).tolist()}
    best = max(found, key=found.get)
    if found[best] < found[0.0] * SKEW_GAIN:
        return 0.0
    for a in (best - SKEW_STEP / 2, best + SKEW_STEP / 2):
        if abs(a) <= SKEW_LIMIT:
            found[a] = score(a)
    return max(found, key=found.get)


def line_image(image: np.ndarray, height: int = LINE_HEIGHT, width: int = LINE_WIDTH) -> np.ndarray:
    """A line in grey, of one height, and white to the right up to one width."""
    image = grey(image)
    wide = min(width, max(4, round(image.shape[1] * height / image.shape[0])))
    out = np.full((height, width), 255, np.uint8)
    out[:, :wide] = resized(image, height, wide)
    return out


def psnr(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Peak signal to noise in decibels, over the mask's pixels if there is one; infinite if there is no difference."""
    keep = np.ones(a.shape[:2], bool) if mask is None else mask > 0
    if not keep.any():
        return math.inf
    error = float(np.mean((a[keep].astype(float) - b[keep].astype(float)) ** 2))
    return math.inf if error == 0 else 10 * math.log10(255**2 / error)


def ssim_map(a: np.ndarray, b: np.ndarray, window: int = 7) -> np.ndarray:
    """Structural similarity of plane images around each pixel: means over a square window, mirrored at the edges."""
    pad = window // 2

    def mean(x: np.ndarray) -> np.ndarray:
        sums = np.pad(np.pad(x, pad, mode="symmetric").cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return (sums[window:, window:] - sums[:-window, window:] - sums[window:, :-window] + sums[:-window, :-window]) / window**2

    a, b = a.astype(float), b.astype(float)
    n = window**2 / (window**2 - 1)
    ma, mb = mean(a), mean(b)
    va, vb, cov = (n * (mean(x * y) - mx * my) for x, y, mx, my in ((a, a, ma, ma), (b, b, mb, mb), (a, b, ma, mb)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))


def ssim(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Mean structural similarity over the mask's pixels, 1 if there are none; channels count alike. Without a mask the
    border of half a window is left out."""
    planes = [(a, b)] if a.ndim == 2 else [(a[..., k], b[..., k]) for k in range(a.shape[2])]
    maps = np.stack([ssim_map(x, y) for x, y in planes])
    if mask is None:
        return float(maps[:, 3:-3, 3:-3].mean())
    return float(maps[:, mask > 0].mean()) if (mask > 0).any() else 1.0


def outlined(image: np.ndarray, boxes: list[tuple[int, int, int, int]], colours: list[tuple[int, int, int]], line: int = 2) -> np.ndarray:
    """A colour image with the outlines of boxes."""
    out = np.stack([image] * 3, axis=2) if image.ndim == 2 else image.copy()
    for (x0, y0, x1, y1), colour in zip(boxes, colours):
        for ys, xs in ((slice(y0, y0 + line), slice(x0, x1)), (slice(max(0, y1 - line), y1), slice(x0, x1)), (slice(y0, y1), slice(x0, x0 + line)), (slice(y0, y1), slice(max(0, x1 - line), x1))):
            out[ys, xs] = colour
    return out


def covered(truth: np.ndarray, found: np.ndarray, side: int = 800, least: float = 0.5) -> float:
    """Share of the truth's boxes (x0, y0, x1, y1) of which at least so much is covered by found ones, on a raster whose
    larger side is so long at most."""
    if not len(truth):
        return float("nan")
    extent = max(1.0, float(max(truth[:, 2:].max(), found[:, 2:].max() if len(found) else 0)))
    scale = min(1.0, side / extent)
    raster = np.zeros((int(extent * scale) + 2,) * 2, bool)
    cut = lambda box: (slice(int(box[1] * scale), max(int(box[1] * scale) + 1, int(box[3] * scale))), slice(int(box[0] * scale), max(int(box[0] * scale) + 1, int(box[2] * scale))))
    for box in found:
        raster[cut(box)] = True
    return float(np.mean([raster[cut(box)].mean() >= least for box in truth]))


def beam_decode(log_probs: np.ndarray, charset: str, width: int = 8) -> str:
    """Prefix beam search over a recogniser's (steps, 1 + characters) log probabilities, class 0 being the blank: the most
    likely text over all of its alignments, of the `width` likeliest beginnings at each step."""
    beams = {"": (0.0, -math.inf)}  # text -> log probability of ending in a blank, and in its last character
    for step in log_probs:
        grown: dict[str, list[float]] = {}

        def add(text, place, value):
            own = grown.setdefault(text, [-math.inf, -math.inf])
            own[place] = np.logaddexp(own[place], value)

        for text, (blank, solid) in beams.items():
            both = np.logaddexp(blank, solid)
            add(text, 0, both + step[0])
            for k, char in enumerate(charset, 1):
                if text.endswith(char):
                    add(text, 1, solid + step[k])
                    add(text + char, 1, blank + step[k])
                else:
                    add(text + char, 1, both + step[k])
        beams = dict(sorted(((t, tuple(p)) for t, p in grown.items()), key=lambda b: -np.logaddexp(*b[1]))[:width])
    return max(beams, key=lambda t: np.logaddexp(*beams[t]))


def per_image(measure, kind: str):
    """A pandas UDF of a measure of one decoded image; null where it can't be read."""

    @F.pandas_udf(kind)
    def run(content: pd.Series) -> pd.Series:
        found: dict = {}  # of equal images one is measured
        for x in content:
            if x not in found:
                image = decode(x)
                found[x] = None if image is None else measure(image)
        return pd.Series([found[x] for x in content])

    return run


def image_size(content):
    """struct(width, height) of PNG, GIF and BMP bytes from their headers, null for what isn't one, as a column."""
    number = lambda start, n: F.conv(F.hex(F.substring(content, start, n)), 16, 10).cast("long")

    def small(start, n):  # little-endian
        bytes_ = [F.conv(F.hex(F.substring(content, start + k, 1)), 16, 10).cast("long") * 256**k for k in range(n)]
        return sum(bytes_[1:], bytes_[0])

    head = F.hex(F.substring(content, 1, 4))
    size = lambda w, h: F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
    return F.when((head == "89504E47") & (F.octet_length(content) >= 24), size(number(17, 4), number(21, 4))).when(head.startswith("474946") & (F.octet_length(content) >= 10), size(small(7, 2), small(9, 2))).when(head.startswith("424D") & (F.octet_length(content) >= 26), size(small(19, 4), small(23, 4)))

"""Numerical kernels for grouped functions: what is sequential, spectral or quadratic."""

from __future__ import annotations

import numpy as np

DIGITS = 9


def runs(flags: np.ndarray) -> np.ndarray:
    """Lengths of the runs of True along the first axis of a matrix or vector."""
    f = np.asarray(flags, np.int8)
    f = f[:, None] if f.ndim == 1 else f
    edge = np.zeros((1, f.shape[1]), np.int8)
    step = np.diff(np.concatenate([edge, f, edge]), axis=0).T
    start, stop = np.nonzero(step == 1), np.nonzero(step == -1)
    return stop[1] - start[1]


def gap(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances along the last axis."""
    if metric == "cosine":
        dot, norm = (a * b).sum(-1), np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1))
        return np.where(norm > 0, 1 - dot / np.where(norm > 0, norm, 1), 1.0)
    d = np.abs(a - b)
    if metric == "chebyshev":
        return d.max(-1)
    if metric == "manhattan":
        return d.sum(-1)
    return d[..., 0] if d.shape[-1] == 1 else np.sqrt((d * d).sum(-1))


def cosine_square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of all rows of a and b. Terms are added coordinate by coordinate, as a loop over one pair adds them,
    so that the last digits do not depend on how rows are blocked."""
    b = np.ascontiguousarray(b.T)
    dot, part = np.zeros((len(a), b.shape[1])), np.empty((len(a), b.shape[1]))
    u, v = np.zeros(len(a)), np.zeros(b.shape[1])
    for x, y in zip(a.T, b, strict=True):
        np.multiply(x[:, None], y, out=part)
        dot += part
        u += x * x
        v += y * y
    np.multiply(u[:, None], v, out=part)
    none = part == 0
    np.sqrt(part, out=part)
    part[none] = 1.0
    dot /= part
    np.clip(dot, -1.0, 1.0, out=dot)
    dot[none] = 0.0
    return 1 - dot


def _between(values: np.ndarray, below: int, total: int, q: float) -> float:
    """The linear quantile of `total` values, from a sorted stretch that starts at rank `below`."""
    at = q * (total - 1)
    lo = int(np.floor(at))
    a, b = values[lo - below], values[min(lo + 1, total - 1) - below]
    return round(float(a + (b - a) * (at - lo)), DIGITS)


def pair_quantile(x: np.ndarray, q: float, theiler: int, metric: str, most: int = 20_000_000) -> float:
    """Exact linear quantile of the distances of admissible ordered pairs. Up to `most` pairs are
    sorted; beyond that their counts in ever narrower bins find the stretch that holds the quantile,
    so that memory stays bounded and no pair is left out."""
    n, low = len(x), max(theiler, 1)
    if n <= low:
        return 0.0
    own = n if theiler == 0 else 0

    def diagonals():
        for k in range(low, n):
            yield np.round(gap(x[k:], x[:-k], metric), DIGITS)

    total = (n - low) * (n - low + 1) + own
    if total <= 2 * most:
        return _between(np.concatenate([np.zeros(own), np.sort(np.repeat(np.concatenate(list(diagonals())), 2))]), 0, total, q)
    first = int(np.floor(q * (total - 1)))
    last = min(first + 1, total - 1)
    lo, hi, bins = 0.0, max(float(d.max()) for d in diagonals()), 1 << 16
    while True:
        edges = np.linspace(lo, hi, bins + 1)
        below, inside = own if lo > 0 else 0, np.zeros(bins, np.int64)
        inside[0] += own if lo == 0 else 0
        for d in diagonals():
            below += 2 * int((d < lo).sum())
            d = d[(d >= lo) & (d <= hi)]
            inside += 2 * np.bincount(np.minimum(np.searchsorted(edges, d, "right") - 1, bins - 1), minlength=bins)
        upto = below + np.cumsum(inside)
        a, b = int(np.searchsorted(upto, first, "right")), int(np.searchsorted(upto, last, "right"))
        rank, held = int(upto[a] - inside[a]), int(upto[b] - (upto[a] - inside[a]))
        lo, hi = float(edges[a]), float(edges[b + 1])
        if held <= 2 * most or hi - lo < 10.0 ** -DIGITS or a == 0 and b == bins - 1:
            break
    top = b == bins - 1
    seen: dict[float, int] = {0.0: own} if own and lo == 0 else {}
    for d in diagonals():
        for v, c in zip(*np.unique(d[(d >= lo) & ((d <= hi) if top else (d < hi))], return_counts=True), strict=True):
            seen[v] = seen.get(v, 0) + 2 * int(c)
    values = np.array(sorted(seen))
    upto = rank + np.cumsum([seen[v] for v in values])
    u, v = values[np.searchsorted(upto, first, "right")], values[np.searchsorted(upto, last, "right")]
    return round(float(u + (v - u) * (q * (total - 1) - first)), DIGITS)


def _dense_histogram(x: np.ndarray, q: float, theiler: int, metric: str, eps: float | None) -> tuple:
    """Threshold, histograms and number of recurrent cells of a unit whose matrix is small."""
    n = len(x)
    d = np.round(gap(x[:, None, :], x[None, :, :], metric), DIGITS)
    lag = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    free = lag >= theiler
    if eps is None:
        held = np.sort(d[free])
        eps = _between(held, 0, len(held), q) if len(held) else 0.0
    hit = (d <= eps) & free
    white = np.zeros((n + 2, n), bool)
    white[1:-1] = ~hit & free
    # rows one cell longer than the stride turn diagonals into columns
    skew = np.zeros((2, n, 2 * n), bool)
    skew[0, :, :n], skew[1, :, :n] = hit, hit.T
    flat = np.concatenate([skew.reshape(2, -1), np.zeros((2, n), bool)], axis=1).reshape(2, n, 2 * n + 1)
    count = lambda r: np.bincount(r, minlength=n + 1)
    diagonal = count(runs(flat[0][:, :n])) + count(runs(flat[1][:, 1:n]))
    step = np.diff(white.astype(np.int8), axis=0).T
    c, start = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    near = np.zeros((n + 2, n), bool)
    near[1:-1] = ~free
    alone = ~near[start, c] & ~near[stop + 1, c]
    return eps, {"diagonal": diagonal, "vertical": count(runs(hit)), "white_vertical": count((stop - start)[alone])}, int(hit.sum())


def recurrence_histogram(x: np.ndarray, target_rr: float, theiler: int = 1, metric: str = "euclidean", eps: float | None = None, columns: int = 256, dense: int = 384) -> list[tuple]:
    """(kind, length, count, eps). Units of up to `dense` points by their matrix; larger ones by diagonals
    one by one above the identity, doubled, and columns in strips, so memory is a strip, never a matrix."""
    n = len(x)
    if n == 0:
        return []
    if n <= dense:
        eps, hist, recurrent = _dense_histogram(x, target_rr, theiler, metric, eps)
    else:
        eps = pair_quantile(x, target_rr, theiler, metric) if eps is None else eps
        hist, recurrent = _strip_histogram(x, eps, theiler, metric, columns)
    cells = n * n - sum((n if k == 0 else 2 * (n - k)) for k in range(min(theiler, n)))
    out = [(kind, int(length), int(h[length]), eps) for kind, h in hist.items() for length in np.flatnonzero(h) if length > 0]
    return [*out, ("pairs", 0, cells, eps), ("recurrent", 0, recurrent, eps)]


def diagonal_histogram(x: np.ndarray, offsets, eps: float, metric: str = "euclidean") -> tuple[np.ndarray, int]:
    """Lengths of lines on diagonals above the identity and their twins below, and the recurrent cells of both."""
    hist, recurrent = np.zeros(len(x) + 1, np.int64), 0
    for k in offsets:
        hit = np.round(gap(x[k:], x[:-k], metric), DIGITS) <= eps
        recurrent += 2 * int(hit.sum())
        found = np.bincount(runs(hit))
        hist[: len(found)] += 2 * found
    return hist, recurrent


def column_histogram(x: np.ndarray, first: int, last: int, eps: float, theiler: int, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    """Lengths of vertical lines and of white ones that do not touch the band, in columns first to last - 1."""
    n = len(x)
    i, j = np.arange(n)[:, None], np.arange(first, last)
    hit = np.round(gap(x[:, None, :], x[None, j, :], metric), DIGITS) <= eps
    band = np.abs(i - j[None, :]) < theiler
    hit &= ~band
    white = ~hit & ~band
    edge = np.zeros((1, len(j)), np.int8)
    step = np.diff(np.concatenate([edge, white.astype(np.int8), edge]), axis=0).T
    c, start = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    near = np.concatenate([np.zeros((1, len(j)), bool), band, np.zeros((1, len(j)), bool)])
    free = ~near[start, c] & ~near[stop + 1, c]
    return np.bincount(runs(hit), minlength=n + 1), np.bincount((stop - start)[free], minlength=n + 1)


def strip_width(n: int, dim: int, most: int = 2_000_000) -> int:
    """Columns whose differences to all points are about `most` numbers."""
    return int(np.clip(most // max(1, n * dim), 4, 256))


def _strip_histogram(x: np.ndarray, eps: float, theiler: int, metric: str, columns: int) -> tuple[dict, int]:
    n = len(x)
    hist = {k: np.zeros(n + 1, np.int64) for k in ("diagonal", "vertical", "white_vertical")}
    hist["diagonal"], recurrent = diagonal_histogram(x, range(max(theiler, 1), n), eps, metric)
    if theiler == 0:
        recurrent += n
        hist["diagonal"][n] += 1
    columns = min(columns, strip_width(n, x.shape[1]))
    for at in range(0, n, columns):
        v, w = column_histogram(x, at, min(n, at + columns), eps, theiler, metric)
        hist["vertical"] += v
        hist["white_vertical"] += w
    return hist, recurrent


def shifted_mvl(phase: np.ndarray, a: np.ndarray, shifts: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """Mean vector length with the amplitude moved circularly by each shift; NaN is missing. About `most` moved samples
    are held at once, or one shift's."""
    n = len(a)
    there, told = ~np.isnan(a), ~np.isnan(phase)
    if not there.any() or a[there].mean() == 0:
        return np.full(len(shifts), np.nan)
    angle = np.where(told, phase, 0.0)
    parts = np.column_stack([np.cos(angle), np.sin(angle), np.ones(n)]) * told[:, None]
    # place j of a moved series holds sample j - shift: all moved series are stretches of the doubled one
    moved = lambda x: np.lib.stride_tricks.sliding_window_view(np.concatenate([x, x]), n)
    values, held = moved(np.where(there, a, 0.0)), moved(there.astype(float))
    out = []
    for at in range(0, len(shifts), max(1, most // n)):
        start = n - shifts[at : at + max(1, most // n)] % n
        x = values[start] @ parts[:, :2]
        count = held[start] @ parts[:, 2] if not (there.all() and told.all()) else np.full(len(start), float(n))
        with np.errstate(invalid="ignore"):
            out.append(np.hypot(x[:, 0] / count, x[:, 1] / count))
    return np.concatenate(out) / a[there].mean()


def lempel_ziv(x: np.ndarray, normalise: bool = True) -> float:
    """Number of phrases of the median-binarised series (1976 parsing), over n / log2 n."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    mid = np.median(x) if len(x) else 0.0
    s = "".join("1" if v > mid else "0" for v in x)
    n, phrases, at = len(s), 0, 0
    while at < n:
        size = 1
        while at + size <= n and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        phrases += 1
        at += size
    return phrases / (n / np.log2(n)) if normalise and n > 1 else float(phrases)


def spectral_entropy(x: np.ndarray) -> float:
    x = np.asarray(x, float)
    power = np.abs(np.fft.rfft(x - x.mean())[1:]) ** 2
    if len(power) < 2 or power.sum() <= 0:
        return 0.0
    p = power / power.sum()
    p = p[p > 0]
    return float(-(p * np.log(p)).sum() / np.log(len(power)))


def embed(x: np.ndarray, m: int, tau: int) -> np.ndarray:
    n = len(x) - (m - 1) * tau
    return np.column_stack([x[k * tau : k * tau + n] for k in range(m)]) if n > 0 else np.zeros((0, m))


def log_scales(n: int, least: int = 8, count: int = 20) -> np.ndarray:
    """Distinct whole numbers from `least` to a quarter of n, evenly spaced in their logarithm."""
    top = max(least + 1, n // 4)
    return np.unique(np.floor(np.logspace(np.log10(least), np.log10(top), count)).astype(int))


def dfa_exponent(x: np.ndarray, scales=None, order: int = 1, min_points: int = 6) -> float:
    """Slope of the log root mean square residual of polynomials in segments of the profile on the log scale."""
    x = np.asarray(x, float)
    y = np.cumsum(x - x.mean())
    at, f = [], []
    for s in log_scales(len(x)) if scales is None else scales:
        k = len(x) // s
        if k < 1 or s <= order + 1:
            continue
        t = np.arange(s)
        seg = y[: k * s].reshape(k, s)
        q, _ = np.linalg.qr(np.vander(t, order + 1))
        r = seg - seg @ q @ q.T
        rms = np.sqrt((r * r).mean(1).mean())
        if rms > 0:
            at.append(s)
            f.append(rms)
    return float(np.polyfit(np.log(at), np.log(f), 1)[0]) if len(at) >= min(min_points, 3) else float("nan")


def higuchi_dimension(x: np.ndarray, k_max: int = 20, tolerance: float = 0.25) -> float:
    """Slope of the log curve length on log 1/k, from k = 1 on while the slope from step to step stays within
    `tolerance` of the first one."""
    x = np.asarray(x, float)
    n = len(x)
    ks, lengths = [], []
    for k in range(1, min(k_max, n // 2) + 1):
        each = []
        for m in range(k):
            d = np.abs(np.diff(x[m::k]))
            if len(d):
                each.append(d.sum() * (n - 1) / (len(d) * k) / k)
        if each and np.mean(each) > 0:
            ks.append(k)
            lengths.append(np.mean(each))
    if len(ks) < 3:
        return float("nan")
    u, v = np.log(1 / np.array(ks)), np.log(lengths)
    local = np.diff(v) / np.diff(u)
    far = np.flatnonzero(np.abs(local - local[0]) > tolerance * max(abs(local[0]), 1e-12))
    stop = max(3, int(far[0]) + 1 if len(far) else len(ks))
    return float(np.polyfit(u[:stop], v[:stop], 1)[0])


def permutation_entropy(x: np.ndarray, order: int = 3, delay: int = 1, normalise: bool = True) -> float:
    y = embed(np.asarray(x, float), order, delay)
    if not len(y):
        return float("nan")
    _, count = np.unique(np.argsort(y, axis=1, kind="stable"), axis=0, return_counts=True)
    p = count / count.sum()
    h = float(-(p * np.log(p)).sum())
    return h / float(np.log(np.prod(np.arange(1, order + 1)))) if normalise else h


def samples_per_turn(x: np.ndarray) -> float:
    d = np.diff(np.asarray(x, float))
    turns = int((d[1:] * d[:-1] < 0).sum())
    return len(x) / turns if turns else float(len(x))


def fine_scale(x: np.ndarray, target: float = 2.0, least: int = 64) -> int:
    """Decimation that leaves about `target` samples a turn and at least `least` samples."""
    return max(1, min(int(samples_per_turn(x) / target), len(x) // least))


def svd_entropy(x: np.ndarray, m: int = 5, tau: int = 1) -> float:
    y = embed(np.asarray(x, float), m, tau)
    if len(y) < m:
        return float("nan")
    s = np.linalg.svd(y, compute_uv=False)
    p = s / s.sum()
    p = p[p > 0]
    return float(-(p * np.log(p)).sum() / np.log(m))


def bandpass_taps(low: float, high: float, fs: float, min_cycles: float = 3.0, n: int | None = None) -> np.ndarray:
    """Windowed-sinc band-pass with unit gain at the band's centre."""
    n = n or bandpass_order(low, fs, min_cycles)[0]
    t = np.arange(n) - (n - 1) / 2
    h = 2 * high / fs * np.sinc(2 * high / fs * t) - 2 * low / fs * np.sinc(2 * low / fs * t)
    h *= np.hamming(n)
    centre = (low + high) / 2
    return h / np.abs(np.sum(h * np.exp(-2j * np.pi * centre / fs * np.arange(n))))


def bandpass_order(low: float, fs: float, min_cycles: float = 3.0) -> tuple[int, bool]:
    """Number of taps (odd), and whether it had to be held within 15 and four seconds."""
    wanted = int(np.ceil(min_cycles * fs / low))
    n = int(np.clip(wanted, 15, max(15, int(4 * fs)))) | 1
    return n, n != wanted | 1


def _held(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Causal filter as if the first value had stood for ever."""
    return np.convolve(np.concatenate([np.full(len(taps) - 1, x[0]), x]), taps, "valid")


def odd_extension(x: np.ndarray, pad: int) -> np.ndarray:
    return np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x


def zero_phase(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Forward and backward filtering over odd extensions of the ends."""
    pad = min(3 * len(taps), len(x) - 1)
    y = _held(odd_extension(x, pad), taps)
    y = _held(y[::-1], taps)[::-1]
    return y[pad : pad + len(x)]


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Causal recursive filter (a[0] = 1) that starts in the steady state of the first value."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[np.arange(n - 1), np.arange(1, n)] = 1
    state = np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0]) * x[0]
    out = np.empty(len(x))
    for i, v in enumerate(x):
        y = b[0] * v + state[0]
        state[:-1] = state[1:]
        state[-1] = 0
        state += b[1:] * v - a[1:] * y
        out[i] = y
    return out


def zero_phase_recursive(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Forward and backward through second-order sections, over odd extensions of the ends."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = odd_extension(np.asarray(x, float), pad)
    for _ in range(2):
        for b, a in sections:
            y = recursive(b, a, y)
        y = y[::-1]
    return y[pad : pad + len(x)]


def butter_sections(order: int, fs: float, low: float | None = None, high: float | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Butterworth second-order sections: low-pass (high alone) or band-pass (both), by the bilinear transform."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is None:
        w = warp(high)
        s, zeros = poles * w, np.zeros(0)
        gain = w**order
    else:
        w1, w2 = warp(low), warp(high)
        mid, width = np.sqrt(w1 * w2), w2 - w1
        half = poles * width / 2
        root = np.sqrt(half * half - mid * mid + 0j)
        s, zeros = np.concatenate([half + root, half - root]), np.zeros(order)
        gain = width**order
    z = (2 * fs + s) / (2 * fs - s)
    gain = gain * np.prod(2 * fs - zeros).real / np.prod(2 * fs - s).real
    ends = np.concatenate([(2 * fs + zeros) / (2 * fs - zeros), -np.ones(len(s) - len(zeros))]).real
    upper = z[z.imag > 1e-12]
    upper = upper[np.argsort(np.abs(upper))]
    real = np.sort(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(p, np.conj(p)) for p in upper] + [(real[k], real[k + 1]) for k in range(0, len(real) - 1, 2)]
    odd = [real[-1]] if len(real) % 2 else []
    plus, minus = sorted(ends[ends > 0]), sorted(ends[ends <= 0])
    out = []
    for p, q in pairs:
        e = [plus.pop() if plus else minus.pop(), minus.pop() if minus else plus.pop()]
        out.append((np.poly(e), np.poly([p, q]).real))
    for p in odd:
        e = minus.pop() if minus else plus.pop()
        out.append((np.append(np.poly([e]), 0), np.append(np.poly([p]), 0).real))
    out[0] = (out[0][0] * gain, out[0][1])
    return out


def notch_section(freq: float, fs: float, q: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch whose width at -3 dB is freq / q."""
    w = 2 * np.pi * freq / fs
    beta = np.tan(w / q / 2)
    gain = 1 / (1 + beta)
    return gain * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * gain * np.cos(w), 2 * gain - 1])


def resample_poly(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up / down with a Kaiser-windowed sinc (beta 5, ten zero crossings a side)."""
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    if up == down:
        return np.asarray(x, float).copy()
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) / most * np.kaiser(2 * half + 1, 5.0)
    h = h / h.sum() * up
    n_out = -(-len(x) * up // down)
    out = np.zeros(n_out)
    at = np.arange(n_out) * down + half  # place in the filtered, up-sampled series
    for k in range(-(-len(h) // up)):
        # the k-th input sample back from the newest one under the filter
        newest = at // up - k
        tap = at - newest * up
        ok = (newest >= 0) & (newest < len(x)) & (tap < len(h))
        out[ok] += np.asarray(x, float)[newest[ok]] * h[tap[ok]]
    return out


def resample_fourier(x: np.ndarray, n: int) -> np.ndarray:
    """Resampling to n points of one period by its spectrum; the middle frequency of an even length is split or joined."""
    m = len(x)
    z, out = np.fft.rfft(x), np.zeros(n // 2 + 1, complex)
    k = min(m, n) // 2 + 1
    out[:k] = z[:k]
    if min(m, n) % 2 == 0:
        out[min(m, n) // 2] *= 2 if n < m else (0.5 if n > m else 1)
    return np.fft.irfft(out, n) * n / m


def gaussian_smooth(x: np.ndarray, cutoff: float, fs: float) -> np.ndarray:
    """Gaussian weights whose gain is one half at the cut-off; ends mirrored, four deviations a side."""
    sigma = fs * np.sqrt(np.log(2) / 2) / (np.pi * cutoff)
    r = int(4 * sigma + 0.5)
    t = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (t / sigma) ** 2)
    at = np.arange(-r, len(x) + r) % (2 * len(x))
    at = np.where(at < len(x), at, 2 * len(x) - 1 - at)
    return np.convolve(x[at], w / w.sum(), "valid")


def tukey(n: int, share: float = 0.1) -> np.ndarray:
    edge = int(share * (n - 1) / 2)
    w = np.ones(n)
    if edge > 0:
        ramp = 0.5 * (1 + np.cos(np.pi * (2 * np.arange(edge + 1) / (share * (n - 1)) - 1)))
        w[: edge + 1], w[n - edge - 1 :] = ramp, ramp[::-1]
    return w


def gradient(x: np.ndarray) -> np.ndarray:
    return np.gradient(x) if len(x) > 1 else np.zeros(len(x))


def hilbert_components(x: np.ndarray, fs: float = 1.0, edge: str = "none", edge_samples: int = 0, unwrap: bool = False) -> np.ndarray:
    """Columns phase, amplitude, instantaneous frequency. edge: mirror (odd ends before the transform), taper (cosine
    ends) or none; trimming is the caller's."""
    n, pad = len(x), 0
    if edge == "mirror":
        pad = min(max(edge_samples, 1), n - 1)
        x = odd_extension(x, pad)
    elif edge == "taper":
        x = x * tukey(n)
    phase, amplitude = hilbert(x)
    phase, amplitude = phase[pad : pad + n], amplitude[pad : pad + n]
    whole = np.unwrap(phase)
    return np.column_stack([whole if unwrap else phase, amplitude, gradient(whole) * fs / (2 * np.pi)])


def hilbert(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase and amplitude of the analytic signal."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    z = np.fft.ifft(np.fft.fft(x) * gain)
    return np.angle(z), np.abs(z)


def divergence(x: np.ndarray, steps: int = 20, theiler: int = 10) -> np.ndarray:
    """Mean log distance of nearest neighbours, step by step."""
    n = len(x) - steps
    near = np.zeros(n, np.int64)
    for i in range(n):
        d = gap(x[:n], x[i][None, :])
        d[max(0, i - theiler) : i + theiler + 1] = np.inf
        d[d == 0] = np.inf
        near[i] = np.argmin(d)
    out = np.full(steps, np.nan)
    for s in range(steps):
        d = gap(x[s : s + n], x[near + s])
        d = d[d > 0]
        out[s] = np.log(d).mean() if len(d) else np.nan
    return out


def coloured_noise(n: int, beta: float, rng: np.random.Generator) -> np.ndarray:
    f = np.fft.rfftfreq(n)
    f[0] = f[1] if n > 1 else 1
    z = (rng.standard_normal(len(f)) + 1j * rng.standard_normal(len(f))) * f ** (-beta / 2)
    z[0] = 0
    x = np.fft.irfft(z, n)
    return x / x.std()


def noise_at_snr(signal: np.ndarray, snr_db: float, rng: np.random.Generator, beta: float = 0.0) -> np.ndarray:
    """The signal with noise whose power lies snr_db under the signal's."""
    noise = coloured_noise(len(signal), beta, rng)
    return signal + noise * signal.std() * 10 ** (-snr_db / 20)


def henon(n: int, a: float = 1.4, b: float = 0.3, start: tuple = (0.1, 0.3), transient: int = 1000) -> np.ndarray:
    x, y = start
    out = np.zeros((n, 2))
    for k in range(-transient, n):
        x, y = 1 - a * x * x + y, b * x
        if k >= 0:
            out[k] = x, y
    return out


def mackey_glass(n: int, tau: int = 17, beta: float = 0.2, gamma: float = 0.1, power: int = 10, transient: int = 1000, start: float = 1.2) -> np.ndarray:
    """The delay equation by steps of one; the past before the start is constant."""
    x = np.full(n + transient + tau + 1, start)
    for k in range(tau, len(x) - 1):
        x[k + 1] = x[k] + beta * x[k - tau] / (1 + x[k - tau] ** power) - gamma * x[k]
    return x[-n:, None]


# right sides, steps and starts of the published systems (fixed values)
SYSTEMS = {
    "lorenz": (lambda y: np.array([10 * (y[1] - y[0]), y[0] * (28 - y[2]) - y[1], y[0] * y[1] - 8 / 3 * y[2]]), 0.01, (1.0, 1.0, 1.0)),
    "rossler": (lambda y: np.array([-y[1] - y[2], y[0] + 0.2 * y[1], 0.2 + y[2] * (y[0] - 5.7)]), 0.05, (1.0, 1.0, 1.0)),
    "van_der_pol": (lambda y: np.array([y[1], 2 * (1 - y[0] ** 2) * y[1] - y[0]]), 0.05, (1.0, 0.0)),
}


def integrate(name: str, n: int, transient: int = 1000, substeps: int = 4) -> np.ndarray:
    """Fourth-order Runge-Kutta trajectory of a named system."""
    rhs, dt, y = SYSTEMS[name]
    y, h, out = np.array(y), dt / substeps, np.zeros((n, len(y)))
    for k in range(-transient, n):
        for _ in range(substeps):
            a = rhs(y)
            b = rhs(y + h / 2 * a)
            c = rhs(y + h / 2 * b)
            y = y + h / 6 * (a + 2 * b + 2 * c + rhs(y + h * c))
        if k >= 0:
            out[k] = y
    return out


def scaling_region(x: np.ndarray, y: np.ndarray, min_points: int = 8, max_cv: float = 0.25) -> tuple[int, int, float, float] | None:
    """First and last point, slope and variation of the straightest stretch of a curve; wide ones are preferred
    a little. Slopes are local fits over five points. None where no stretch varies less than max_cv."""
    n = len(x)
    if n < min_points:
        return None
    local = np.array([np.polyfit(x[max(0, k - 2) : k + 3], y[max(0, k - 2) : k + 3], 1)[0] for k in range(n)])
    best = None
    for a in range(n - min_points + 1):
        for b in range(a + min_points - 1, n):
            part = local[a : b + 1]
            if part.mean() == 0:
                continue
            cv = part.std() / abs(part.mean())
            score = cv - 0.05 * (x[b] - x[a]) / (x[-1] - x[0])
            if cv <= max_cv and (best is None or score < best[0]):
                best = (score, a, b, cv)
    if best is None:
        return None
    _, a, b, cv = best
    return a, b, float(np.polyfit(x[a : b + 1], y[a : b + 1], 1)[0]), float(cv)

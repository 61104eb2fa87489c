"""Filters, spectra and waveform features of epochs.

A filter runs over a recording's kept epochs in order, so it is a grouped kernel over the recording; everything after it
looks at one epoch at a time, so those features are computed in Arrow batches of epochs, wherever these lie. The stream
calls the same epoch kernel. Signals are [channel][sample]; missing values are nulls.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewave.functions.recordings import map_recordings

# Fixed bands in Hz.
BANDS = {"sdelta": (0.4, 1.0), "fdelta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "sigma": (12.0, 16.0), "beta": (16.0, 30.0)}
WHOLE = (0.4, 30.0)
SPINDLE = (11.0, 16.0)
MODES = ("none", "causal", "zerophase")
ORDER = 5


def butterworth(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Second-order sections of a digital Butterworth band-pass.

    The analogue low-pass poles lie evenly on the left unit half-circle. Each goes to two band-pass poles, all go through
    the bilinear transform, and conjugate pairs make the sections, each with a zero at 0 Hz and one at half the rate.
    """
    warped = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)) * width / 2
    poles = np.concatenate([poles + np.sqrt(poles**2 - centre**2), poles - np.sqrt(poles**2 - centre**2)])
    poles = (2 * rate + poles) / (2 * rate - poles)
    upper = sorted((p for p in poles if p.imag > 1e-12), key=lambda p: (abs(p), p.real))
    real = sorted(p.real for p in poles if abs(p.imag) <= 1e-12)
    pairs = [(p, p.conjugate()) for p in upper] + [(a, b) for a, b in zip(real[::2], real[1::2], strict=True)]
    middle = np.exp(2j * np.pi * np.arctan(centre / (2 * rate)) / np.pi)  # where the gain is one
    out = []
    for a, b in pairs:
        bottom = np.array([1.0, -(a + b).real, (a * b).real])
        top = np.array([1.0, 0.0, -1.0])
        gain = abs(np.polyval(top, middle) / np.polyval(bottom, middle))
        out.append(np.concatenate([top / gain, bottom]))
    return np.array(out)


def _steady(section: np.ndarray) -> np.ndarray:
    """The state in which a constant input of one leaves a section without a transient."""
    b, a = section[:3], section[3:]
    level = b.sum() / a.sum()
    second = b[2] - a[2] * level
    return np.array([b[1] - a[1] * level + second, second])


BLOCK = 128


@lru_cache(maxsize=64)
def _block(sections: bytes, length: int) -> tuple[np.ndarray, ...]:
    """What `length` samples of a cascade come to: outputs from inputs and from the state, and the state after from both.

    The state is two numbers a section, in transposed direct form II. The four matrices follow from the answers to a unit
    impulse and to each unit state, run sample by sample once.
    """
    rows = np.frombuffer(sections).reshape(-1, 6)
    width = 2 * len(rows)
    state = np.hstack([np.zeros((width, 1)), np.eye(width)])  # one column for the impulse, one for each unit state
    answer, states = np.empty((length, width + 1)), np.empty((length, width, width + 1))
    for t in range(length):
        v = np.zeros(width + 1)
        v[0] = t == 0
        for i, s in enumerate(rows):
            w = s[0] * v + state[2 * i]
            state[2 * i] = s[1] * v - s[4] * w + state[2 * i + 1]
            state[2 * i + 1] = s[2] * v - s[5] * w
            v = w
        answer[t], states[t] = v, state
    lag = np.subtract.outer(np.arange(length), np.arange(length))
    outputs = np.where(lag >= 0, answer[np.maximum(lag, 0), 0], 0.0)
    return outputs, answer[:, 1:], states[::-1, :, 0].T, states[-1, :, 1:]


def filter_sections(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """The cascade's output along the last axis, all other axes at once, by blocks of samples."""
    return filter_on(sections, x, state)[0]


def filter_on(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(output, state after): a signal can be filtered in parts, each from the state in which the last one ended."""
    x = np.moveaxis(np.asarray(x, float), -1, 0)
    shape, n, packed = x.shape[1:], len(x), np.ascontiguousarray(sections, float).tobytes()
    flat, y = x.reshape(n, -1), np.empty((n, int(np.prod(shape))))
    z = np.zeros((2 * len(sections), y.shape[1])) if state is None else np.asarray(state, float).reshape(2 * len(sections), -1)
    for at in range(0, n, BLOCK):
        part = flat[at : at + BLOCK]
        from_x, from_z, to_x, to_z = _block(packed, len(part))
        y[at : at + BLOCK] = from_x @ part + from_z @ z
        z = to_x @ part + to_z @ z
    return np.moveaxis(y.reshape(n, *shape), 0, -1), z.reshape(len(sections), 2, *shape)


def _settled(sections: np.ndarray, first: np.ndarray) -> np.ndarray:
    state, level = [], first
    for s in sections:
        own = _steady(s)
        state.append([own[0] * level, own[1] * level])
        level = level * s[:3].sum() / s[3:].sum()
    return np.array(state)


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forth and back, with odd extensions at both ends that the filter settles on."""
    pad = min(3 * (2 * len(sections) + 1), x.shape[-1] - 1)
    left = 2 * x[..., :1] - x[..., pad:0:-1]
    right = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    y = np.concatenate([left, x, right], axis=-1)
    for _ in range(2):
        y = filter_sections(sections, y, _settled(sections, y[..., 0]))[..., ::-1]
    return y[..., pad : y.shape[-1] - pad]


def band_pass(x: np.ndarray, rate: float, mode: str, low: float = WHOLE[0], high: float = WHOLE[1], order: int = ORDER) -> np.ndarray:
    if mode not in MODES:
        raise ValueError(f"unknown filter {mode}; known: {', '.join(MODES)}")
    if mode == "none":
        return x
    sections = butterworth(order, low, high, rate)
    return zero_phase(sections, x) if mode == "zerophase" else filter_sections(sections, x)


def filter_recordings(df: DataFrame, keys: Sequence[str], order: str, signal: str, rate: float, mode: str) -> DataFrame:
    """Each recording's epochs filtered as one signal, in order; gaps between kept epochs are run through."""
    if mode not in MODES:
        raise ValueError(f"unknown filter {mode}; known: {', '.join(MODES)}")

    at = df.columns.index(signal)

    def kernel(rows: pa.Table) -> pa.Table:
        x = epochs_of(rows.column(at))
        clean = band_pass(np.concatenate(list(x), axis=-1), rate, mode).reshape(x.shape[1], len(x), -1).transpose(1, 0, 2)
        return rows.set_column(at, signal, nested(clean).cast(rows.schema.field(at).type))

    return map_recordings(df, keys, order, kernel, _fields(df))


def filter_windows(rings: DataFrame, rate: float, channels: int, samples: int) -> DataFrame:
    """session, seq, signal of rows session, seq, _at, _ring: of each ring of epochs, filtered forth and back as one signal, the
    epoch at _at. Every row is by itself, so nothing is dealt anew."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sections = butterworth(ORDER, *WHOLE, rate)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                flat = part.column(3).flatten().flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
                x = flat.reshape(part.num_rows, -1, channels, samples).transpose(0, 2, 1, 3)
                y = zero_phase(sections, x.reshape(part.num_rows, channels, -1)).reshape(x.shape)
                at = part.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), nested(y[np.arange(len(at)), :, at])], names=["session", "seq", "signal"])

    kinds = dict(rings.dtypes)
    return rings.select("session", "seq", "_at", "_ring").mapInArrow(task, f"session {kinds['session']}, seq {kinds['seq']}, signal array<array<double>>")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def epochs_of(signal: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """[epoch, channel, sample] of a column of channels' samples; all epochs of one size."""
    if isinstance(signal, pa.ChunkedArray):
        signal = signal.combine_chunks()
    channels = signal.flatten()
    return channels.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(signal), len(channels) // max(len(signal), 1), -1)


def nested(x: np.ndarray) -> pa.Array:
    """[epoch, channel, sample] as a column of lists of lists."""
    epochs, channels, samples = x.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(epochs * channels + 1) * samples, pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(epochs + 1) * channels, pa.int32()), inner)


def welch(x: np.ndarray, rate: float, seconds: float = 5.0, average: str = "median") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, density) along the last axis: Hamming windows that overlap by half, each without its mean, one-sided."""
    n = min(int(seconds * rate), x.shape[-1])
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.lib.stride_tricks.sliding_window_view(x, n, axis=-1)[..., :: n - n // 2, :]
    parts = (parts - parts.mean(axis=-1, keepdims=True)) * window
    power = np.abs(np.fft.rfft(parts, axis=-1)) ** 2 / (rate * (window**2).sum())
    power[..., 1 : None if n % 2 else -1] *= 2
    if average == "mean":
        return np.fft.rfftfreq(n, 1 / rate), power.mean(axis=-2)
    k = power.shape[-2]
    bias = 1 + sum(1 / (2 * i + 1) - 1 / (2 * i) for i in range(1, (k - 1) // 2 + 1))
    return np.fft.rfftfreq(n, 1 / rate), np.median(power, axis=-2) / bias


def _power(freqs: np.ndarray, psd: np.ndarray, band: tuple[float, float]) -> np.ndarray:
    return psd[..., (freqs >= band[0]) & (freqs < band[1])].sum(axis=-1) * (freqs[1] - freqs[0])


def band_features(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """abspow, six relative powers, four ratios; and over windows of five seconds each band's largest and least share."""
    freqs, psd = welch(x, rate)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = _power(freqs, psd, WHOLE)
        out = {"abspow": whole} | {n: _power(freqs, psd, b) / whole for n, b in BANDS.items()}
        delta = out["sdelta"] + out["fdelta"]
        out |= {"dt": delta / out["theta"], "ds": delta / out["sigma"], "db": delta / out["beta"], "at": out["alpha"] / out["theta"]}
        width = int(5 * rate)
        parts = x[..., : x.shape[-1] // width * width].reshape(*x.shape[:-1], -1, width)
        if parts.shape[-2]:
            f, p = welch(parts, rate)
            share = {n: _power(f, p, b) / _power(f, p, WHOLE) for n, b in BANDS.items()}
            out |= {f"{n}_max": s.max(axis=-1) for n, s in share.items()} | {f"{n}_min": s.min(axis=-1) for n, s in share.items()}
    return out


def time_features(x: np.ndarray) -> dict[str, np.ndarray]:
    d1, d2 = np.diff(x, axis=-1), np.diff(x, 2, axis=-1)
    var, v1, v2 = x.var(axis=-1), d1.var(axis=-1), d2.var(axis=-1)
    c = x - x.mean(axis=-1, keepdims=True)
    q = np.quantile(x, [0.25, 0.75], axis=-1)
    windows = np.array_split(x, 10, axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mobility = np.sqrt(v1 / var)
        return {
            "std": np.sqrt(var), "iqr": q[1] - q[0], "skew": (c**3).mean(-1) / var**1.5, "kurt": (c**4).mean(-1) / var**2 - 3,
            "nzc": np.diff(np.signbit(x), axis=-1).sum(-1).astype(float), "mobility": mobility, "complexity": np.sqrt(v2 / v1) / mobility,
            "mmd": sum(np.hypot(w.max(-1) - w.min(-1), w.argmax(-1) - w.argmin(-1)) for w in windows),
            "esis": (x**2).sum(-1) * (d1**2).sum(-1),
        }


def complexity_features(x: np.ndarray, kmax: int = 10) -> dict[str, np.ndarray]:
    """Permutation entropy of order three, Higuchi's and Petrosian's fractal dimension."""
    n = x.shape[-1]
    triples = np.argsort(np.lib.stride_tricks.sliding_window_view(x, 3, axis=-1), axis=-1, kind="stable")
    code = triples @ np.array([9, 3, 1])
    share = np.stack([(code == k).mean(axis=-1) for k in (5, 7, 11, 15, 19, 21)])
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(share * np.log2(np.where(share > 0, share, 1)), axis=0) / np.log2(6)
        lengths = []
        for k in range(1, kmax + 1):
            own = [np.abs(np.diff(x[..., m::k], axis=-1)).sum(-1) * (n - 1) / (((n - m - 1) // k) * k * k) for m in range(k)]
            lengths.append(np.log(np.mean(own, axis=0)))
        at = np.log(1.0 / np.arange(1, kmax + 1))
        at = at - at.mean()
        higuchi = np.tensordot(at, np.array(lengths), 1) / (at**2).sum()
        d = np.diff(x, axis=-1)
        turns = (d[..., 1:] * d[..., :-1] < 0).sum(-1)
        petrosian = np.log10(n) / (np.log10(n) + np.log10(n / (n + 0.4 * turns)))
    return {"perm_entropy": entropy, "higuchi": higuchi, "petrosian": petrosian}


def envelope(x: np.ndarray, rate: float) -> np.ndarray:
    """The size of the analytic signal in the spindle band."""
    y = zero_phase(butterworth(4, *SPINDLE, rate), x)
    n = y.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(y, axis=-1) * gain, axis=-1))


def runs(above: np.ndarray, rate: float, shortest: float = 0.5, longest: float = 2.0) -> tuple[int, float]:
    """(count, seconds) of runs of true samples between the bounds, inclusive; runs open at an end count."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], above.astype(np.int8), [0]))))
    length = (edge[1::2] - edge[::2]) / rate
    fits = (length >= shortest) & (length <= longest)
    return int(fits.sum()), float(length[fits].sum())


SPINDLE_LEVEL, SPINDLE_EVERY, SPINDLE_KEEP = 0.92, 20, 5


def spindle_thresholds(envelopes: np.ndarray, level: float = SPINDLE_LEVEL, every: int = SPINDLE_EVERY, keep: int = SPINDLE_KEEP) -> np.ndarray:
    """Each epoch's threshold, from envelopes [epoch, sample]: a quantile of every `keep`-th sample up to the last epoch whose
    number (from one) divides by `every`; up to the first one before there is such."""
    number = np.arange(1, len(envelopes) + 1)
    seen = np.maximum(number // every * every, 1)
    return np.concatenate([np.full((seen == k).sum(), np.quantile(envelopes[:k, ::keep], level)) for k in np.unique(seen)]) if len(seen) else np.zeros(0)


def spindles(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(count, seconds) of spindles in each epoch of a recording [epoch, sample], by thresholds that follow the recording."""
    size = envelope(x, rate)
    found = [runs(above, rate) for above in size > spindle_thresholds(size)[:, None]]
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], float)


def channel_features(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Between two channels [.., 2, sample]: ratios of alpha and fast delta, and correlations, whole and by band."""
    freqs, psd = welch(x, rate)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda b: _power(freqs, psd, BANDS[b]) / _power(freqs, psd, WHOLE)
        a, f = share("alpha"), share("fdelta")
        out = {"ratio__alpha": a[..., 1] / a[..., 0], "ratio__fdelta": f[..., 0] / f[..., 1]}
        for name, band in {"broad": None, **BANDS, "eog": (0.3, 2.0)}.items():
            y = x if band is None else zero_phase(butterworth(4, *band, rate), x)
            c = y - y.mean(axis=-1, keepdims=True)
            out[f"corr__{name}"] = (c[..., 0, :] * c[..., 1, :]).mean(-1) / np.sqrt((c**2).mean(-1).prod(-1))
    return out


FAMILIES = {
    "power": ("abspow", *BANDS, "dt", "ds", "db", "at"),
    "extremes": tuple(f"{b}_{k}" for b in BANDS for k in ("max", "min")),
    "time": ("std", "iqr", "skew", "kurt", "nzc", "mobility", "complexity"),
    "distance": ("mmd", "esis"),
    "complexity": ("perm_entropy", "higuchi", "petrosian"),
}
_FAMILY_OF = {n: f for f, names in FAMILIES.items() for n in names}


def describe(name: str, channels: Sequence[str]) -> dict:
    """A feature's channels (a set), family, context (none, centre, trail or shift) and base name, from its column's name."""
    base, context = name, "none"
    for tail, kind in (("_c7min", "centre"), ("_p2min", "trail")):
        if base.endswith(tail):
            base, context = base.removesuffix(tail), kind
    head, sign, _ = base.rpartition("_ep")
    if sign and base[len(head) + 3 :].lstrip("+-").isdigit():
        base, context = head, "shift"
    base = base.removesuffix("_norm").removesuffix("_posthoc")
    own, _, rest = base.partition("__")
    if own in channels:
        return {"channels": frozenset([own]), "family": _FAMILY_OF.get(rest, "spindle" if "spindle" in rest else "other"), "context": context, "base": base}
    family = own if own in ("ratio", "corr") else "clock" if base == "time_hour" else "other"
    return {"channels": frozenset(channels) if family in ("ratio", "corr") else frozenset(), "family": family, "context": context, "base": base}


def epoch_kernel(x: np.ndarray, rate: float, channels: Sequence[str], without: Sequence[str] = ()) -> dict[str, np.ndarray]:
    """All features of epochs [epoch, channel, sample], by name, but for the families in `without`; infinities and undefined
    values are nan."""
    out: dict[str, np.ndarray] = {}
    for i, channel in enumerate(channels):
        found = band_features(x[:, i], rate) | time_features(x[:, i]) | complexity_features(x[:, i])
        out |= {f"{channel}__{n}": v for n, v in found.items() if _FAMILY_OF[n] not in without}
    if len(channels) == 2:
        out |= channel_features(x, rate)
    return {n: np.where(np.isfinite(v), v, np.nan) for n, v in out.items()}


def feature_names(rate: float, channels: Sequence[str], samples: int, without: Sequence[str] = ()) -> list[str]:
    """The names of the features, in order."""
    rng = np.random.default_rng(0)
    return list(epoch_kernel(rng.normal(size=(1, len(channels), samples)), rate, channels, without))


def epoch_features(df: DataFrame, columns: Sequence[str], signal: str, rate: float, channels: Sequence[str], samples: int, without: Sequence[str] = ()) -> DataFrame:
    """The given columns and `features`, an array in the order of feature_names(); nothing is shuffled."""
    names = feature_names(rate, channels, samples, without)
    fields = ", ".join(f"`{n}` {t}" for n, t in df.select(*columns).dtypes)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = epochs_of(part.column(len(columns)))
                found = epoch_kernel(x, rate, channels, without)
                rows = np.stack([found[n] for n in names], axis=1)
                values = pa.array([[None if np.isnan(v) else v for v in r] for r in rows.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], names=[*columns, "features"])

    return df.select(*columns, signal).mapInArrow(task, f"{fields}, features array<double>")


def spindle_features(df: DataFrame, keys: Sequence[str], order: str, signal: str, rate: float, channel: int = 0) -> DataFrame:
    """(keys, order, n_spindles, spindle_seconds): the adaptive counter over each recording in order."""
    kinds = dict(df.dtypes)

    def kernel(rows: pa.Table) -> pa.Table:
        count, seconds = spindles(epochs_of(rows.column(signal))[:, channel], rate)
        return rows.select([*keys, order]).append_column("n_spindles", pa.array(count)).append_column("spindle_seconds", pa.array(seconds))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, order)), "n_spindles long, spindle_seconds double"])
    return map_recordings(df.select(*keys, order, signal), keys, order, kernel, schema)

"""FLAC against an encoder of its own, and resampling against plain convolution."""

import numpy as np
import pandas as pd
import pytest

from tempora.operators import sound
from tempora.sources import flac


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - k)) & 1 for k in range(width)]

    def unary(self, zeros):
        self.bits += [0] * zeros + [1]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def residual(w, r, block, order, k, parts=0, escape=False, wide=False):
    w.put(int(wide), 2)
    w.put(parts, 4)
    width, at = 5 if wide else 4, 0
    for p in range(1 << parts):
        n = (block >> parts) - (order if p == 0 else 0)
        piece = [int(v) for v in r[at : at + n]]
        at += n
        if escape:
            w.put((1 << width) - 1, width)
            w.put(20, 5)
            for v in piece:
                w.put(v & 0xFFFFF, 20)
            continue
        w.put(k, width)
        for v in piece:
            folded = v << 1 if v >= 0 else (-v << 1) - 1
            w.unary(folded >> k)
            w.put(folded & (1 << k) - 1, k)


def subframe(w, x, bits, how):
    kind, more = how
    w.put(0, 1)
    wasted = more.get("wasted", 0)
    w.put({"constant": 0, "verbatim": 1, "fixed": 8 + more.get("order", 0), "lpc": 31 + len(more.get("weights", [0]))}[kind], 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.unary(wasted - 1)
        x, bits = x >> wasted, bits - wasted
    mask = (1 << bits) - 1
    if kind == "constant":
        w.put(int(x[0]) & mask, bits)
    elif kind == "verbatim":
        for v in x:
            w.put(int(v) & mask, bits)
    else:
        order = more["order"] if kind == "fixed" else len(more["weights"])
        for v in x[:order]:
            w.put(int(v) & mask, bits)
        if kind == "fixed":
            r = np.diff(x, order)
        else:
            w.put(more["precision"] - 1, 4)
            w.put(more["shift"], 5)
            for c in more["weights"]:
                w.put(c & (1 << more["precision"]) - 1, more["precision"])
            r = np.array([int(x[i]) - (sum(c * int(x[i - 1 - j]) for j, c in enumerate(more["weights"])) >> more["shift"]) for i in range(order, len(x))])
        residual(w, r, len(x), order, more.get("k", 5), more.get("parts", 0), more.get("escape", False), more.get("wide", False))


def stream(frames, sr, bits, channels, block):
    """``frames``: (samples of each channel, assignment, how each subframe is coded)."""
    total = sum(len(f[0][0]) for f in frames)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + ((sr << 44) | (channels - 1) << 41 | (bits - 1) << 36 | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + (5).to_bytes(3, "big") + b"hello"
    for number, (parts, assignment, hows) in enumerate(frames):
        n = len(parts[0])
        coded = bytes([number]) if number < 128 else bytes([0xC0 | number >> 6, 0x80 | number & 63])
        head = bytes([0xFF, 0xF8, 0x70, assignment << 4]) + coded + (n - 1).to_bytes(2, "big")
        head += bytes([flac.crc8(head)])
        w = Writer()
        parts = [np.asarray(p, np.int64) for p in parts]
        if assignment == flac.LEFT_SIDE:
            parts = [parts[0], parts[0] - parts[1]]
        elif assignment == flac.SIDE_RIGHT:
            parts = [parts[0] - parts[1], parts[1]]
        elif assignment == flac.MID_SIDE:
            parts = [(parts[0] + parts[1]) >> 1, parts[0] - parts[1]]
        wider = {flac.LEFT_SIDE: 1, flac.SIDE_RIGHT: 0, flac.MID_SIDE: 1}.get(assignment)
        for k, (p, how) in enumerate(zip(parts, hows)):
            subframe(w, p, bits + (k == wider), how)
        frame = head + w.bytes()
        out += frame + flac.crc16(frame).to_bytes(2, "big")
    return out


def recordings():
    r = np.random.default_rng(7)
    wave = lambda n, f=0.02: (9000 * np.sin(f * np.arange(n)) + r.integers(-60, 60, n)).astype(np.int64)
    lpc = ("lpc", {"weights": [30, -14], "precision": 6, "shift": 4, "k": 6})
    mono = [([wave(512)], 0, [("fixed", {"order": o, "k": 8, "parts": o % 3})]) for o in range(5)] + [([wave(512)], 0, [lpc])]
    mono += [([np.full(512, -77)], 0, [("constant", {})]), ([wave(512)], 0, [("verbatim", {})]), ([wave(512) << 3], 0, [("fixed", {"order": 2, "wasted": 3, "k": 7, "wide": True})])]
    mono += [([wave(512)], 0, [("fixed", {"order": 1, "escape": True, "parts": 2})]) for _ in range(125)] + [([wave(100)], 0, [("verbatim", {})])]
    stereo = [([wave(256), wave(256, 0.021)], a, [("fixed", {"order": 2, "k": 7}), lpc]) for a in (1, flac.LEFT_SIDE, flac.SIDE_RIGHT, flac.MID_SIDE)]
    return {"mono": (mono, 16000, 16, 1, 512), "stereo": (stereo, 44100, 16, 2, 256)}


def test_recordings_round_trip_and_breaks_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flac, "TOGETHER", 5)
    made = recordings()
    for name, args in made.items():
        (tmp_path / f"{name}.flac").write_bytes(stream(*args))
    frames = flac.flac_frames(spark, str(tmp_path))
    assert frames.count() == sum(len(a[0]) for a in made.values())
    got = {r.path.split("/")[-1][:-5]: r for r in flac.flac(spark, str(tmp_path)).collect()}
    for name, (parts, sr, bits, _, _) in made.items():
        want = np.concatenate([np.stack(p[0]).mean(axis=0) for p in parts]) / 2 ** (bits - 1)
        assert got[name].sr == sr and np.array_equal(np.array(got[name].samples, np.float32), want.astype(np.float32))
    both = {r.path.split("/")[-1]: r for r in flac.recordings(spark, str(tmp_path), 8000).collect()}
    assert {r.sr for r in both.values()} == {8000} and len(both["mono.flac"].samples) == -(-len(got["mono"].samples) // 2)
    whole = stream(*made["stereo"])
    broken = {"bit": whole[:200] + bytes([whole[200] ^ 4]) + whole[201:], "cut": whole[:-40], "short": stream(made["stereo"][0][:3], *made["stereo"][1:])[:-0 or None], "other": b"RIFF" + whole}
    broken["short"] = whole[:21] + b"\x02" + whole[22:]  # says another number of samples
    for name, content in broken.items():
        (tmp_path / "broken").mkdir(exist_ok=True)
        (tmp_path / "broken" / f"{name}.flac").write_bytes(content)
        with pytest.raises(Exception, match=f"{name}.flac: (a frame with|no frame with|[0-9]+ samples of|not a FLAC)"):
            flac.flac_frames(spark, str(tmp_path / "broken"), f"{name}.flac").collect()


@pytest.mark.parametrize(("sr", "rate"), [(44100, 16000), (16000, 22050), (8000, 16000), (48000, 16000), (16000, 16000), (22050, 44100)])
def test_resampling_equals_convolution_and_blocks_do_not_show(spark, monkeypatch, sr, rate):
    x = np.random.default_rng(sr).normal(size=700)
    part = np.gcd(sr, rate)
    up, down = rate // part, sr // part
    stretched = np.zeros(len(x) * up)
    stretched[::up] = x
    h = sound.sinc_filter(up, down)
    want = np.convolve(stretched, h)[len(h) // 2 :][: len(x) * up : down] if up != down else x
    assert np.allclose(sound.at_rate(x, sr, rate), want, atol=1e-9)
    monkeypatch.setattr(sound, "TOGETHER", 37)
    assert np.allclose(sound.at_rate(x, sr, rate), want, atol=1e-9)
    t = np.arange(sr) / sr
    heard = sound.at_rate(np.sin(2 * np.pi * 440 * t), sr, rate)[rate // 10 : -rate // 10]
    assert np.abs(heard - np.sin(2 * np.pi * 440 * np.arange(rate) / rate)[rate // 10 : -rate // 10]).max() < 2e-3
    audio = spark.createDataFrame(pd.DataFrame({"path": ["a", "none"], "sr": sr, "samples": [x.tolist(), []]}), "path string, sr int, samples array<float>")
    rows = {r.path: r for r in sound.resampled(audio, rate).collect()}
    assert rows["a"].sr == rate and np.allclose(rows["a"].samples, want, atol=1e-5) and rows["none"].samples == []

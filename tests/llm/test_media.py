from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sylva.llm import media

SCHEMA = "conv_id long, turn long, text string"


def test_pure_tones_fall_into_their_pitch_class():
    t = np.arange(11025 * 2) / 11025
    for semitone in range(12):
        frames = media.chroma_frames(np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t))
        assert len(frames) > 5 and (frames.argmax(axis=1) == semitone).all()
    assert media.chroma_frames(np.zeros(10)).shape == (0, 12)


def test_filters_answer_like_plain_sums():
    frames = np.random.default_rng(1).random((40, 12))
    unit = frames / np.linalg.norm(frames, axis=1, keepdims=True)
    got = media.fingerprint(frames)
    assert len(got) == 40 - media.WIDTH + 1
    shape, y, h, w = media.FILTERS[0]
    whole, part = unit[3 : 3 + w, y : y + h].sum(), unit[3 : 3 + w, y : y + h // 2].sum()
    level = sum(np.log((1 + part) / (1 + whole - part)) >= x for x in (-0.12, 0.0, 0.12))
    assert shape == 0 and got[3] & 3 == media.GRAY[level]


def test_prints_dont_depend_on_what_is_around():
    r = np.random.default_rng(3)
    all_ = [r.integers(0, 5, (n, 12)).astype(float) for n in (40, 0, 16, 15, 3, 200, 1)]
    together = media.fingerprint_many(all_)
    assert [len(p) for p in together] == [25, 0, 1, 0, 0, 185, 0]
    for f, p in zip(all_, together):
        assert np.array_equal(media.fingerprint(f), p)
    assert np.array_equal(media.fingerprint(all_[5][70:]), together[5][70:])
    assert media.fingerprint_many([]) == []


def test_alignment_finds_the_shift():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 32, 300, dtype=np.uint32)
    for shift in (0, 1, 57, 200):
        assert media.align(a, a[shift:]) == (-shift, 0.0, 300 - shift)
        assert media.align(a[shift:], a) == (shift, 0.0, 300 - shift)
    noisy = a.copy()
    noisy[::3] ^= 1
    assert media.align(a, noisy) == (0, 100 / (32 * 300), 300)
    same = np.zeros(100_000, np.uint32)
    assert media.align(same, same) == (0, 0.0, 100_000)
    assert media.align(a[:0], a)[2] == 0


def test_alignment_of_repetitive_recordings():
    r = np.random.default_rng(7)
    loop = np.tile(r.integers(0, 1 << 32, 6, dtype=np.uint32), 60)
    a = loop[r.integers(0, len(loop), 400)]
    for shift in (0, 3, 40):
        assert media.align(a, a[shift:]) == (-shift, 0.0, 400 - shift)
        assert media.align(a[shift:], a) == (shift, 0.0, 400 - shift)
    for x, y in ((a[:90], a[17:]), (loop, loop[5:]), (loop[:100], loop)):
        votes = [sum(x[max(0, -o) : len(y) - o] == y[max(0, o) : max(0, o) + len(x[max(0, -o) : len(y) - o])]) for o in range(-len(x) + 1, len(y))]
        most = [o for o, n in zip(range(-len(x) + 1, len(y)), votes) if n == max(votes)]
        assert media.align(x, y)[0] == min(most, key=lambda o: (abs(o), o))


def recordings():
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    base = [text(r.randint(150, 500)) for _ in range(60)]
    rows = [(i, 0, t) for i, t in enumerate(base)]
    for i in range(20):  # copies, and copies with a changed stretch
        t = base[i]
        rows.append((100 + i, 0, t))
        rows.append((200 + i, 1, t[:70] + text(6) + t[76:]))
    return rows + [(300, 0, None), (320, 0, ""), (340, 0, "short"), (340, 0, "short")]


def test_recall_against_all_pairs(spark):
    rows = recordings()
    prints = [(c, t, media.fingerprint(media.voiced_frames(x))) for c, t, x in rows]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as class", "2 as landmarks")
    got = {(r.conv_id, r.turn): r for r in media.aligned(df, F.col("conv_id") % 20 == 0, ("conv_id", "turn"), "text", media.voiced_frames).collect()}
    assert {k[0] for k in got} == {c for c, _, _ in rows if c % 20 == 0}
    want = hit = 0
    for c, t, p in prints:
        if c % 20 or not len(p):
            continue
        copies = sum(np.array_equal(p, q) for _, _, q in prints) - 1
        near = 0
        for _, _, q in prints:
            if len(q) and not np.array_equal(p, q):
                _, errors, overlap = media.align(p, q)
                near += errors <= 0.1 and overlap >= 0.8 * max(len(p), len(q))
        assert got[c, t].n_copies == copies and got[c, t].n_aligned <= near
        want, hit = want + near, hit + got[c, t].n_aligned
    assert want and hit >= 0.9 * want
    assert got[300, 0]["class"] is None and got[300, 0].n_aligned == 0


def test_long_recordings_in_stretches(monkeypatch):
    frames = np.random.default_rng(8).integers(0, 9, (1000, 12)).astype(float)
    whole = media.fingerprint(frames)
    monkeypatch.setattr(media, "TOGETHER", 64)
    assert np.array_equal(media.fingerprint(frames), whole) and len(whole) == 1000 - media.WIDTH + 1
    assert [len(x) for x in media._together(iter([frames[:n] for n in (30, 30, 30, 900, 1)]))] == [2, 1, 1, 1]


def noisy(notes: bytes, every: int, r: random.Random) -> bytes:
    """Wrong notes, spread evenly."""
    out = bytearray(notes)
    for i in range(r.randrange(every), len(out), every):
        out[i] = r.randrange(97, 123)
    return bytes(out)


def test_recall_on_spread_noise_shifts_and_loops(spark, monkeypatch):
    """Renditions up to the promised share of bit errors; and many more landmarks asked for than are broadcast."""
    r = random.Random(12)
    rows, n = [], 0
    for n in range(150):
        length = r.choice([90, 150, 300, 800, 2500])
        notes = bytes(r.randrange(97, 123) for _ in range(length))
        if n % 5 == 0:  # a loop
            notes = (notes[: r.randrange(30, 60)] * 100)[:length]
        if n % 5 == 1:  # a passage that many share
            notes = notes[: length // 2] + b"a common passage of some length that is in many recordings" + notes[length // 2 :]
        cut = r.randrange(0, len(notes) // 8)
        again = noisy(notes[cut:] if r.random() < 0.5 else notes[: len(notes) - cut], r.choice([300, 100, 60, 40, 30, 25]), r)
        rows += [(2 * n + 1, 0, notes.decode()), (2 * n + 2, 1, again.decode())]
    df = spark.createDataFrame(rows, SCHEMA)
    prints = {c: media.fingerprint(media.voiced_frames(x)) for c, _, x in rows}
    want = {}
    for c, turn, _ in rows:
        if turn == 1:
            for d, q in prints.items():
                if d != c and not np.array_equal(q, prints[c]):
                    _, errors, overlap = media.align(prints[c], q)
                    if errors <= 0.1 and overlap >= 0.8 * max(len(prints[c]), len(q)):
                        want[c] = want.get(c, 0) + 1
    errors = [media.align(prints[c], prints[c - 1])[1] for c in want]
    assert len(want) > 80 and sum(e > 0.05 for e in errors) > 20
    for most in (media.BROADCAST_ROWS, 0):
        monkeypatch.setattr(media, "BROADCAST_ROWS", most)
        got = {x.conv_id: x for x in media.aligned(df, F.col("turn") == 1, ("conv_id", "turn"), "text", media.voiced_frames).collect()}
        assert len(got) == 150 and all(got[c].n_aligned <= want.get(c, 0) for c in got)
        assert sum(got[c].n_aligned for c in got) >= 0.95 * sum(want.values())
        high = [c for c, e in zip(want, errors) if e > 0.07]
        assert sum(got[c].n_aligned >= 1 for c in high) >= 0.9 * len(high)


def test_no_recordings(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert media.aligned(df, F.lit(True), ("conv_id", "turn"), "text", media.voiced_frames).count() == 0

"""Windows and segments of samples from chunks cut anywhere, in a table and as they arrive."""

import random

import numpy as np
import pytest

from cadenza.operators import pcm
from cadenza.streaming import windows as stream
from tests.test_streams import Source, drain

CHUNKS = "rec long, seq long, body binary, last boolean"


def plain(body, size, overlap, rate):
    """Windows of a whole recording: (k, offset, duration, is_final, body)."""
    n, out, at = len(body) // 2, [], 0
    while n and (at == 0 or n - at * (size - overlap) > overlap):
        low = at * (size - overlap)
        out.append((at, low / rate, (min(low + size, n) - low) / rate, body[2 * low : 2 * min(low + size, n)]))
        at += 1
    return [(*x[:3], k == len(out) - 1, x[3]) for k, x in enumerate(out)]


def chunked(r, body):
    cuts = sorted(r.randrange(len(body) + 1) for _ in range(r.randrange(6)))
    return [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)])]


def recordings(r):
    out = {rec: bytes(r.randrange(256) for _ in range(2 * n)) for rec, n in enumerate([0, 1, 9, 10, 11, 12, 18, 19, 26, 27, 34, 57, 100])}
    return out, {rec: chunked(r, body) for rec, body in out.items()}


@pytest.mark.parametrize("stretch, group", [(1 << 20, 1 << 10), (16, 2)])
def test_windows_of_a_table(spark, monkeypatch, stretch, group):
    monkeypatch.setattr(pcm, "STRETCH", stretch)
    monkeypatch.setattr(pcm, "GROUP", group)
    bodies, chunks = recordings(random.Random(stretch))
    rows = [(rec, k, bytearray(x), None) for rec, own in chunks.items() for k, x in enumerate(own)] + [(99, 0, None, None)]
    found = {}
    for w in pcm.windows(spark.createDataFrame(rows, CHUNKS), 1.0, 0.2, 10).collect():
        found.setdefault(w.rec, []).append((w.k, w.offset, w.duration, w.is_final, bytes(w.body)))
    for rec, body in bodies.items():
        assert sorted(found.get(rec, [])) == plain(body, 10, 2, 10), rec
    assert 99 not in found


def test_windows_as_chunks_arrive(spark, tmp_path):
    """Chunks in any order over batches, each batch a new run; some come twice."""
    r = random.Random(7)
    bodies, chunks = recordings(r)
    rows = [(rec, k, bytearray(x), k == len(own) - 1) for rec, own in chunks.items() for k, x in enumerate(own)]
    r.shuffle(rows)
    source = Source(spark, tmp_path / "in", CHUNKS)
    out = str(tmp_path / "out")
    for part in (rows[:12], rows[12:30] + rows[:3], rows[30:]):
        source.add(part)
        drain(stream.windows(source.read(), 1.0, 0.2, 10).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    found = {}
    for w in spark.read.schema(stream.WINDOWS).parquet(out).collect():
        found.setdefault(w.rec, []).append((w.k, w.offset, w.duration, w.is_final, bytes(w.body)))
    for rec, body in bodies.items():
        assert sorted(found.get(rec, [])) == plain(body, 10, 2, 10), rec


def test_segments_and_samples(spark):
    r = random.Random(2)
    bodies, chunks = recordings(r)
    df = spark.createDataFrame([(rec, k, bytearray(x), None) for rec, own in chunks.items() for k, x in enumerate(own)], CHUNKS)
    segments = [(12, k, a, a + r.choice([0.0, 0.25, 0.35, 3.0])) for k, a in enumerate([-1.0, 0.05, 0.15, 0.25, 2.0, 9.0, 50.0])] + [(0, 0, 0.0, 1.0), (77, 0, 0.0, 1.0), (12, 9, 3.0, 1.0)]
    made = pcm.cut(df, pcm.segment_ranges(spark.createDataFrame(segments, "rec long, seg long, start double, end double"), 10))
    for row, (rec, _, start, end) in zip(sorted(made.collect(), key=lambda x: (x.rec, x.k)), sorted(segments)):
        low = max(0, round(start * 10))
        assert bytes(row.body) == bodies.get(rec, b"")[2 * low : 2 * max(low, round(end * 10))]
    got = df.where("rec = 12 and seq = 0").select(pcm.decoded("body").alias("x")).first()
    even = chunks[12][0]
    if len(even) % 2 == 0:
        assert got.x == pytest.approx((np.frombuffer(even, "<i2") / 32768).tolist())


def test_settings_and_cut_samples(spark):
    df = spark.createDataFrame([(1, 0, bytearray(b"abc"), True)], CHUNKS)
    for window, overlap in ((1.0, 1.0), (0.0, 0.0), (1.0, -0.1)):
        with pytest.raises(ValueError):
            pcm.windows(df, window, overlap, 10)
    with pytest.raises(Exception, match="the last sample is cut"):
        pcm.windows(df, 1.0, 0.2, 10).collect()

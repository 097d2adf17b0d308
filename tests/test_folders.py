"""Folders, files of any size, patterns and paths."""

import fnmatch
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as t
from cadenza.sources import folders, media


def tree(root):
    for name, size in {"a.MP3": 3, "B.wav": 2, "c.txt": 5, "d.asr.flac": 4, "empty.mp4": 0, "one/e.mkv": 7, "one/two/F.ogg": 1, "one/two/g.srt": 1, "three/h.opus": 9}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    (root / "link.mp3").symlink_to(root / "a.MP3")
    (root / "linked").symlink_to(root / "three")


def names(rows, root):
    return [(r.path.removeprefix(f"{root}/"), r.size, r.problem) for r in rows]


def test_scan_of_a_tree(spark, tmp_path):
    tree(tmp_path)
    got = names(folders.scan(spark, [str(tmp_path)]).collect(), tmp_path)
    assert got == [("a.MP3", 3, None), ("B.wav", 2, None), ("empty.mp4", 0, "empty"), ("one/e.mkv", 7, None), ("one/two/F.ogg", 1, None), ("three/h.opus", 9, None)]
    assert [x[0] for x in names(folders.scan(spark, [str(tmp_path)], recursive=False).collect(), tmp_path)] == ["a.MP3", "B.wav", "empty.mp4"]
    named = [str(tmp_path / x) for x in ("c.txt", "link.mp3", "nowhere", "d.asr.flac", "a.MP3", "three", "a.MP3")]
    assert names(folders.scan(spark, named).collect(), tmp_path) == [("a.MP3", 3, None), ("c.txt", None, "extension"), ("link.mp3", None, "link"), ("nowhere", None, "missing"), ("three/h.opus", 9, None)]


def test_unreadable_folders_are_told(spark, tmp_path, monkeypatch):
    tree(tmp_path)
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError(13, "Permission denied")) if str(p).endswith("two") else real(p))
    rows = [x for part in folders.FolderReader({"paths": f'["{tmp_path}"]'}).partitions() for x in folders.FolderReader({"paths": "[]"}).read(part)]
    assert (str(tmp_path / "one/two"), None, "Permission denied") in rows and any(r[0].endswith("e.mkv") for r in rows)


def test_limit_and_rejections(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"{k}.mp3").write_bytes(b"x")
    assert folders.accepted(spark, [str(tmp_path)], limit=30).count() == 30
    with pytest.raises(ValueError, match="more than 29"):
        folders.accepted(spark, [str(tmp_path)], limit=29)
    assert folders.scan(spark, [str(tmp_path)], limit=5).count() == 6  # a part stops at one more
    (tmp_path / "bad.mp4").write_bytes(b"")
    with pytest.raises(ValueError, match="empty"):
        folders.accepted(spark, [str(tmp_path)])


def test_digests_of_any_size(spark, tmp_path):
    r = random.Random(1)
    made = {"a b.bin": b"", "b%41.bin": r.randbytes(999), "c.bin": r.randbytes(1000), "d ü.bin": r.randbytes(70_001)}
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    with (tmp_path / "sparse.bin").open("wb") as f:
        f.truncate((2 << 30) + 5)
    by_size = {x.size: x.sha256 for x in media.file_fingerprints(spark, str(tmp_path), inline=999, chunk=4096 << 8).collect()}
    assert by_size == {len(b): hashlib.sha256(b).hexdigest() for b in made.values() if b} | {(2 << 30) + 5: _zeros((2 << 30) + 5)}


def _zeros(n):
    sha, block = hashlib.sha256(), bytes(1 << 24)
    while n:
        sha.update(block[: min(n, len(block))])
        n -= min(n, len(block))
    return sha.hexdigest()


def test_globs_as_patterns(spark):
    globs = ["*.json", "model-?????-of-*.safetensors", "vocab[12].txt", "[!a]*", "a.b+c", "x[", "[a^]z", "*"]
    r = random.Random(4)
    given = ["config.json", "config.jsonx", "Config.JSON", "model-00001-of-2.safetensors", "model-1-of-2.safetensors", "vocab1.txt", "vocab3.txt", "a.b+c", "aXb+c", "x[", "", "a\nb", "^z", "az"]
    given += ["".join(r.choice("ab.[]^*x") for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in given], "name string")
    for glob in globs:
        got = [x.m for x in df.select(t.matches_any(F.col("name"), (glob,)).alias("m")).collect()]
        assert got == [fnmatch.fnmatchcase(x, glob) for x in given], glob
    both = df.select(t.matches_any(F.col("name"), ("*.json", "a*")).alias("m"), t.matches_any(F.col("name"), ()).alias("none")).collect()
    assert [x.m for x in both] == [x.endswith(".json") or x.startswith("a") for x in given] and not any(x.none for x in both)


def test_paths_stay_inside(spark):
    given = {"a/b.json": "a/b.json", "./a//b": "a/b", "a\\b": "a/b", "/etc/x": None, "a/../b": None, "..": None, "C:\\x": None, "\\\\host\\x": None, "": None, ".": None, "a..b/c": "a..b/c"}
    df = spark.createDataFrame([(x,) for x in given], "p string")
    assert {x.p: x.s for x in df.select("p", t.safe_relative(F.col("p")).alias("s")).collect()} == given


def test_folded_as_python_folds(spark):
    """Every character, and texts of the odd ones."""
    chars = [chr(c) for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000]
    r = random.Random(2)
    odd = ["ß", "ẞ", "ς", "Σ", "ﬁ", "İ", "ı", "K", "Ǆ", "ŉ", "Ё", "ё", "a", "Z", "µ"]
    texts = chars + ["".join(r.choice(odd) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    wrong = [(x.x, x.f) for x in df.select("x", t.folded(F.col("x")).alias("f")).collect() if x.f != x.x.casefold()]
    assert [w for w in wrong if len(w[0]) > 1] == []
    assert len(wrong) <= 120  # characters newer than the Unicode of one of the two

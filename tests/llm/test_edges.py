"""Odd images, clashing names, hot and repeated rows, and statistics against brute force."""

import gzip
import io
import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from email.parser import BytesParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import features, media, mixing, packing, quality, sharding, sitetree, warc
from tests.llm.test_llm import PAGE, by_id, docs, odd, texts, words  # noqa: F401  fixtures


def bmp(bits, compression, rows, masks=b"", size=40, palette=b""):
    start = 14 + size + len(masks) + len(palette)
    head = struct.pack("<IiiHHIIiiII", 40, rows.shape[1] * 8 // bits, rows.shape[0], 1, bits, compression, 0, 0, 0, len(palette) // 4, 0) if size == 40 else struct.pack("<IHHHH", 12, rows.shape[1] * 8 // bits, rows.shape[0], 1, bits)
    return struct.pack("<2sIHHI", b"BM", 0, 0, 0, start) + head + masks + palette + rows[::-1].tobytes()


def test_masks_scales_and_old_headers():
    red = np.frombuffer(struct.pack("<II", 0xFF0000, 0x0000FF), np.uint8).reshape(1, 8)
    assert media.decode(bmp(32, 3, red, struct.pack("<III", 0xFF0000, 0xFF00, 0xFF)))[0].tolist() == [[255, 0, 0], [0, 0, 255]]
    assert media.decode(bmp(32, 3, red, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)))[0].tolist() == [[0, 0, 255], [255, 0, 0]]
    five = np.frombuffer(struct.pack("<HH", 0x7C00, 0x03E0), np.uint8).reshape(1, 4)
    assert media.decode(bmp(16, 0, five))[0].tolist() == [[255, 0, 0], [0, 255, 0]]
    assert media.decode(bmp(16, 3, five, struct.pack("<III", 0xF800, 0x7E0, 0x1F)))[0, 0].tolist() == [123, 130, 0]
    old = bmp(8, 0, np.array([[1, 0, 0, 0]], np.uint8), size=12, palette=bytes(k % 256 for k in range(256 * 3)))
    assert media.decode(old)[0, :2].tolist() == [[5, 4, 3], [2, 1, 0]]
    assert media.decode(b"P2 3 1 15 0 15 5")[0, :, 0].tolist() == [0, 255, 85]
    assert media.decode(b"P5 2 1 1000 " + struct.pack(">HH", 1000, 500))[0, :, 0].tolist() == [65535, 32768]


@pytest.mark.parametrize("data", [b"P2 99999999999999999999 1 255 1", b"P5 0 3 255 ", b"P2 1 1 255 99999999999999999999999", b"P2 2 2 255 1 2 3", b"P2 1 1 7 8", b"P5 100000 100000 255 x", b"P2 1 1 0 0", b"BM", b"BM" + bytes(60), b"P1 2 1 1 7", b""])
def test_what_is_no_image_is_said_so(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_tiles_hold_the_image(spark):
    image = np.random.default_rng(1).integers(0, 256, (5, 7), dtype=np.uint8)
    rows = spark.createDataFrame([(1, bytearray(media.to_pgm(image))), (2, bytearray(b"P2 99999999999999999999 1 255 1"))] * 2, "id long, content binary")
    found = media.tiles(rows, "id", "content", tile=4).collect()
    whole = np.zeros((5, 7), np.uint8)
    for r in found:
        if r.id == 1:
            tile = np.load(io.BytesIO(bytes(r.npy)))
            whole[r.tile_row * 4 : r.tile_row * 4 + 4, r.tile_col * 4 : r.tile_col * 4 + 4] = tile[:, :, 0]
    assert (whole == image).all() and Counter(r.id for r in found) == {1: 8, 2: 2}


def brute_table(shards, size, seed="shard"):
    import hashlib

    orders = [hashlib.md5(f"{seed}/{s}".encode()).hexdigest() for s in range(shards)]
    start, step = [int(d[:8], 16) % size for d in orders], [1 + int(d[8:16], 16) % (size - 1) for d in orders]
    free, out = set(range(size)), {}
    for t in range(size):
        s = t % shards
        slot = min(free, key=lambda x: (x * step[s] + start[s]) % size)
        free.remove(slot)
        out[slot] = s
    return out


@pytest.mark.parametrize(("shards", "size"), [(1, 2), (3, 7), (5, 503), (16, 1607)])
def test_lookup_table(spark, shards, size):
    assert {r.slot: r.shard for r in sharding.lookup_table(spark, shards, size).collect()} == brute_table(shards, size)


def test_clashing_names(spark, docs):  # noqa: F811
    clash = docs.select("doc_id", "text", "source", *[F.lit(k).alias(x) for k, x in enumerate(("slot", "shard", "_position", "_copies", "_id", "_passes", "_pass", "size", "h", "bucket"))])
    placed = sharding.place(clash, "slot")
    assert placed.count() == docs.count() and placed.columns[-2:] == ["slot", "shard"]
    assert mixing.take(clash).columns == clash.columns and mixing.take(clash).count() > 0
    with pytest.raises(ValueError):
        sharding.place(clash, "doc_id", size=1 << 21)


def test_another_tokenizer(spark, docs):  # noqa: F811
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, by = packing.load_tokenizer(path), by_id(docs)
    assert not packing.Encoder(tokenizer).by_words and packing.Encoder(packing.load_tokenizer()).by_words
    parts = defaultdict(list)
    for r in packing.pack(docs, tokenizer_path=path).collect():
        parts[r.doc_id].append((r.start, r.ids))
    for key, text in by.items():
        assert [i for _, ids in sorted(parts[key]) for i in ids] == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_packing_past_every_batch(spark):
    """More characters than are tokenised at once, and a text longer than that by itself."""
    long = " ".join(words(60_000, 4))
    made = [(k, " ".join(words(30_000, k)) if k else long * (1 + packing.BATCH_CHARS // len(long))) for k in range(8)]
    df = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    tokens = {r.doc_id: r.doc_tokens for r in packing.pack(df, with_ids=False).select("doc_id", "doc_tokens").distinct().collect()}
    tokenizer = packing.load_tokenizer()
    assert tokens == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in made}


def plain_features(text):
    """Words of a text by a scan over its bytes."""
    body, out, k = text.encode(), set(), 0
    lowered = bytes(c + 32 if 65 <= c <= 90 or (k and body[k - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97) else c for k, c in enumerate(body))
    kind = lambda c: 0 if c in b" \t\n\x0b\x0c\r" else 2 if c >= 128 or chr(c).isalnum() or c == 95 else 1
    while k < len(body):
        end = k
        while end < len(body) and kind(body[end]) == kind(body[k]):
            end += 1
        if kind(body[k]):
            out.add((0, lowered[k:end]))
            if kind(body[k]) == 2:
                out |= {(n, lowered[k : k + n]) for n in features.PREFIXES if end - k > n}
        k = end
    return out


def test_features_of_many_texts_are_those_of_each():
    made = [t or "" for t in texts()] + ["Ä Ö É straße! Ä", "a_b c1 ... a_b", "x" * 9]
    found, counts, layout = features.describe([t.encode() for t in made])
    ends = np.cumsum(counts)
    assert len(layout) == len(made) and np.isfinite(layout).all()
    for text, n, end in zip(made, counts, ends, strict=True):
        alone, _, shape = features.describe([text.encode()])
        assert set(found[end - n : end].tolist()) == set(alone.tolist()) and np.allclose(shape[0], layout[made.index(text)])
        assert n <= len(plain_features(text)) <= n + 2  # but for what one number stands for twice


def test_surest_candidates_are_those_of_brute_force(spark):
    """A small matrix: the pool's best rows of each label, view and class, found by tasks and put together."""
    r = np.random.default_rng(2)
    n, width = 400, 30
    y = r.integers(0, 2, n)
    found = [np.unique(np.concatenate([r.integers(0, width, 5), [0 if c else 1]])) for c in y]
    layout = r.normal(size=(n, features.LAYOUT)) + y[:, None] * 1.5
    model = {"mean": layout.mean(0), "std": layout.std(0)}
    zeros = np.zeros(n, int)
    meta = quality.meta_view(layout, zeros, zeros, model)
    known = np.where(np.arange(n) < 150, y, -1)
    own = quality.Learner(found[:150], meta[:150], known[:150], np.ones(150), np.ones(width))
    own.train()
    rows = [(1000 + k, found[k].tolist(), 0, 0, layout[k].astype(np.float32).tolist()) for k in range(150, n)]
    pool = spark.createDataFrame(rows, "key long, found array<int>, lang int, source int, layout array<float>").repartition(5)
    given = defaultdict(list)
    for label, view, c, row in quality.surest(pool, {"quality": own}, model):
        given[view, c].append(row["key"])
    shown = quality.meta_view(np.array([x[4] for x in rows]), zeros[150:], zeros[150:], model)
    z = quality.view_odds([np.array(x[1]) for x in rows], shown, own.model())
    for view in (0, 1):
        for c in (0, 1):
            p = quality.sigmoid(z[view] if c else -z[view])
            order = sorted((k for k in range(len(rows)) if p[k] >= quality.SURE), key=lambda k: (-p[k], rows[k][0]))
            assert given[view, c] == [rows[k][0] for k in order[: own.wanted()[c]]]
    assert given[0, 1] and given[1, 1]


def test_quality_of_repeated_rows_is_one(spark):
    """Rows that repeat an id, in any order of files, fit the same model."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    twice = d.unionByName(d.where("doc_id % 3 = 0").withColumn("text", F.lower("text")))
    a = quality.fit(twice.orderBy("doc_id"), labels, rounds=1)
    b = quality.fit(twice.orderBy(F.desc("n_chars")).repartition(3), labels, rounds=1)
    assert (a["at"] == b["at"]).all() and (a["quality"] is None) == (b["quality"] is None)


def test_copies_cost_no_text(spark):
    page = PAGE.format(n="same")
    other = "<html><body><nav>Menu</nav><article><h1>Head</h1><p>Body of the other page</p><ul><li>point</li></ul></article></body></html>"
    rows = [(k, "http://h.example/a", page) for k in range(200)] + [(500, "http://h.example/b", other)]
    found = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[500] == "Head Body of the other page point" and found[0].startswith("Head & more First same line")


def test_entropies_and_branches(spark):
    """The tree of a host by brute force: entropies of contents over its different pages, and branches weighed by characters."""
    r = random.Random(6)
    made = []
    for k in range(60):
        made.append(f"<html><body><div class='share'>Share it</div><div class='top'><p>{r.choice(['Sale today', 'Sale now'])}</p></div><article><p>Text {r.randrange(20)}</p><div class='x'>Always here</div></article><footer>f</footer></body></html>")
    rows = [(k, f"http://h.example/{k}", page) for k, page in enumerate(made + made[:30])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {(n.path, n.kept): n for n in sitetree.tree(df.select(sitetree.host(F.col("url")).alias("site"), "html")).collect()}
    contents, chars = defaultdict(Counter), Counter()
    for page in set(made):
        own = defaultdict(list)
        for node, text, kept in sitetree.by_meaning(page):
            own[node.path, kept].append(text)
        for key, texts_ in own.items():
            contents[key]["\n".join(texts_)] += 1
            chars[key] += sum(map(len, texts_))
    assert set(found) == set(contents)
    for key, counts in contents.items():
        n = sum(counts.values())
        entropy = -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(max(2, n))
        assert (found[key].pages, found[key].chars) == (n, chars[key]) and found[key].content == pytest.approx(entropy, abs=1e-9)
    nodes = spark.createDataFrame(list(found.values()))
    importance = {(b.path, b.kept): b.importance for b in sitetree.branches(nodes).collect()}
    for (path, kept), value in importance.items():
        inside = [n for (p, k), n in found.items() if k == kept and (p == path or p.startswith(path + "/"))]
        rate = lambda n: (n.content + sitetree.PRESENTATION * n.style * (1 - n.content)) * (1 if kept else sitetree.FRAME)
        assert value == pytest.approx(sum(rate(n) * n.chars for n in inside) / sum(n.chars for n in inside))
    assert all("Always" not in x.text and x.text.startswith("Text") for x in sitetree.extract(df).collect())


def test_warc_headers_by_another_parser(spark):
    pages = spark.createDataFrame([(1, "http://e/x", "<table><tr><td>a</td><td>b</td></tr></table>"), (1, "http://e/x", "<p>again"), (2, "http://e/y", None)], "page_id long, url string, html string")
    records = warc.responses(pages).collect()
    sources = {}
    for r in records:
        head, _, rest = bytes(r.content).partition(b"\r\n\r\n")
        sources[BytesParser().parsebytes(head.partition(b"\r\n")[2])["WARC-Record-ID"]] = BytesParser().parsebytes(head.partition(b"\r\n")[2])
    for r in warc.derive(warc.responses(pages), "page_id", "content").collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        own = BytesParser().parsebytes(head.partition(b"\r\n")[2])
        source = sources[own["WARC-Refers-To"]]
        assert own["WARC-Source-Block-Digest"] == source["WARC-Block-Digest"] and own["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"]
        assert own["WARC-Target-URI"] == source["WARC-Target-URI"] and own["WARC-Date"] == source["WARC-Date"]
        assert int(own["Content-Length"]) == len(r.block.encode()) and rest == r.block.encode() + b"\r\n\r\n"
        if r.record_type == "conversion" and r.target_uri == "http://e/x" and "again" not in r.block:
            assert r.block == "a b"


@pytest.mark.parametrize("coding", ["plain", "gzip", "deflate", "chunked", "chunked gzip", "broken"])
def test_codings(coding):
    page = b"<p>some text &amp; more</p>" * 20
    body, http = page, [("Content-Type", "text/html")]
    if "gzip" in coding or coding == "broken":
        body, http = gzip.compress(body), [*http, ("Content-Encoding", "gzip")]
    if coding == "deflate":
        body, http = zlib.compress(body), [*http, ("Content-Encoding", "deflate")]
    if coding == "broken":
        body = b"not packed"
    if "chunked" in coding:
        parts = [body[k : k + 7] for k in range(0, len(body), 7)]
        body, http = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n", [*http, ("Transfer-Encoding", "chunked")]
    assert warc.unpacked(http, body) == (page if coding != "broken" else b"not packed")


def test_media_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (2, "same"), (None, None)], "doc_id long, text string")
    found = [tuple(r)[1:] for r in media.text_media(df).collect()]
    assert len(found) == 4 and found[0] == found[1] == found[2] != found[3]


def test_arrow_of_a_slice():
    texts_ = pa.array(["a", "b" * 10, None, "c" * (features.BATCH_BYTES + 1), "d"])
    assert [x for a, b in features.groups(texts_.slice(1)) for x in range(a, b)] == [0, 1, 2, 3]


def test_ids_of_a_large_vocabulary(spark, tmp_path):
    """Token ids beyond 16 bits come back whole."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    from cadenza.llm import packing

    made = Tokenizer(models.WordLevel({f"w{k}": k for k in range(70_001)}, unk_token="w0"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(str(tmp_path / "many.json"))
    df = spark.createDataFrame([(1, "w69000 w3 w65536 w70000")], "doc_id long, text string")
    pieces = packing.pack(df, tokenizer_path=str(tmp_path / "many.json"), with_ids=True).orderBy("start").collect()
    assert [x for p in pieces for x in p["ids"]] == [69000, 3, 65536, 70000, 2]


def test_repeated_ids_are_taken_to_the_target(spark):
    """A hundred rows of one id are taken as often as the schedule says, not each as the one taken most."""
    from cadenza.llm import mixing

    rows = [(7, f"{k} " + "x " * 9, "a") for k in range(100)] + [(k, "y " * 10, "b") for k in range(1000, 1020)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = sum(len(r.text.split()) for r in mixing.take(df).where("source = 'a'").collect())
    want = mixing.schedule(df).where("doc_id = 7").selectExpr("sum(taken) as n", "first(target) as t").first()
    assert words == want.n == int(want.t)


def test_gzip_members(monkeypatch):
    import gzip
    import zlib

    from cadenza.llm import warc

    packed = [("Content-Encoding", "gzip")]
    assert warc.unpacked(packed, gzip.compress(b"one ") + gzip.compress(b"two")) == b"one two"
    assert warc.unpacked(packed, gzip.compress(b"one ") + b"junk") == b"one "
    cut = gzip.compress(b"one two three")[:-9]
    assert warc.unpacked(packed, cut) == cut
    assert warc.unpacked([("Content-Encoding", "deflate")], zlib.compress(b"abc")) == b"abc"
    monkeypatch.setattr(warc, "MOST_UNPACKED", 1000)
    bomb = gzip.compress(b"0" * 600) + gzip.compress(b"0" * 600)
    assert warc.unpacked(packed, bomb) == bomb
    assert warc.unpacked(packed, gzip.compress(b"0" * 1000)) == b"0" * 1000


def test_join_of_null_and_string_ids(spark):
    """Rows without an id are told apart by numbers; ids keep their type."""
    from cadenza.llm import ngram_join

    text = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    near = text[0] + " tail"
    rows = [(None, t) for t in text for _ in range(3)] + [("b", near), ("c", text[5]), ("a", ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id or "", r.n_shingles, r.component_id or "") for r in ngram_join.similar(df).collect())
    assert got == sorted([("", 36, "b")] * 3 + [("", 36, "")] * 12 + [("", 36, "c")] * 3 + [("b", 37, "b"), ("c", 36, "c"), ("a", 0, "a"), ("", 0, "")])
    small = spark.createDataFrame([(-(2**63), text[0]), (None, near), (5, text[1])], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join.similar(small).collect()) == [(-(2**63), -(2**63)), (0, -(2**63)), (5, 5)]


def test_too_deep_strings_are_refused(spark):
    import pytest

    from cadenza.llm import suffix_dedup

    df = spark.createDataFrame([(1, "x" * 500)], "doc_id long, text string")
    with pytest.raises(ValueError):
        suffix_dedup.removals(df, depth=400)

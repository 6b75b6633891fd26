"""Tokens, packing, mixing, table files, media, pages, and the pipeline."""

import hashlib
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from pactum.llm import html_text, jpeg, media, mixing, packing, sstable
from pactum.llm.html_blocks import Block, leaf_blocks
from pactum.llm.tokens import WordEncoder, default_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, group string, length int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "g", 1, "k") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(default_vocabulary(), cache_words=50)


@pytest.mark.parametrize("text", ["", None, "Hello, World! it's THEY'RE 12ab", "İstanbul ΣΑΣ ß", "<|endoftext|> a<|startoftext|>b", "a\x1cb\x85c d", "éàü É, «x» µ", "é x", "'' 's S'", "a_b __ -- \U0001f600 ok"])
def test_encoder_equals_library(encoder, text):
    want = Tokenizer.from_file(default_vocabulary()).encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_encoder_cache_turns_over(encoder):
    library = Tokenizer.from_file(default_vocabulary())
    rng = random.Random(0)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ",", "."]) for _ in range(60))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def best_fit_decreasing(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= s]
        k = min(fits, key=lambda k: free[k]) if fits else len(free)
        if not fits:
            free.append(capacity)
        free[k] -= s
    return Counter(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 30, 50, 64, rng.randrange(1, 65)]) for _ in range(rng.randrange(0, 300))]
    plan = packing.plan_packing(Counter(sizes), 64)
    used, bins = {}, Counter()
    for size, segments in plan.items():
        assert sum(x.pieces for x in segments) == Counter(sizes)[size]
        for x in segments:
            for k in range(x.pieces):
                b, place = divmod(k, x.per_bin)
                start = x.offset + place * size
                used.setdefault(x.bin + b, []).append((start, size))
    for held in used.values():
        at = 0
        for start, size in sorted(held):
            assert start == at
            at += size
        assert at <= 64
        bins[64 - at] += 1
    assert bins == best_fit_decreasing(sizes, 64)


def test_capacity_tree():
    tree = packing.CapacityTree(64)
    for f in (3, 17, 64):
        tree.add(f, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 17, 18, 64)] == [3, 3, 17, 17, 64, 64]
    tree.add(64, -1)
    assert tree.tightest(18) is None


def test_pack_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(0, 90))), "a") for i in range(60)] + [(70, None, None), (71, "", "a"), (72, "word " * 700, "a"), (72, "word " * 700, "a")]
    out = packing.pack_documents(frame(spark, rows), capacity=128).toPandas()
    encoder = WordEncoder(default_vocabulary())
    ids = {i: encoder.encode(t) + b"\1\0\0\0" for i, t, _ in rows}
    assert len(out) == sum(-(-(len(ids[i]) // 4) // 128) for i, *_ in rows)
    for r in out.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.start == 128 * r.piece
    for _, x in out.sort_values("offset").groupby("sequence_id"):
        assert (x.length.cumsum() - x.length == x.offset).all() and x.length.sum() <= 128
    assert out.sequence_id.nunique() == sum(best_fit_decreasing(out.length.tolist(), 128).values())
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [3, 1, 2], 45) == [20.0, 25 / 3, 50 / 3]
    assert mixing.water_fill([5], [3], 7.5) == [7.5]
    assert mixing.water_fill([0, 4], [3, 1], 6) == [0.0, 6.0]
    assert sum(mixing.water_fill([1, 100, 7, 30], [3, 1, 2, 3], 207)) == pytest.approx(207)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)
    rng = random.Random(2)
    rows = [(i, " ".join("w" * (k + 1) for k in range(rng.randrange(0, 30))), rng.choice(["a", "b", "b", "b", "", None])) for i in range(200)] + [(500, None, "c"), (501, "x", "a"), (501, "x", "a")]
    first = mixing.mix(frame(spark, rows)).toPandas()
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert first[order].sort_values(order).values.tolist() == again[order].sort_values(order).values.tolist()
    assert (first.taken <= 2 * first["size"]).all() and len(first) == len(rows)
    by = first.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 0.5).all() and by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    assert (by.target <= 2 * by["size"]).all()
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixed_documents_have_the_words_taken(spark):
    rows = [(i, f"  d{i} " + "\tword" * (i % 13), "a" if i % 3 else "b") for i in range(80)]
    docs = frame(spark, rows)
    want = {r["source"]: r["t"] for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert dict(got) == want


def test_shards_round_trip_and_lookup():
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-(1 << 40), 1 << 40), 500)) + []
    entries = [(None, struct.pack("<I", 9))] + [(i, struct.pack(f"<{n}I", *[rng.randrange(1 << 17) for _ in range(n)])) for i in ids for n in [rng.randrange(0, 60)]]
    data = sstable.build_shard(entries, block_bytes=700)
    reader = sstable.ShardReader(data)
    assert list(reader) == entries and len(reader.index) > 5
    assert all(reader.lookup(i) == [v] for i, v in entries)
    missing = [i for i in range(2000) if i not in ids]
    assert all(reader.lookup(i) == [] for i in missing)
    assert sum(reader.may_hold(i) for i in missing) < 0.05 * len(missing)
    assert sstable.ShardReader(sstable.build_shard([])).entries == 0
    twice = sstable.ShardReader(sstable.build_shard([(1, b"\0" * 4)] * 40, block_bytes=8))
    assert len(twice.lookup(1)) == 40
    with pytest.raises(ValueError):
        sstable.ShardReader(data[:-1])


def test_token_tables(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_TEXT_BYTES", 500)
    rows = [(i * 7 % 101, f"text {i} " * (i % 9), "a") for i in range(101)] + [(200, None, None), (201, "", "a")]
    got = sstable.token_tables(frame(spark, rows)).orderBy("doc_id").collect()
    encoder, start = WordEncoder(default_vocabulary()), 0
    for r, (i, t, _) in zip(got, sorted(rows), strict=True):
        ids = encoder.encode(t) + struct.pack("<I", 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert sstable.token_tables(frame(spark, [])).count() == 0


def test_media_round_trip(spark):
    rows = [(1, "héllo", "a"), (2, None, None), (3, "", "a"), (4, bytes(range(1, 128)).decode() * 40, "a"), (5, "ÿ" * 110_000, "a"), (5, "ÿ" * 110_000, "a")]
    got = {r["doc_id"]: r for r in media.text_media(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        payload = media.payload_of(t)
        r = got[i]
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["n_bytes"] == len((t or "").encode()) and len(payload) % 576 == 0
    assert got[2]["media_sha256"] == got[3]["media_sha256"] and got[1]["feature"] != got[4]["feature"]


def colour_image(blocks_y, blocks_cb, blocks_cr, wide, high, restart):
    """A 4:2:0 baseline image with one AC coefficient per luminance block: (DC, AC) quantised values in scan order."""
    codes = jpeg.huffman_codes(jpeg.DC_LENGTHS, jpeg.DC_SYMBOLS)
    lengths, symbols = (0, 2, 1) + (0,) * 13, (0x00, 0x12, 0xF0)  # end, run 1 of size 2, sixteen zeros
    ac = jpeg.huffman_codes(lengths, symbols)
    out, bits, previous, marker = bytearray(), "", [0, 0, 0], 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            b = int(bits[k : k + 8], 2)
            out.append(b)
            if b == 255:
                out.append(0)
        bits = ""

    def value(v):
        n = abs(v).bit_length()
        return format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def block(component, dc, with_ac):
        nonlocal bits
        d = dc - previous[component]
        previous[component] = dc
        code, n = codes[abs(d).bit_length()]
        bits += format(code, f"0{n}b") + value(d)
        if with_ac:
            for s in (0xF0, 0x12):
                bits += format(ac[s][0], f"0{ac[s][1]}b")
            bits += value(-3)
        bits += format(ac[0][0], f"0{ac[0][1]}b")

    mcus = len(blocks_cb)
    for m in range(mcus):
        if restart and m and m % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + marker % 8])
            marker, previous[:] = marker + 1, [0, 0, 0]
        for k in range(4):
            block(0, blocks_y[4 * m + k], True)
        block(1, blocks_cb[m], False)
        block(2, blocks_cr[m], False)
    flush()
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([4] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, high, wide, 3) + b"\1\x22\0\2\x11\0\3\x11\0")
    head += seg(0xC4, b"\0" + bytes(jpeg.DC_LENGTHS) + bytes(jpeg.DC_SYMBOLS)) + seg(0xC4, b"\x10" + bytes(lengths) + bytes(symbols))
    head += (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xFE, b"a comment") + seg(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0")
    return head + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_decoder_reads_colour_images(restart):
    rng = random.Random(4)
    wide, high = 40, 24  # 3 by 2 MCUs, cropped
    y = [rng.randrange(-200, 200) for _ in range(24)]
    data = colour_image(y, [rng.randrange(-90, 90) for _ in range(6)], [rng.randrange(-90, 90) for _ in range(6)], wide, high, restart)
    (thumb,) = jpeg.decode_luminance(jpeg.parse_all(data))
    grid = np.zeros((4, 6), int)
    for m in range(6):
        for k in range(4):
            grid[2 * (m // 3) + k // 2, 2 * (m % 3) + k % 2] = y[4 * m + k]
    assert (thumb == np.clip(np.floor(grid[:3, :5] * 4 / 8 + 0.5) + 128, 0, 255)).all()


def test_damaged_media_are_reported():
    good = jpeg.encode_payloads([media.payload_of("abc" * 500)])[0]
    rows = media._read([None, b"", b"GIF89a", good[:200], good[:-30] + b"\xff\xd9", good, good + good, good + b"\0\0trailer"])
    assert [r[9] is None for r in rows] == [True, False, False, False, False, True, True, True]
    assert rows[0][6] is None and rows[6][2] == 2
    assert rows[7][3:6] == rows[5][3:6] and rows[7][6] == rows[5][6] + 9  # what follows the image is ignored


@pytest.mark.parametrize("scan", [b"\x55" * 1900, b"\x00\x11" * 40_000, b"\xfe" * 900_000])
def test_claimed_dimensions_do_not_cost(scan):
    """A header that claims 12800 x 12800 pixels over a short or damaged scan without restarts."""
    head = jpeg.header(1600, 1600).replace(b"\xff\xdd\x00\x04\x00" + bytes([jpeg.INTERVAL]), b"")
    began = time.time()
    (row,) = media._read([head + scan + b"\xff\xd9"])
    assert row[0] is None and row[9] and time.time() - began < 5


def test_media_columns_that_clash(spark):
    media_of = jpeg.encode_payloads([media.payload_of("abc")])[0]
    df = spark.createDataFrame([(1, media_of, "mine", 5)], "doc_id long, media binary, feature string, width int")
    got = media.describe_media(df).first()
    assert (got["feature"], got["width"], got["media_width"]) == ("mine", 5, 8 * jpeg.INTERVAL) and got["media_feature"]
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy   this now.</div>
<article><h1>A &amp; B</h1><p>One<br>two&nbsp;
three.</p><p><b>Four.<p>Five &lt; six.</article><div class="comments"><p>Nice text.</p></div><footer>&copy; site</footer></body></html>"""


def test_leaf_blocks():
    assert [b.text for b in leaf_blocks(PAGE)] == ["Home", "News", "Buy this now.", "A & B", "One two three.", "Four.", "Five < six.", "Nice text.", "© site"]
    assert leaf_blocks(None) == [] and leaf_blocks("") == [] and leaf_blocks("<p") == []
    assert [b.text for b in leaf_blocks("plain < text")] == ["plain < text"]
    assert leaf_blocks(PAGE)[0].link_share == 1.0 and leaf_blocks(PAGE)[4].path[-1] == "p"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><body><p>One.</p><p>Two.</p>", ["One.", "Two."]),
        ("<head><meta charset=utf-8><p>One.<p>Two.", ["One.", "Two."]),
        ("<head>gone<noscript><p>gone</p></noscript></head><p>One.", ["One."]),
        ("<p>One <svg/>two.</p><p>Three <svg viewBox='0 0 1 1' />four.</p>", ["One two.", "Three four."]),
        ("<p>One <svg><title/><path d='M0'/><text>gone</text></svg>two.</p><p>Three.", ["One two.", "Three."]),
        ("<p>One <video-player>two</video-player> three.</p><p>Four.", ["One two three.", "Four."]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", ["Let x=2 be."]),
        ("<p>One.</p><math/><p>Two.</p>", ["One.", "Two."]),
        ("<p>One.</p><video src=a><p>Two.</p><object>gone</object><p>Three.", ["One.", "Two.", "Three."]),
        ("<p>One.</p><object>gone<object>gone</object>gone</object><p>Two.", ["One.", "Two."]),
        ("<p>One.</p><script src=\"a>var x = '<p>gone';</script ><p>Two.</p><style>p {}", ["One.", "Two."]),
        ("<p>One.</p><SCRIPT>gone</SCRIPT><svg><g>gone</g></svg><template><p>gone</p></template><iframe>gone", ["One."]),
    ],
)
def test_silent_elements_end(page, want):
    assert [b.text for b in leaf_blocks(page)] == want


@pytest.fixture(scope="module")
def labeller():
    return html_text.fit()


def test_labeller_on_unseen_pages(labeller):
    pages = html_text.composed_pages(120, seed=99)
    found = labeller.label([b for b, _ in pages])
    assert np.mean(np.concatenate([a == y for a, (_, y) in zip(found, pages, strict=True)])) > 0.97


def test_features_hold_every_word():
    """Blocks that differ after their 64th word only have different bags, and each bag is that of all words."""
    starts = "the article goes on " * 16
    blocks = [Block(starts + tail, ("p",), 0.0) for tail in ("advert now " * 40 + "end.", "winter sea " * 40 + "end.")]
    bags = html_text.block_features(blocks)[:, 1 << html_text.PATH_BITS : -html_text.MEASURES]
    assert not np.allclose(bags[0], bags[1])
    for block, bag in zip(blocks, bags, strict=True):
        want = np.zeros(1 << html_text.WORD_BITS)
        for w in block.text.split():
            want[html_text._slot(w, html_text.WORD_BITS)] += 1
        assert np.allclose(bag, want / np.sqrt(len(block.text.split())), atol=1e-4)


def test_gradients_match_differences():
    model = html_text.Labeller.fresh()
    rng = np.random.default_rng(0)
    x = (rng.random((2, 4, html_text.WIDTH)) < 0.05).astype(np.float32)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = np.array([[1, 0, 1, 0], [0, 1, 0, 0]], np.float32)

    def loss():
        p = np.clip(model.probabilities(x, mask).astype(np.float64), 1e-9, 1 - 1e-9)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for name in ("hf", "hb", "cf", "out"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        held = model.weights[name][at]
        model.weights[name][at] = held + 1e-2
        up = loss()
        model.weights[name][at] = held - 1e-2
        down = loss()
        model.weights[name][at] = held
        assert (up - down) / 2e-2 == pytest.approx(grads[name][at], rel=0.1, abs=1e-4)


def test_extract(spark, labeller):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, labeller).collect()
    assert {r["page_id"]: r["text"] for r in got} == {1: "A & B\n\nOne two three.\n\nFour.\n\nFive < six.", 2: "", 3: ""}
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == 4


def test_pipeline(spark):
    import corpus_pipeline
    from pactum.llm.common import materialize

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test")
        frames[name] = docs.toPandas()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(list(frames[n].columns) == columns for n in names[:-1])
    near = frames["near-duplicate removal"]
    assert near.doc_id.is_unique and len(near) < len(frames["quality classifier"]) <= 200
    cut = frames["repeated-string removal"]
    assert set(cut.doc_id) <= set(near.doc_id) and (cut.text.str.len() == cut.n_chars).all()
    mixed, packed = frames["source mixing"], frames["sequence packing"]
    taken, base = mixed.text.map(lambda t: len(t.split())).sum(), cut.text.map(lambda t: len(t.split())).sum()
    assert abs(taken - 1.5 * base) <= 20
    assert packed.groupby(["sequence_id"]).length.sum().max() <= 4096
    encoder = WordEncoder(default_vocabulary())
    assert packed.length.sum() == sum(len(encoder.encode(t)) // 4 + 1 for t in mixed.text)

"""Models and operators against plain loops, and what must hold at other sizes."""

import math
import random
import re
import resource
import struct
import subprocess
import sys

import numpy as np
import pytest
import xxhash
from test_text_operators import DOCS, corpus, frame, linked_by_force, prose, repeats_by_force

from pactum.llm import common, components, html_text, language, mixing, neardup, quality_knn, quality_rules, sstable, suffix_dedup
from pactum.llm.html_blocks import leaf_blocks
from pactum.llm.ngrams import sparse_rows

# ------------------------------------------------------------------ models


def naive_ftrl(rows, y, classes, width, epochs, alpha, beta, l1, l2, batch):
    """One coordinate at a time, from dictionaries."""
    z = [[0.0] * classes for _ in range(width + 1)]
    n = [[0.0] * classes for _ in range(width + 1)]
    w = [[0.0] * classes for _ in range(width + 1)]
    rows = [{**r, width: 1.0} for r in rows]
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(rows)).tolist()
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            gradient: dict = {}
            for k in some:
                logits = [sum(v * w[f][c] for f, v in rows[k].items()) for c in range(classes)]
                e = [math.exp(x - max(logits)) for x in logits]
                for c in range(classes):
                    err = e[c] / sum(e) - (y[k] == c)
                    for f, v in rows[k].items():
                        gradient[f, c] = gradient.get((f, c), 0.0) + v * err / len(some)
            for (f, c), g in gradient.items():
                sigma = (math.sqrt(n[f][c] + g * g) - math.sqrt(n[f][c])) / alpha
                z[f][c] += g - sigma * w[f][c]
                n[f][c] += g * g
                sign = math.copysign(1, z[f][c])
                w[f][c] = 0.0 if abs(z[f][c]) <= l1 else -(z[f][c] - sign * l1) / ((beta + math.sqrt(n[f][c])) / alpha + l2)
    return np.array(w)


def test_ftrl_equals_plain_loops():
    rng = random.Random(4)
    rows = [{rng.randrange(12): rng.random() for _ in range(4)} for _ in range(40)]
    y = np.array([rng.randrange(3) for _ in rows])
    dense = np.zeros((40, 12), np.float32)
    for k, r in enumerate(rows):
        for f, v in r.items():
            dense[k, f] = v
    got = language.train_ftrl(dense, y, 3, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.01, batch=7)
    want = naive_ftrl([{f: float(np.float32(v)) for f, v in r.items()} for r in rows], y.tolist(), 3, 12, 3, 0.5, 1.0, 0.02, 0.01, 7)
    assert np.allclose(got, want, atol=1e-9) and (got == 0).any()


def test_tf_idf_and_sparse_scores_equal_plain_loops():
    texts = ["Ab ab!", "zz top", "", "aaaaaaa b"]
    counts = [language.features(t) for t in texts]
    rng = np.random.default_rng(3)
    idf = rng.random(1 << language.BITS) + 1
    w = rng.standard_normal((1 << language.BITS, 3)) * (rng.random((1 << language.BITS, 1)) < 0.5)
    model = language.LanguageModel.of(("a", "b", "c"), idf, np.concatenate([w, [[0.1, 0.2, 0.3]]]), 0.7)
    assert len(model.weights) < 0.6 * len(w)  # zeros are not stored
    got = model.scores(sparse_rows(counts))
    for k, c in enumerate(counts):
        x = {f: math.log(1 + int(n)) * idf[f] for f, n in enumerate(c) if n}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * w[f][j] for f, v in x.items()) + (0.1, 0.2, 0.3)[j]) / 0.7 for j in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        assert np.allclose(got[k], [v / sum(e) for v in e], atol=1e-5)


def test_a_rare_language_is_learnt(spark):
    """Five rows in 20,000, of which the fit takes 500."""
    rng = random.Random(9)
    syllables = {"en": "the an er on re".split(), "de": "ung ver sch ein ö".split(), "xx": "zyk wqo jjü".split()}
    rare = set(range(1, 20_000, 4_000))
    rows = [(i, " ".join("".join(rng.choice(syllables[g]) for _ in range(3)) for _ in range(6)), g, "a") for i in range(20_000) for g in ["xx" if i in rare else rng.choice(["en", "de"])]]
    docs = frame(spark, rows)
    model = language.fit(docs, 500)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs.where(f"doc_id in ({','.join(map(str, rare))})"), model).collect()}
    assert "xx" in model.classes and set(got.values()) == {"xx"}


def test_forest_paths_equal_a_walk():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.standard_normal((300, 4)), [[9, 9, 9, 9]]])
    forest = quality_rules.grow(x, trees=20, subset=64)
    got = forest.scores(x)
    for k in range(0, len(x), 25):
        lengths = []
        for root in forest.roots.tolist():
            node = root
            while forest.feature[node] >= 0:
                node = forest.left[node] + (1 if x[k, forest.feature[node]] >= forest.split[node] else 0)
            lengths.append(forest.path[node])
        assert got[k] == pytest.approx(2 ** -(sum(lengths) / len(lengths) / quality_rules.average_path(64)))
    assert got.argmax() == 300


def test_threshold_is_the_best_of_all():
    rng = np.random.default_rng(5)
    good, bad = rng.integers(0, 9, quality_rules.BINS), rng.integers(0, 9, quality_rules.BINS)
    cut = quality_rules.best_threshold(good, bad)
    rate = lambda t: good[:t].sum() / good.sum() + bad[t:].sum() / bad.sum()
    assert rate(round(cut * quality_rules.BINS)) == pytest.approx(max(rate(t) for t in range(1, quality_rules.BINS + 1)))


def test_labeller_equals_plain_loops():
    model = html_text.Labeller.fresh(3)
    model.weights["bias"][0] = 0.2
    pages = [[b for b in leaf_blocks(html_text._Composer(k).page())][:7] for k in (1, 2)]
    h = html_text.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    x, mask = html_text.padded([html_text.block_rows(p) for p in pages])
    got = model.probabilities(x, mask)
    for n, page in enumerate(pages):
        dense = html_text.block_features(page).astype(float)
        states = {}
        for d in "fb":
            w, u, bias = (model.weights[f"{k}{d}"].astype(float) for k in "xhc")
            s, c, out = [0.0] * h, [0.0] * h, {}
            for t in range(len(page)) if d == "f" else range(len(page) - 1, -1, -1):
                g = [sum(dense[t, i] * w[i, j] for i in np.flatnonzero(dense[t])) + bias[j] + sum(s[i] * u[i, j] for i in range(h)) for j in range(4 * h)]
                c = [sigmoid(g[h + j]) * c[j] + sigmoid(g[j]) * math.tanh(g[3 * h + j]) for j in range(h)]
                s = [sigmoid(g[2 * h + j]) * math.tanh(c[j]) for j in range(h)]
                out[t] = s
            states[d] = out
        o = model.weights["out"].astype(float)
        for t in range(len(page)):
            v = sum(states["f"][t][j] * o[j] + states["b"][t][j] * o[h + j] for j in range(h)) + float(dense[t] @ o[2 * h :]) + 0.2
            assert got[n, t] == pytest.approx(sigmoid(v), abs=1e-4)


def test_labels_without_sectioning_elements():
    """Pages whose every element is a div, with names; none of them is fitted to."""
    model = html_text.fit()
    right = total = 0
    for seed in range(500, 560):
        page = re.sub(r"<(/?)(article|main|nav|aside|footer|header|section|dialog)\b", r"<\1div", html_text._Composer(seed).page())
        blocks = leaf_blocks(page)
        y = np.array([b.text.startswith("\x02") for b in blocks])
        plain = [b._replace(text=" ".join(b.text.replace("\x02", "").split()) or "-") for b in blocks]
        right += int((model.label([plain])[0] == y).sum())
        total += len(y)
    assert right / total > 0.85


LONG_PAGE = """
import resource
from pactum.llm import html_text
model = html_text.Labeller.fresh()
page = "<article>" + "<p>a</p>" * 300_000 + "</article>"
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
(text,) = html_text.main_text(model, [page])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) // 1024, before // 1024)
"""


def test_a_page_of_300000_blocks_fits_in_a_worker():
    done = subprocess.run([sys.executable, "-c", LONG_PAGE], capture_output=True, text=True, check=True)
    peak = int(done.stdout.split()[0])
    assert peak < 1000, f"{peak} MB"
    assert resource.RLIMIT_AS  # the figure is that of the whole process


def test_references_are_decoded_piece_by_piece():
    assert [b.text for b in leaf_blocks("<p>a &amp; b &am<i></i>p; &<b>lt;</b> &#65;</p>")] == ["a & b &amp; &lt; A"]


def test_votes_of_repeated_ids_are_defined(spark):
    rows = [(1, "b b b b", "en", "a"), (1, "a a a a", "en", "a"), (2, "c d e f", "en", "a"), (3, "g h i j k", "en", "a")]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    one = quality_knn.fit(frame(spark, rows), labels)
    two = quality_knn.fit(frame(spark, rows[::-1]), labels)
    assert (one.vectors == two.vectors).all() and (one.labels == two.labels).all() and len(one.labels) <= 3


# ------------------------------------------------------------------ mixing


def spark_hash(doc_id, text, seed):
    h = 42
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=h)
    if text is not None:
        h = xxhash.xxh64_intdigest(text.encode(), seed=h)
    return xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=h)


def taken_by_force(rows):
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = [mixing.WEIGHTS[k % 3] for k in range(len(names))]
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:  # one source at a time is closed, in contrast to the operator
        left, total = budget - sum(fixed.values()), sum(w for s, w in zip(names, weights, strict=True) if s not in fixed and sizes[s])
        over = [s for s, w in zip(names, weights, strict=True) if s not in fixed and sizes[s] and left * w / total > 2 * sizes[s] + 1e-9]
        if not over:
            break
        fixed[over[0]] = 2.0 * sizes[over[0]]
    target = {s: fixed.get(s, left * w / total if sizes[s] else 0.0) for s, w in zip(names, weights, strict=True)}
    out = []
    for s in names:
        mine = sorted((spark_hash(i, t, mixing.SEED), i is not None, i or 0, t or "") for i, t, g in rows if g == s)
        room = math.floor(target[s] + 0.5)
        taken = [0] * len(mine)
        while room > 0 and sizes[s]:
            for k, (*_, text) in enumerate(mine):
                n = min(room, len(text.encode().split()))
                taken[k] += n
                room -= n
        out += [(m[2] if m[1] else None, m[3], n) for m, n in zip(mine, taken, strict=True)]
    return sorted(out, key=str)


def test_words_taken_of_each_document_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 5)
    rng = random.Random(8)
    rows = [(i if i % 9 else None, " ".join("w" * (1 + k % 3) for k in range(rng.randrange(0, 25))) + f" {i}", rng.choice(["a", "b", "b", "b", "", "é", None])) for i in range(120)]
    rows += [(7000, None, "a"), (7001, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, carry=True).select("doc_id", "row.text", "taken").collect()
    assert sorted(((r["doc_id"], r["text"] or "", r["taken"]) for r in mixed), key=str) == taken_by_force(rows)


def test_rows_without_ids_spread_over_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    docs = spark.createDataFrame([(None, f"word {k}", "a") for k in range(400)], "doc_id long, text string, source string")
    keys = docs.selectExpr(f"xxhash64(doc_id, text, {mixing.SEED}) as k").distinct().count()
    assert keys == 400 and mixing.mix(docs).selectExpr("sum(taken)").first()[0] == round(1.5 * 800)


# ------------------------------------------------------------------ names, nulls, empty tables

CLASHING = "kept cut_id gone_id rejected_id size taken target source_size epochs copy row key tie group cell through before_cell shard batch sent pieces codes crc n_bytes n_removed component component_id bucket band block blocks packed id a b ka kb rep k1 k2 n_shingles sketch held_out score predicted label labelled own_id anomaly base_failed model features counts".split()


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with further columns of every name that the operators use themselves."""
    rows = [r for r in corpus(21, 24) if r[0] is not None and len(r[1] or "") < 5000]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[f"{c} {r[0]}" for c in CLASHING]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.mark.parametrize("stage", ["quality", "near", "repeats", "mix"])
def test_clashing_names_are_carried(spark, crowded, stage):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    stages = {
        "quality": lambda d: quality_knn.drop_low_quality(d, labels), "near": neardup.drop_near_duplicates,
        "repeats": suffix_dedup.remove_repeats, "mix": mixing.mix_documents,
    }
    out = stages[stage](crowded)
    assert out.columns == crowded.columns
    got = out.collect()
    assert got and all(r[c] == f"{c} {r['doc_id']}" for r in got for c in CLASHING)
    assert stages[stage](crowded.limit(0)).count() == 0


def test_null_ids_and_repeated_ids_in_the_stages(spark):
    long_text = prose(random.Random(3), 60)
    rows = [(None, long_text, "en", "a"), (None, "n", "en", "a"), (4, long_text, "en", "a"), (4, "other", "en", "a"), (9, long_text, "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted([(-1, long_text), (-1, "n"), (4, long_text), (4, "other")])  # of 9 nothing is left
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in neardup.drop_near_duplicates(docs).collect())
    assert (9, long_text) not in kept and (4, long_text) in kept and (4, "other") in kept
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_rows_of_one_id_keep_an_order_in_shards(spark):
    texts = ["b two", "a one", "c three", None]
    make = lambda some: spark.createDataFrame([(5, t) for t in some] + [(None, "x"), (6, "y")], "doc_id long, text string")
    read = lambda some: sorted(map(tuple, sstable.token_tables(make(some)).collect()), key=str)
    assert read(texts) == read(texts[::-1]) and len(read(texts)) == 6


def test_a_task_writes_several_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sstable, "MAX_TASKS", 2)
    docs = spark.createDataFrame([(k, f"text number {k} " * 20) for k in range(60)], "doc_id long, text string")
    written = sstable.write_shards(docs, f"file://{tmp_path}/t", shard_text_bytes=1000).collect()
    assert len({r["shard"] >> 32 for r in written}) <= 2 < len(written)
    got = {r["doc_id"]: r for r in sstable.read_shards(spark, f"file://{tmp_path}/t").collect()}
    start = 0
    for k in range(60):
        assert got[k]["start"] == start
        start += got[k]["n_tokens"]


# ------------------------------------------------------------------ scale


def test_shards_of_the_suffix_family_are_even():
    rng = random.Random(1)
    text = " ".join(prose(rng, 1) + str(rng.randrange(10**6)) for _ in range(60_000)).encode()
    batch = suffix_dedup.Batch(np.arange(1), np.ones(1, bool), np.array([len(text)]), np.frombuffer(text, dtype=np.uint8))
    batch.index(64)
    sizes = np.bincount(suffix_dedup.shard_of(batch.keys, 64), minlength=64)
    assert sizes.max() < 2 * sizes.mean() and sizes.min() > 0


def test_suffixes_are_in_the_order_of_their_bytes():
    rng = random.Random(2)
    texts = [prose(rng, 300).encode() for _ in range(5)]
    data = b"".join(texts)
    batch = suffix_dedup.Batch(np.arange(5), np.ones(5, bool), np.array([len(t) for t in texts]), np.frombuffer(data, dtype=np.uint8))
    batch.index(1)
    held = [b"".join(int(w).to_bytes(8, "big") for w in row) for row in zip(*batch.keys[:2], strict=True)]
    assert held == sorted(held) and all(h in data for h in held[::17])


def test_a_batch_sends_a_bounded_number_of_rows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAX_GROUPS", 8)
    shard = np.repeat(np.arange(100), 3)
    keys = [np.arange(300, dtype=np.uint64)] * 2
    (rows,) = suffix_dedup._entries_by_shard(7, shard, 100, suffix_dedup.WINDOWS, keys, np.arange(300))
    assert rows.num_rows == 8 and [p["shard"] for r in rows.column(2).to_pylist() for p in r] == list(range(100))


def family_rows(n, seed=5):
    """Near copies of one text, each with a word of its own: any two share nine tenths."""
    rng = random.Random(seed)
    base = prose(rng, 200).split()
    rows = []
    for i in range(n):
        words = list(base)
        words[rng.randrange(len(words))] = f"own{rng.randrange(10**9)}"
        rows.append((i, " ".join(words), "en", "a"))
    return rows


def test_texts_shuffled_for_a_family_are_linear(spark, monkeypatch):
    """Rows that carry a text to a comparison: as many as members, for one family of 1, 2 and 4 times the size."""
    sent = []
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, docs, real=neardup.confirmed: sent.append(pairs.count()) or real(pairs, docs))
    for n in (100, 200, 400):
        rows = family_rows(n)
        got = {r["component_id"] for r in neardup.link_documents(spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")).collect()}
        assert got == {0}
    assert all(s <= 6 * n for s, n in zip(sent, (100, 200, 400), strict=True)) and sent[2] < 6 * sent[0]


def test_families_that_hubs_do_not_connect(spark, monkeypatch):
    """A chain of near copies, each alike only to its neighbours, in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 4)
    rng = random.Random(6)
    words, rows = prose(rng, 150).split(), []
    for i in range(30):
        rows.append((100 - i if i % 2 else i, " ".join(words), "en", "a"))
        for _ in range(2):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link_documents(frame(spark, rows)).collect()}
    assert got == linked_by_force(rows)


@pytest.mark.parametrize("hot", [1, 10**6])
def test_components_of_stars_and_chains(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_DEGREE", hot)
    edges = [(900, k) for k in range(100, 160)] + [(k, k + 1) for k in range(200, 240)] + [(7, 100), (3, 3), (50, 51)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 7 for k in (*range(100, 160), 900, 7)} | {k: 200 for k in range(200, 241)} | {50: 50, 51: 50}


def test_repeats_with_many_windows_in_part(spark):
    """Common phrases in changing surroundings: shared grams that are no shared windows, and some that are."""
    rng = random.Random(7)
    phrases = [prose(rng, 9) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(phrases) if rng.random() < 0.5 else prose(rng, 2) for _ in range(30)), None, None) for i in range(40)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.find_repeats(frame(spark, rows)).collect())
    assert got == repeats_by_force(rows)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    assert DOCS and common.shared_dir(spark)


def test_runs_of_one_sign_and_padding_do_not_fill_a_shard():
    """Rules and padding in every line anchor nothing while there is other text in the window."""
    rng = random.Random(3)
    for filler in ("_" * 16, "_" * 20, "_" * 30, " " * 24, "- " * 14):
        text = "\n".join(prose(rng, 1)[:60] + str(rng.randrange(10**6)) + filler for _ in range(5000)).encode()
        batch = suffix_dedup.Batch(np.arange(1), np.ones(1, bool), np.array([len(text)]), np.frombuffer(text, dtype=np.uint8))
        batch.index(100)
        sizes = np.bincount(suffix_dedup.shard_of(batch.keys, 100), minlength=100)
        assert sizes.max() < 3 * sizes.mean(), filler


def test_spans_are_told_apart_by_88_bits():
    assert sum(suffix_dedup.SUFFIXES.widths[suffix_dedup.GRAM_KEYS :]) == 11 and sum(suffix_dedup.WINDOWS.widths) == 11


def test_order_of_equal_labelled_vectors_does_not_matter():
    from pactum.llm import quality_knn

    rng = np.random.default_rng(4)
    base, x = quality_knn.unit(rng.standard_normal((64, 16)).astype(np.float32)), quality_knn.unit(rng.standard_normal((256, 16)).astype(np.float32))
    vectors, labels = np.repeat(base, 20, axis=0), np.tile(np.array([0, 1, 1, 0], np.float32), 320)
    labels[rng.random(1280) < 0.3] = 1
    scores = quality_knn.vote(x, vectors, labels)
    for _ in range(3):
        order = rng.permutation(1280)
        assert np.abs(quality_knn.vote(x, vectors[order], labels[order]) - scores).max() < 1e-5


MEGABYTE = 1_000_000
ODD_PAGES = [
    "<script " * 125_000 + '"', "a<b " * 250_000 + "'", "<a " * 333_000 + '"', '<a x=">" ' * 100_000 + "'", '<svg a=">" ' * 90_000 + 'b="<"', "<script>" + "</script " * 110_000,
    "<div>x" * 160_000, "<div>" * 100_000 + "</p>x" * 100_000, "<p \"'" * 200_000, "<a href='\"" * 100_000, "<" * MEGABYTE, "<!--" * 250_000, "<head>" * 160_000, "<li>x" * 160_000,
]


@pytest.mark.parametrize("page", ODD_PAGES, ids=[p[:12] for p in ODD_PAGES])
def test_odd_pages_take_time_in_proportion(page):
    import time

    from pactum.llm.html_blocks import leaf_blocks

    start = time.process_time()
    leaf_blocks(page)
    assert time.process_time() - start < 8


def test_paths_of_deep_pages_share_their_names():
    from pactum.llm.html_blocks import leaf_blocks

    blocks = leaf_blocks("".join(f'<div class="{c}">x' for c in "abcdefgh" * 5000))
    assert len(blocks) == 40_000 and len({id(b.path.slots) for b in blocks}) <= 9
    assert blocks[-1].path.last == "h" and blocks[0].path.last == "a" and len(blocks[-1].path.slots) == 9


def test_tags_in_quotes_and_missing_ends():
    from pactum.llm.html_blocks import leaf_blocks

    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts('<p title="a > b">one</p><p>two') == ["one", "two"]
    assert texts("<p title='it>one</p><p>two</p>") == ["one", "two"]  # a quote without its pair is a character
    assert texts("<p>one</p><p class=") == ["one"] and texts("<script>x</script ") == [] and texts("<div>a</section>b</div>c") == ["a", "b", "c"]
    assert texts('<svg a="<"><p>in</p></svg><p>out</p>') == ["out"]
    assert leaf_blocks(None) == [] and leaf_blocks("") == []


def test_results_of_the_pipeline_live_side_by_side(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = pipeline.pack(spark, docs, "/root/testdata/sf0.001")
    thinned = pipeline.keep_one_of_near_duplicates(spark, docs, "/root/testdata/sf0.001")
    again = pipeline.pack(spark, docs, "/root/testdata/sf0.001")
    assert packed.count() == again.count() and 0 < thinned.count() <= docs.count()


def test_shard_paths_get_the_file_system_of_the_cluster(spark):
    from pactum.llm.common import qualified

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert qualified(spark, "/shared/ckpt") == "file:///shared/ckpt" and qualified(spark, "file:///x/y") == "file:///x/y"
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./shared", "file:///tmp")
    try:
        assert qualified(spark, "/shared/ckpt") == "viewfs://store/shared/ckpt"
    finally:
        conf.set("fs.defaultFS", before)
        conf.unset("fs.viewfs.mounttable.store.link./shared")

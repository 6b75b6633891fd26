"""Near duplicates and repeated strings against brute force; rules; classifiers."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pactum.llm import language, neardup, quality_knn, quality_rules, suffix_dedup
from pactum.llm.common import ascii_words
from pactum.llm.ngrams import ngram_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, packed string, shard int, component string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", 7, "y") for i, t, g, s in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("the an er on re in ti es ou at".split()) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows, base = [], [prose(rng, rng.randrange(1, 160)) for _ in range(n // 4)]
    for i in range(n):
        text = rng.choice(base)
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = prose(rng, 1)
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words) + 1), rng.choice(base)[:200])
        rows.append((i, " ".join(words), "en", "a"))
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \n\t ", "en", "a"), (n + 3, "one two", "en", "a"), (n + 4, "ONE  two", "en", "b"), (n + 5, "é" * 3000, "fr", "b"), (n + 6, "é" * 3000, "fr", "b"), (n + 7, prose(rng, 30_000), "en", "b")]
    rng.shuffle(rows)
    return rows


def shingles(text):
    words = (text or "").encode().translate(neardup._LOWER).split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def linked_by_force(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: r for r in neardup.link_documents(frame(spark, rows)).collect()}
    want = linked_by_force(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A family cut into many blocks gives the same components."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 3)
    rows = corpus(3, 40)
    got = {r["doc_id"]: r["component_id"] for r in neardup.link_documents(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in linked_by_force(rows).items()}


def test_near_duplicates_edges(spark):
    assert neardup.link_documents(frame(spark, [])).count() == 0
    rows = [(5, "a b c d e f", None, None), (5, "a b c d e f", None, None), (None, "a b c d e f", None, None), (9, "A B C D E F", None, None)]
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.link_documents(frame(spark, rows)).collect())
    assert got == [(-1, 5, False), (5, 5, True), (5, 5, True), (9, 5, False)]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    a, b = np.unique(np.append(common, own[:100])), np.unique(np.append(common, own[100:]))
    sketch = neardup.odd_sketches(neardup.signatures([a, b]))
    assert abs(neardup.sketch_similarity(sketch[0], sketch[1]) - 900 / 1100) < 0.12


def repeats_by_force(rows):
    """By the definition: 50-byte strings and the smallest document each starts in."""
    rows = [(i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49) if i is not None else ():
            g = b[k : k + 50]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, b in rows:
        covered = bytearray(len(b))
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                covered[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out.append((-1 if i is None else i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_repeats_equal_brute_force(spark, monkeypatch, small):
    if small:  # many batches, shards and passes
        monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 5000)
        monkeypatch.setattr(suffix_dedup, "MAX_GROUPS", 4)
        monkeypatch.setattr(suffix_dedup, "PASS_WINDOWS", 700)
    rows = corpus(4)[:50] + [(None, "n" * 200, None, None), (1000, "ab" * 200, None, None), (1001, "ab" * 90, None, None), (1001, "ab" * 90, None, None)]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.find_repeats(frame(spark, rows)).collect())
    assert got == repeats_by_force(rows)
    assert sum(x[2] for x in got) > 1000


def test_repeats_edges(spark):
    assert suffix_dedup.find_repeats(frame(spark, [])).count() == 0
    rows = [(2, "x" * 60, "en", "a"), (1, "é" * 40, "en", "a"), (3, "é" * 40 + "tail", "en", "a"), (4, None, None, None)]
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert out == {2: "x" * 60, 1: "é" * 40, 3: "tail", 4: None}


def test_index_family_levels_stay_geometric():
    rng = np.random.default_rng(1)
    family, best = suffix_dedup.IndexFamily(2), {}
    for batch in range(33):
        keys = np.unique(rng.integers(0, 500, 64, dtype=np.uint64))
        docs = rng.integers(0, 1000, len(keys))
        family.add(batch, [keys, keys * np.uint64(3)], docs)
        for k, d in zip(keys.tolist(), docs.tolist(), strict=True):
            best[k] = min(best.get(k, d), d)
        assert len(family.levels) <= 12
    anchor, _, doc, *_ = family.finish()
    assert {k: d for k, d in zip(anchor.tolist(), doc.tolist(), strict=True)} == best


def stats_by_force(text):
    words = ascii_words(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    held = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:k] for k, x in enumerate(lines)), len(held)


@pytest.mark.parametrize("text", [None, "", "a", "a b", "a a a a", "x y z x y z q", "é ü #|\nb\n\nb\n \nb \r\x0b", "a b c\na b c\na b c", "one\x1ctwo <three> $%&*"])
def test_base_statistics(text):
    assert quality_rules.base_stats(text)[:5] == stats_by_force(text)


def labelled(seed, n=240):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        text, good = prose(rng, rng.randrange(60, 200)), i % 4 > 0
        if not good:
            text = rng.choice([lambda t: " | ".join(t.split()), lambda t: " ".join(w + "###" for w in t.split()), lambda t: t.upper().replace(" ", "!! ")])(text)
        rows.append((i, text, "en", "a"))
        marks.append((i, int(good), 0))
    return rows, marks


def test_rules_and_forest(spark):
    rows, marks = labelled(5)
    rows += [(900, None, None, None), (901, "short", None, None), (902, "w " * 100, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (900, 901, 902))
    right = np.mean([got[i]["kept"] == bool(q) for i, q, _ in marks if not got[i]["base_failed"]])
    assert right > 0.98
    assert quality_rules.judge(frame(spark, []), labels).count() == 0
    unlabelled = quality_rules.judge(frame(spark, rows), labels.where("doc_id < 0"))
    assert unlabelled.where("not base_failed and not kept").count() == 0


def test_quality_neighbours(spark):
    rows, marks = labelled(6)
    rows += [(900, None, None, None), (901, "", None, None)]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_knn.score(docs, quality_knn.fit(docs, labels)).collect()}
    held = [i for i, *_ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} >= set(held)
    assert np.mean([got[i]["predicted"] == marks[i][1] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = quality_knn.score(docs, quality_knn.fit(docs, labels.where("doc_id < 0"))).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    assert quality_knn.score(docs.limit(0), None).count() == 0


def test_language(spark):
    rng = random.Random(7)
    syllables = {"en": "the an er on re".split(), "de": "ung ver sch ein ö".split(), "fr": "eau que èe les ai".split()}
    rows = [(i, " ".join("".join(rng.choice(syllables[g]) for _ in range(3)) for _ in range(40)), g, "a") for i in range(300) for g in [rng.choice(list(syllables))]]
    rows += [(900, None, "en", None), (901, "123 !!", "en", None), (902, "", None, None)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert np.mean([got[i]["lang_pred"] == g for i, _, g, _ in rows[:300] if got[i]["held_out"]]) > 0.97
    assert all(got[i]["lang_pred"] == "und" for i in (900, 901, 902))
    assert language.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_every_language_is_fitted(spark):
    """A language of 24 rows in 3000 is learnt though the fit takes 200 rows."""
    rng = random.Random(8)
    syllables = {"en": "the an er on re".split(), "de": "ung ver sch ein ö".split(), "xx": "zyk wqo jjü".split()}
    rows = [(i, " ".join("".join(rng.choice(syllables[g]) for _ in range(3)) for _ in range(12)), g, "a") for i in range(3000) for g in ["xx" if i % 125 == 1 else rng.choice(["en", "de"])]]
    docs = frame(spark, rows)
    model = language.fit(docs, 200)
    assert model.classes == ("de", "en", "xx")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert all(got[i] == "xx" for i, _, g, _ in rows if g == "xx")
    assert language.sample_languages(docs, 200).count() <= 200


def test_shares_of_the_fit():
    got = language.shares({"a": 10**9, "b": 10**6, "c": 3, "d": 1}, 4000)
    assert got["c"] == 3 and got["d"] == 1 and got["b"] >= 250 and 3990 < sum(got.values()) <= 4000
    assert language.shares({"a": 5, "b": 2}, 10) == {"a": 5, "b": 2}
    assert language.shares({k: 1 + k for k in range(10)}, 10) == dict.fromkeys(range(10), 1)
    assert not language.set_aside(np.array([0, 1, 0, 0, 0, 1, 1, 1])).any()


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = np.zeros((400, 64), np.float32)
    y = rng.integers(0, 2, 400)
    x[np.arange(400), y] = 1
    x[:, 2:] = rng.random((400, 62)) < 0.02
    w = language.train_ftrl(x, y, 2, l1=0.5)
    assert (w == 0).mean() > 0.5 and ((x @ w[:-1] + w[-1]).argmax(1) == y).mean() > 0.99
    logits = rng.standard_normal((2000, 3))
    drawn = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert 2 < language.fit_temperature(logits * 3, drawn) < 4.5


def test_ngrams_are_of_characters():
    assert ngram_counts("aé", 10, (1,)).sum() == 4 and ngram_counts(None, 10, (3,)).sum() == 0
    assert (ngram_counts("ABC", 10) == ngram_counts("abc", 10)).all()

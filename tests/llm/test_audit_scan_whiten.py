"""Whitening, filter audit and licence scan against plain computations."""

import itertools
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactum.llm import filter_audit, licenses, whitening

# ------------------------------------------------------------------- whitening


def frame(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame(rows, schema)


def whitened(spark, vectors):
    return whitening.whiten(vectors, whitening.fit(vectors)).toPandas()


def by_hand(vectors):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x.astype(object) - s) ** 2).sum(axis=1), centred, e[::-1], v[:, ::-1]


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    values = (rng.standard_normal((500, 12)) * np.geomspace(3, 0.05, 12)).astype(np.float32)
    out = whitened(spark, frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(values)]).repartition(5))
    n, deviations, centred, e, v = by_hand(values)
    assert len(out) == 500 * 8 and set(out["n"]) == {500} and out["identity_error"].max() < 1e-9 and out["identity_error"].nunique() == 1
    for c, rows in out.groupby("component"):
        rows = rows.sort_values("vec_id")
        expected = centred @ v[:, c - 1] / np.sqrt(e[c - 1])
        assert np.abs(np.abs(rows["whitened"]) - np.abs(expected)).max() < 1e-8
        assert abs(np.corrcoef(rows["whitened"], expected)[0, 1]) > 1 - 1e-12
        assert np.allclose(rows["explained"], e[c - 1] / e.sum(), rtol=1e-10)
        assert rows["deviation"].tolist() == deviations.tolist()
        assert np.allclose(rows["deviation_double"], [float(d) for d in deviations])


def test_whitening_of_few_directions_and_equal_deviations(spark):
    """Two directions of equal variance are both found, directions without variance are not returned."""
    rows = [(k, [a, b, 7.0, 7.0], 0) for k, (a, b) in enumerate(itertools.product([-1.0, 1.0], [-1.0, 1.0]))]
    out = whitened(spark, frame(spark, rows))
    assert set(out["component"]) == {1, 2} and np.allclose(out["explained"], 0.5) and len(out) == 8
    assert np.allclose(out.pivot(index="vec_id", columns="component", values="whitened").pow(2).sum(axis=1), 2)
    axes = [(2 * d + s, [float(s * 2 - 1) if j == d else 0.0 for j in range(10)], 0) for d in range(10) for s in range(2)]
    out = whitened(spark, frame(spark, axes))
    assert set(out["component"]) == set(range(1, 9)) and np.allclose(out["explained"], 0.1) and out["identity_error"].max() < 1e-9


def test_whitening_drops_what_it_cannot_use(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    good = [(k, rng.standard_normal(3).tolist(), k) for k in range(20)] + [(None, [0.5, 0.25, 0.125], 1), (3, [1.0, 2.0, 3.0], 1), (3, [1.0, 2.0, 3.0], 1)]
    bad = [(100, None, 1), (101, [None, 1.0, 2.0], 1), (102, [nan, 1.0, 2.0], 1), (103, [1.0, inf, 2.0], 1), (104, [1.0, 2.0], 1), (105, [], 1)]
    vectors = frame(spark, good + bad).withColumn("component", F.lit("clash")).withColumn("n", F.lit(1))
    out = whitened(spark, vectors)
    assert len(out) == 3 * len(good) and not set(out["vec_id"].dropna()) & set(range(100, 106)) and out["vec_id"].isna().sum() == 3
    twice = out[out["vec_id"] == 3].groupby("component")["whitened"].nunique()
    assert set(twice) <= {1, 2}  # the two copies agree
    for rows in ([], bad, [(1, [1.0, 2.0], 0)], [(k, [1.0, 2.0], 0) for k in range(5)]):
        assert whitened(spark, frame(spark, rows)).empty


def test_deviations_next_to_the_limit_of_a_long():
    x = np.array([[0], [3_037_000_499], [-3_037_000_499], [3_037_000_500], [3_037_500_000]], np.int64)
    centre = whitening.Centre(1, [0])
    rounded, exact = centre.deviations(x)
    assert exact == [0, 3_037_000_499**2, 3_037_000_499**2, None, None] and np.allclose(rounded, x[:, 0].astype(float) ** 2)
    n, x = 7, np.array([[100_003, 99_000], [100_001, 99_500]], np.int64)
    centre = whitening.Centre(n, [700_010, 694_003])
    assert centre.deviations(x)[1] == [sum((n * int(a) - s) ** 2 for a, s in zip(row, [700_010, 694_003], strict=True)) for row in x]


def test_query_of_whitening_on_the_whole_table(spark):
    from pactum.llm.queries import queries

    out = queries()["op11_whiten_embeddings"](spark, "/root/testdata/sf0.001").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviations, centred, e, v = by_hand(np.stack(table["embedding"]))
    wide = out.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    assert len(out) == 8 * n and np.abs(np.abs(wide.to_numpy()) - np.abs(centred @ v[:, :8] / np.sqrt(e[:8]))).max() < 1e-6
    assert out[out["component"] == 1].sort_values("vec_id")["deviation"].tolist() == deviations.tolist()


# ---------------------------------------------------------------- filter audit


def audit_by_hand(docs, labels):
    """All counts from their definitions, document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and i > least[t],
        }
        rows.append((lang or "", {k for k in fails if fails[k]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                removed, kept = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(removed)
                out[part, order, step] = [
                    len(kept), len(removed), sum(f in r[1] for r in mine) - len(removed), sum(r[1] == {f} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)
                ]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, folder, labels, **how):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(spark, str(folder), table, **how).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


LONG = " ".join(f"w{k}" for k in range(300))


def write_files(docs, folder, per_file):
    for k in range(0, max(1, len(docs)), per_file):
        rows = docs[k : k + per_file]
        table = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": pd.Series([r[1] for r in rows], dtype=object), "lang": pd.Series([r[2] for r in rows], dtype=object), "part": "clash", "n": 1})
        table.astype({"text": "string", "lang": "string"}).to_parquet(folder / f"part-{k:05}.parquet", index=False)


def test_audit_retracts_when_smaller_ids_arrive(spark, tmp_path):
    """Ids fall from file to file, so that each micro-batch takes back what the one before has counted."""
    rng = np.random.default_rng(11)
    texts = [LONG, LONG + " #", "same same same " * 90, "SHOUT " + LONG, "short", "", None, LONG.upper()]
    docs = [(int(i), texts[int(rng.integers(len(texts)))], [None, "", "en", "fr"][int(rng.integers(4))]) for i in range(119, -1, -1)]
    docs += [(7, LONG, "en"), (7, LONG, "fr"), (None, LONG, "en"), (None, "", None), (-5, "short", "de")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 120, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1), (9999, 1, 1)]
    write_files(docs, tmp_path, 18)
    assert audited(spark, tmp_path, labels, batches=7) == audit_by_hand(docs, labels)


def test_audit_does_not_depend_on_the_batches(spark, tmp_path):
    docs = [(i, LONG if i % 3 else f"{LONG} {i}", "en") for i in range(40)]
    write_files(docs, tmp_path, 10)
    expected = audit_by_hand(docs, [(1, 1, 0)])
    assert audited(spark, tmp_path, [(1, 1, 0)], batches=1) == audited(spark, tmp_path, [(1, 1, 0)], batches=4) == expected
    assert expected["en", "ABCDE", 5][1] == 25  # copies of one text, the smallest id stays
    assert audited(spark, tmp_path / "part-00000.parquet", []) == audit_by_hand(docs[:10], [])  # a table that is one file


def test_audit_of_an_empty_table(spark, tmp_path):
    write_files([], tmp_path, 1)
    assert audited(spark, tmp_path, []) == {}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.sampled_from(["x", "y"]), st.integers(0, 3), st.integers(0, 4)), max_size=40))
def test_merging_batches_of_a_bucket_gives_the_final_counts(rows):
    """Text, id, part, bits of the text, batch: whatever the order, the changes add up to the counts over all rows."""
    held, total = None, {}
    for batch in range(5):
        mine = [(t, t, i, p, t, 1, False) for t, i, p, _, b in rows if b == batch]
        new = pd.DataFrame(mine, columns=["high", "low", "doc_id", "part", "bits", "n", "settled"]).astype({"settled": bool, "part": object} | dict.fromkeys(["high", "low", "doc_id", "bits", "n"], np.int64))
        held, changes = filter_audit.merge(held, new)
        for p, bits, n in changes[["part", "bits", "n"]].itertuples(index=False):
            total[p, bits] = total.get((p, bits), 0) + n
    least = {}
    for t, i, *_ in rows:
        least[t] = min(i, least.get(t, i))
    expected = {}
    for t, i, p, *_ in rows:
        key = p, t | (filter_audit.E if i > least[t] else 0)
        expected[key] = expected.get(key, 0) + 1
    assert {k: n for k, n in total.items() if n} == expected


# ---------------------------------------------------------------- licence scan


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


WORDS = ["cc", "by", "CC", "By", "general", "public", "License", "all", "rights", "reserved", "x", "İ", "é", "nc", "sa", "mit", "lesser"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", "-", "\n", ". ", "\x7f", "_", "", "ß"])), max_size=60))
def test_base_phrases_by_brute_force(parts):
    text = "".join(w + gap for w, gap in parts)
    found = SCANNER.scan(text)
    assert (found.n_words, found.n_base, found.first_word, found.last_word, ",".join(sorted(found.base_labels))) == base_by_hand(text)
    assert found.base_labels <= found.labels and 0 <= found.score <= 1


SCANNER = licenses.Scanner()
PERMIT = {"mit": 0.2, "gpl-2.0-only": 0.6, "agpl-3.0": 0.8, "cc0-1.0": 0.0, "licenseref-own": 0.7}


@st.composite
def expressions(draw, depth=3):
    """An expression's text, and its value by recursion over how it was composed."""
    kind = draw(st.sampled_from(["one", "with", "and", "or", "brackets"])) if depth else "one"
    if kind in ("one", "with"):
        name = draw(st.sampled_from(sorted(PERMIT)))
        much = PERMIT[name]
        return (name, much, 3) if kind == "one" else (f"{name} WITH Some-exception-1.0", min(much, max(0.3, much - 0.2)), 3)
    a = draw(expressions(depth=depth - 1))
    if kind == "brackets":
        return f"( {a[0]})", a[1], 3
    b, rank = draw(expressions(depth=depth - 1)), 2 if kind == "and" else 1
    wrap = lambda e: e[0] if e[2] >= rank else f"({e[0]})"
    return f"{wrap(a)} {draw(st.sampled_from([kind, kind.upper()]))} {wrap(b)}", (max if kind == "and" else min)(a[1], b[1]), rank


@settings(max_examples=300, deadline=None)
@given(expressions(), st.sampled_from(["", "\n", " */", ". Then or (prose)", " or", " and (", " with"]))
def test_expressions_by_recursion(expression, after):
    found = SCANNER.scan(f"// SPDX-License-Identifier: {expression[0]}{after}")
    assert found.score == pytest.approx(expression[1]) and len(found.expressions) == 1


@pytest.mark.parametrize(("text", "labels"), [
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1+", {"mit", "apache", "lgpl"}),
    ("License: MIT.", {"mit"}), ("license: see the file", set()), ("sublicense: mit sub-license: mit", set()), ("license: gpl-3.0\nand mit", {"gpl"}),
    ("license: mit) or gpl", {"mit"}), ("license: or mit", set()), ("license: mit with", {"mit"}), ("license: (mit and gpl) with x", {"mit", "gpl"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}), ("the Apache\nLicense, Version 2.0", {"apache"}), ("GNU Lesser General Public License", {"gpl", "lgpl"}),
    ("@license BSD-3-Clause", {"bsd"}), ("license: licenseref-acme", {"other"}), ("", set()), (None, set()),
])
def test_labels(text, labels):
    assert SCANNER.scan(text).labels == labels


@pytest.mark.parametrize("text", ["license:" * 125_000, "license: mit and " * 60_000, "license: " + "(" * 1_000_000, "license: " + "mit or " * 150_000, "license: " + "mit-" * 250_000, "cc by " * 170_000, "license: " + "(mit or " * 120_000])
def test_long_texts_take_time_in_proportion(text):
    import time

    start = time.perf_counter()
    found = SCANNER.scan(text)
    assert time.perf_counter() - start < 10 and found.n_words == base_by_hand(text)[0]


def test_scan_of_tables(spark):
    rows = [(1, "All Rights Reserved", "a"), (1, "All Rights Reserved", "b"), (None, "cc by", "c"), (2, None, "d"), (3, "", "e"), (4, "plain words", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    out = licenses.scan_documents(docs).collect()
    assert sorted(((r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out), key=str) == sorted(((i or 0, *base_by_hand(t)) for i, t, _ in rows), key=str)
    assert licenses.scan_documents(docs.limit(0)).collect() == []


def test_query_of_the_scan_on_the_whole_table(spark):
    from pactum.llm.queries import queries

    out = {r["doc_id"]: r for r in queries()["op13_license_scan"](spark, "/root/testdata/sf0.01").collect()}
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(out) == len(table)
    for d in table:
        r = out[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_by_hand(d["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))

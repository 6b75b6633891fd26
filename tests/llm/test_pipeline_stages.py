"""Stages of the pipeline and op9 against brute force, each from the stage's own input."""

import random

import corpus_pipeline
import numpy as np
from test_text_operators import corpus, frame, labelled, linked_by_force

from pactum.llm import html_text, quality_knn

STAGES = dict(corpus_pipeline.STAGES)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def score_by_force(model, text):
    """A plain loop over all labelled vectors."""
    x = model.embed(quality_knn.features(text)[None])[0]
    near = sorted(((float(np.dot(x, v)), float(y)) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
    weights = [max(c, 0) ** 2 for c, _ in near]
    prior = quality_knn.PRIOR
    return (prior * float(np.mean(model.labels)) + sum(w * y for w, (_, y) in zip(weights, near, strict=True))) / (prior + sum(weights))


def test_quality_stage_and_votes_equal_brute_force(spark, tmp_path):
    rows, marks = labelled(6, 120)
    rows += [(900, None, None, None), (901, "", None, None)]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = quality_knn.fit(docs, labels)
    want = {i: score_by_force(model, t) for i, t, *_ in rows}
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)
    kept = texts(STAGES["quality classifier"](spark, docs, str(tmp_path)))
    assert kept == {i: t for i, t, *_ in rows if want[i] >= quality_knn.ACCEPT} and 0 < len(kept) < len(rows)


def test_near_duplicate_stage_equals_brute_force(spark):
    rows = corpus(11)
    kept = texts(STAGES["near-duplicate removal"](spark, frame(spark, rows), ""))
    want = linked_by_force(rows)
    assert kept == {i: t for i, t, *_ in rows if want[i][1] == i} and len(kept) < len(rows)


def cut_by_force(rows):
    """By the definition; documents of which a cut leaves nothing go."""
    first, out = {}, {}
    held = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in held:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    for i, b in held:
        covered = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                covered[k : k + 50] = b"\1" * 50
        if b and all(covered):
            continue
        out[i] = bytes(x for x, c in zip(b, covered, strict=True) if not c).decode()
    return out


def test_repeat_stage_equals_brute_force(spark):
    rows = [r for r in corpus(12) if r[2] != "fr"]  # ASCII: a cut never splits a character
    random.Random(1).shuffle(rows)
    got = texts(STAGES["repeated-string removal"](spark, frame(spark, rows), ""))
    want = cut_by_force(rows)
    assert {i: t or "" for i, t in got.items()} == want
    assert sum(len(t) for t in want.values()) < sum(len(t or "") for _, t, *_ in rows)


def test_long_pages_are_learnt_from_in_part():
    """No page is left out for its length; the blocks of all fitting pages together are bounded."""
    page = "<article>" + "<p>One two three.</p>" * 40 + "</article>"
    got = html_text.markup_examples([page, None, page * 5, page, page], limit=250)
    assert [len(y) for _, y in got] == [40, 200, 10] and all(y.all() for _, y in got)

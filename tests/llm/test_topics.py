import numpy as np
from pyspark.sql import functions as F

from helmsway.llm import topics

MEDIUM = "/root/testdata/sf0.01"


def test_words(spark):
    texts = [
        "filing_fee filingFee FILING Soil soil's a\nx", '{"cells": [{"cell_type": "code", "source": "a\\nplough sem\\u00e1foro"}, {"output_type": "s", "text": "grain"}]}', "", "  ",
        '{"broken', "café Größe kg", "土壌の水分 شعير गेहूँ x", "see " + "iVBORw0KGgo" * 9 + "== end",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", topics.words_of(F.col("text")).alias("w"))
    got = {r["i"]: sorted(r["w"]) for r in df.collect()}
    assert got == {
        0: ["fee", "filing", "soil"], 1: ["grain", "plough", "semáforo"], 2: [], 3: [], 4: ["broken"], 5: ["café", "größe", "kg"],
        6: sorted(["土壌", "壌の", "の水", "水分", "شعير", "गेहूँ"]), 7: ["end", "see"],
    }


def test_words_held_by_topics():
    chance = np.array([[0.5, 0.5, 1e-6, 1e-6], [1e-6, 1e-6, 0.5, 0.5]], np.float32).T
    bags = [np.array([0, 1, 0]), np.array([], int), np.array([2, 3, 2, 0])]
    held, words, shares = topics.infer(bags, np.ascontiguousarray(chance), 12)
    assert np.allclose(held.sum(axis=1), [3, 0, 4], atol=1e-4) and np.allclose(held[0], [3, 0], atol=1e-2) and np.allclose(held[2], [1, 3], atol=0.1)
    assert words.tolist() == [0, 1, 0, 2, 3, 2, 0] and np.allclose(shares.sum(axis=1), 1, atol=1e-4)
    assert topics.infer([bags[1]], chance, 3)[0].sum() == 0 and topics.infer([], chance, 3)[0].shape == (0, 2)


def test_background_topics_have_no_subject():
    uses = np.array([[0.9, 0.1, 0.0], [0.1, 0.9, 0.0], [0.3, 0.3, 0.3], [0.0, 0.0, 0.0]])
    rows = np.array([[0.97, 0.01, 0.01, 0.01], [0.01, 0.97, 0.01, 0.01], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]])
    assert topics.subject_topics(rows, uses).tolist() == [0, 1, -1, -1]


def test_the_topics_decide(spark, monkeypatch):
    read = lambda t: spark.read.parquet(f"{MEDIUM}/{t}.parquet")
    labels = {(r["doc_id"], r["subject"]) for r in topics.clean_labels(read("subject_labels"), read("subject_areas")).collect()}
    known = {d for d, _ in labels}

    def scores():
        rows = {(r["doc_id"], r["subject"]) for r in topics.subjects_of(read("documents"), read("subject_areas"), read("subject_labels")).collect()}
        rows = {r for r in rows if r[0] in known}
        return len(rows & labels) / max(1, len(rows)), len(rows & labels) / len(labels)

    precision, recall = scores()
    monkeypatch.setattr(topics, "fit_topics", lambda coded, docs, seed: np.full((topics.TOPICS, len(docs)), 1 / len(docs)))
    assert precision > 0.75 and recall > 0.65 and scores()[1] < 0.3 * recall


def test_accuracy_on_the_labelled_sample(spark):
    read = lambda t: spark.read.parquet(f"{MEDIUM}/{t}.parquet")
    labels = topics.clean_labels(read("subject_labels"), read("subject_areas"))
    learn = labels.where("pmod(hash(doc_id), 4) > 0")
    got = topics.subjects_of(read("documents"), read("subject_areas"), learn)
    rows = {(r["doc_id"], r["subject"]) for r in got.collect()}
    allowed = {r["subject"] for r in read("subject_areas").collect()}
    held_out = {(r["doc_id"], r["subject"]) for r in labels.where("pmod(hash(doc_id), 4) = 0").collect()}
    assert {s for _, s in rows} <= allowed and len(rows & held_out) >= 0.6 * len(held_out)
    blank = {r["doc_id"] for r in read("documents").where("text IS NULL OR trim(text) = ''").collect()}
    assert not {d for d, _ in rows} & blank


def test_empty_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    areas = spark.createDataFrame([("law",)], "subject string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string, annotator string")
    assert topics.subjects_of(docs, areas, labels).count() == 0
    assert topics.subjects_of(docs.limit(0), areas, labels).count() == 0


def test_labels_are_spelled_as_the_areas(spark):
    areas = spark.createDataFrame([("law",), ("food",)], "subject string")
    labels = spark.createDataFrame([(1, " LAW ", None), (1, "law", "a"), (2, "Food", "b"), (3, "magic", "c"), (4, None, "d")], "doc_id bigint, subject string, annotator string")
    assert {(r[0], r[1]) for r in topics.clean_labels(labels, areas).collect()} == {(1, "law"), (2, "food")}

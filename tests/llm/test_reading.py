"""p9: ordinal regression and features."""

import math
import random

import numpy as np

from locusforge.llm import reading

EASY = ["The dog is big.", "We see the bus.", "My friend has a red hat.", "It was a good day."]
HARD = ["Although the municipality had already approved the consultation, the appropriation nevertheless necessitates comprehensive institutional harmonisation, which remains irreconcilable with statutory indemnification.", "Notwithstanding the unprecedented macroeconomic volatility, jurisdictional fragmentation perpetuates disproportionate discretionary preconditions, whereby subsidiarity becomes indispensable."]


def text(level, r):
    return " ".join(r.choice(HARD) if r.random() < (level - 1) / 3 else r.choice(EASY) for _ in range(25))


def test_ordinal_fit_recovers_levels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    cuts, clean = np.array([-2, 0, 2]), x @ np.array([2.0, -1, 0.5, 0, 0])
    y = 1 + ((clean + rng.logistic(size=2000) * 0.2)[:, None] > cuts).sum(axis=1)
    best = (1 + (clean[1500:, None] > cuts).sum(axis=1) == y[1500:]).mean()  # what the true model reaches
    m = reading.Ordinal.fit(x[:1500], y[:1500])
    assert (m.level(x[1500:]) == y[1500:]).mean() > best - 0.03 and (np.diff(m.thresholds) > 0).all()


def test_held_out_levels(spark):
    r = random.Random(1)
    rows = [(i, text(1 + i % 4, r)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "kurz")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 + i % 4) for i in range(200)] + [(0, 1), (3, None), (7000, 2), (5, 9)], "doc_id long, level int")
    got = {x.doc_id: x.level for x in reading.reading_levels(docs, labels).collect()}
    assert set(got) == set(range(400))
    assert np.mean([got[i] == 1 + i % 4 for i in range(200, 400)]) > 0.75
    none = {x.level for x in reading.reading_levels(docs, labels.limit(0)).collect()}
    assert none == {None}
    assert {x.level for x in reading.reading_levels(docs, labels.where("doc_id = 7000")).collect()} == {None}
    assert reading.reading_levels(docs.limit(0), labels).collect() == []


def test_procedure_does_not_count():
    lex = reading.Lexicon()
    plain = " ".join(HARD * 3)
    noisy = "Madam President, honourable members. " + " (Applause) ".join(HARD * 3) + " Cf. printed paper 29/20, p. 3. Thank you for your attention."
    a, _ = reading.features([plain], lex)
    b, _ = reading.features([noisy, "", None], lex)
    assert np.abs(a[0] - b[0]).max() < 0.05 and np.isfinite(b).all()


def test_words_are_counted_over_all_documents_and_only_common_ones_kept(spark, monkeypatch):
    monkeypatch.setattr(reading, "RAREST", 0.01)
    docs = spark.createDataFrame([(i, f"aaa bbb (ccc) w{chr(97 + i % 26)}x{chr(97 + i // 26)} " + ("ddd " * (i % 3))) for i in range(300)] + [(-1, None)], "doc_id long, text string").repartition(5)
    first = reading.counted(docs, [3, 5])
    assert {r.word: r.n for r in first.where("word in ('aaa', 'bbb', 'ccc', 'ddd')").groupBy("word").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {"aaa": 300, "bbb": 300, "ddd": 300}
    assert first.where("word is null").collect() == []  # too short to be labelled
    rarity = reading.common_words(first)
    assert set(rarity) == {"aaa", "bbb", "ddd"} and abs(rarity["aaa"] - math.log(4)) < 1e-9
    assert reading.common_words(first.limit(0)) == {}

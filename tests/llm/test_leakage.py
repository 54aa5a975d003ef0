"""p8: planted passages, and a full comparison on random texts."""

import random

import numpy as np

from locusforge.llm import leakage


def vocabulary(r, n=400):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def changed(r, words, errors, kind):
    out = list(words)
    for k in sorted(r.sample(range(1, len(words) - 1), errors), reverse=True):
        if kind == "left out":
            del out[k]
        else:
            out[k] = f"neu{r.randrange(10**6)}"
    return out


def search(items, texts):
    index, words = leakage.build_index(items), leakage.Words()
    return set(leakage.find(index, words, texts))


def test_recall_of_shortest_passages_and_no_short_ones():
    r = random.Random(4)
    v, other = vocabulary(r), [w + "z" for w in vocabulary(r)]  # a word around a passage can't lengthen it by chance
    items = [(i, " ".join(r.sample(v, r.randrange(30, 90)))) for i in range(60)]
    texts, want = [], set()
    for n in range(400):
        i = r.randrange(60)
        w = items[i][1].split()
        size = r.choice([25, 25, 30, 20, 24])
        s = r.randrange(len(w) - size + 1)
        part = changed(r, w[s : s + size], r.choice([0, 1, 2]) if size >= 25 else 0, r.choice(["left out", "changed"]))
        texts.append(" ".join(r.choices(other, k=r.randrange(50)) + part + r.choices(other, k=r.randrange(50))))
        if size >= 25:
            want.add((n, i))
    got = search(items, texts)
    assert len(got & want) >= 0.98 * len(want)
    assert not got - want


def test_spelling_remarks_and_line_ends_do_not_count():
    item = "Die Gemeinde hat den Bürgern von Velsolund schon im vergangenen Jahr zugesagt dass alle Büchereien und Werkstätten bis zum Winter geöffnet bleiben und niemand weiter fahren muss"
    text = "Vorher. DIE Gemeinde hat (Beifall [laut] links) den Burgern von Velso-\nlund, schon im vergan­genen Jahr zugesagt: dass alle\n\nBüche-\nreien und [Zuruf] Werkstätten – bis zum Winter geöffnet bleiben und niemand weiter fahren muss."
    assert search([(7, item)], ["nichts", text, None, ""]) == {(1, 7)}


def test_texts_do_not_run_into_each_other():
    w = vocabulary(random.Random(1))[:40]
    item = " ".join(w)
    assert search([(1, item)], [" ".join(w[:20]), " ".join(w[20:])]) == set()
    assert search([(1, item)], [item, item]) == {(0, 1), (1, 1)}


def test_long_items_and_texts():
    r = random.Random(9)
    long = r.choices(vocabulary(r, 5000), k=3000)
    texts = [" ".join(long[s : s + 25]) for s in (0, 200, 230, 1490, 2975)] + [" ".join(long)]
    assert search([(1, " ".join(long))], texts) == {(i, 1) for i in range(6)}


def test_walks_of_equal_windows_are_equal():
    h = leakage.Words()(["\x00", *"abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz", "\x00"])
    key, end = leakage.walk_keys(h, 0)
    assert key[1] == key[27] and end[27] - 27 == end[1] - 1
    assert len(np.unique(key[1:27])) > 5  # walks from neighbouring words often meet, so some keys are shared


def test_through_spark_with_nulls_and_blocks(spark):
    w = vocabulary(random.Random(2))
    a, b = " ".join(w[:30]), " ".join(w[100:140])
    docs = spark.createDataFrame([(1, "x y " + a), (2, None), (3, ""), (4, b + " " + a), (5, "kurz")], "doc_id long, text string")
    items = spark.createDataFrame([(10, a), (11, b), (12, None), (13, "kurz"), (14, a)], "item_id int, text string")
    for chars in (leakage.BLOCK_CHARS, 100):
        got = sorted(tuple(r) for r in leakage.leaks(docs, items, chars).collect())
        assert got == [(1, 10), (1, 14), (4, 10), (4, 11), (4, 14)]
    assert leakage.leaks(docs, items.limit(0)).collect() == [] and leakage.leaks(docs.limit(0), items).collect() == []


def test_pairs_of_a_common_key_are_expanded_in_pieces(monkeypatch):
    w = vocabulary(random.Random(3))
    items = [(i, " ".join(w[:40] + [f"e{i}"])) for i in range(30)]
    index = leakage.build_index(items)
    hashes = leakage.Words()(["\x00", *w[:40], "\x00", *w[5:40], "\x00"])
    whole = leakage.candidates(index, hashes)
    monkeypatch.setattr(leakage, "EXPANDED", 7)
    assert len(whole) > 60 and (leakage.candidates(index, hashes) == whole).all()
    assert search(items, [" ".join(w[:40])]) == {(0, i) for i in range(30)}

"""p7: encoding against the library, round trips."""

import random

import numpy as np
import pytest

from locusforge.llm import tokens

pytest.importorskip("tokenizers")
ALPHABET = [*" \t\n\r\x0b\x1c\x1f\x85\xa0᠎​　aäbß1٣'ll.,-–🔔̈e", "<|endoftext|>", "  ", " a", "'s"]


def some_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(n)]


def test_memo_gives_the_library_s_ids():
    texts = [*some_texts(3000, 1), "word " * 3000, "x" * 20000, " ", "\n\n"]
    want = [e.ids for e in tokens.tokenizer(tokens.FOLDER, tokens.NAME).encode_batch(texts, add_special_tokens=False)]
    for memo in (tokens.MEMO, 50):
        encoder = tokens.Encoder(memo=memo)
        got = [np.frombuffer(b, "<i4").tolist() for s in range(0, len(texts), 100) for b in encoder(texts[s : s + 100])]
        assert got == want


def test_round_trip_and_defined_ids(spark):
    texts = [*some_texts(200, 2), None, "", "ein 🔔 Läuten"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    ids = tokens.encode(docs)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got[200] == [] and got[201] == []
    back = {r.doc_id: r.text for r in tokens.decode(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_decode_of_split_characters_nulls_and_unknown_ids(spark):
    ids = [e.ids for e in tokens.tokenizer(tokens.FOLDER, tokens.NAME).encode_batch(["🔔"], add_special_tokens=False)][0]
    rows = spark.createDataFrame([(1, ids[:1]), (2, None), (3, []), (4, [10**6, None, *ids])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in tokens.decode(rows).collect()}
    assert got == {1: "�", 2: None, 3: "", 4: "🔔"}


def test_offsets_cover_the_text(spark):
    text = "Vielen Dank, 🔔!"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.starts, r.ends) for r in tokens.offsets(docs).collect()}
    assert got[2] == ([], []) and got[1][1][-1] == len(text)
    covered = set()
    for s, e in zip(*got[1]):
        covered.update(range(s, e))
    assert covered == set(range(len(text)))


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []

"""Encoding of whole corpora with a public byte-level BPE, and back.

The tokenizers library encodes over Arrow batches. As a byte-level BPE treats each piece of text between blanks
alone, the distinct pieces of a batch are encoded once and kept in a bounded memo of their packed ids; a text is
then a concatenation of memo entries. A single blank between two non-blanks always starts a piece, so texts are cut there
and nowhere else.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public tokenizers' files; a parameter of every function here.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Entries of the memo before it is emptied, and the longest piece it keeps.
MEMO, LONGEST = 200_000, 64
_CUT = re.compile(r"(?<!\s) (?!\s)")
_ODD = re.compile(r"\s\s|^\s|\s$")


@lru_cache(maxsize=4)
def tokenizer(folder: str, name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    t.encode_special_tokens = True
    return t


def _pieces(text: str) -> list[str]:
    """The text cut before each single blank between non-blanks; every piece but the first lacks that blank."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Encoder:
    """Packed little-endian ids of texts; one per Python worker."""

    def __init__(self, folder: str = FOLDER, name: str = NAME, memo: int = MEMO):
        self.t, self.memo, self.most = tokenizer(folder, name), {}, memo

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        known = self.memo
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > self.most:
            known = self.memo = {}
            new = list(pieces)
        fresh = {p: np.array(e.ids, "<i4").tobytes() for p, e in zip(new, self.t.encode_batch_fast(new, add_special_tokens=False))}
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST)
        return fresh

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = []
        for t in texts:
            parts = _pieces(t) if t else []
            cut.append(parts[:1] + [" " + p for p in parts[1:]])
        wanted = set().union(*cut) if cut else set()
        fresh = self._learn(wanted)
        get = (self.memo if all(p in self.memo for p in fresh) else self.memo | fresh).__getitem__
        return [b"".join(map(get, c)) for c in cut]


def _encode(folder: str, name: str):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(folder, name)
        for b in batches:
            packed = encoder(b.column(1).to_pylist())
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.record_batch([b.column(0), ids], names=["doc_id", "ids"])

    return over


def encode(docs: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``doc_id, ids`` of every document, without special tokens.

    Null and empty texts give an empty list; texts of blanks give the ids of the blanks; strings that look like
    special tokens are ordinary text. Repeated ids stay repeated rows; very long texts are encoded whole.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode(folder, name), "doc_id long, ids array<int>")


def _offsets(folder: str, name: str):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(folder, name)
        for b in batches:
            e = t.encode_batch([x or "" for x in b.column(1).to_pylist()], add_special_tokens=False)
            ends = [[o for _, o in x.offsets] for x in e]
            starts = [[o for o, _ in x.offsets] for x in e]
            yield pa.record_batch([b.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "starts", "ends"])

    return over


def offsets(docs: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``doc_id, starts, ends``: the characters [start, end) of each token; tokens of a split character share it."""
    return docs.select("doc_id", "text").mapInArrow(_offsets(folder, name), "doc_id long, starts array<int>, ends array<int>")


def byte_table() -> dict[str, int]:
    """Byte of each character that stands for it in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _id_bytes(folder: str, name: str) -> tuple[bytes, ...]:
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    table = byte_table()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return tuple(out)


def _decode(folder: str, name: str):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _id_bytes(folder, name)
        for b in batches:
            texts = [None if ids is None else b"".join([table[i] for i in ids if i is not None and 0 <= i < len(table)]).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return over


def decode(tokens: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``.

    Bytes are joined before they become characters, so that characters split over tokens come back whole; a list
    that ends inside a character ends in U+FFFD. Null lists give null, empty lists the empty text, unknown and null ids nothing.
    """
    return tokens.select("doc_id", "ids").mapInArrow(_decode(folder, name), "doc_id long, text string")

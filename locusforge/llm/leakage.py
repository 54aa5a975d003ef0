"""Passages of evaluation items inside documents.

Both sides become sequences of plain words. From every word a random walk in the manner of Chakraborty, Goldenberg
and Koucky embeds the window that starts there: at step j the word under the walk decides, by a random bit of
its own for that step, whether the walk moves on. Two windows that differ by few changed, missing or added words
fall into step again soon, so that edit distance becomes Hamming distance. A sample of the steps' words is the
window's key; windows of documents and items that share a key in one of several repetitions are candidates.
Candidates are verified by counting matches near their diagonal and, where enough are found, by exact alignment.

The items are the stated query set: they go to every executor in blocks of bounded size, and each block scans the
documents once, without any shuffle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Successive words of an item that a document must hold, and how many of them may be changed or left out.
WINDOW, ERRORS = 25, 2
#: Steps of a walk, steps sampled for a key, repetitions. Simulated recall of 25-word passages with two changes at the
#: end of a text: 0.998; of longer ones 1.
STEPS, SAMPLED, REPEATS = 32, 10, 8
#: Words of an item handled as one; longer items are cut into segments that overlap by more than a window and its walk.
SEGMENT, OVERLAP = 256, 64
#: Pairs of windows with a common key that are expanded at once.
EXPANDED = 2_000_000
#: Characters of item texts in one block, and characters of documents handled at once.
BLOCK_CHARS, PIECE_CHARS = 4_000_000, 600_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_GAP = "\x00"
REMARK = re.compile(r"\([^()\[\]\x00]*\)|\[[^()\[\]\x00]*\]")
_BROKEN = re.compile("(?<=\\w)[-\u2010\u00ad\u00ac][ \t]*\r?\n[ \t]*(?=\\w)")
_WORD = re.compile(r"[^\W_]+|\x00")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Cf}]+")


def plain(text: str) -> str:
    """Lower case without accents, bracketed remarks, and hyphens at line ends; ``\\x00`` stays."""
    n = 1
    while n:
        text, n = REMARK.subn(" ", text)
    text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return text.lower()


def plain_words(text: str | None) -> list[str]:
    """The words of one text; null and empty texts have none."""
    return [w for w in _WORD.findall(plain(text or "")) if w != _GAP]


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each number for a seed."""
    x = x ^ np.uint64(seed * 0x2545F4914F6CDD1D % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Stable 64-bit hashes of words; 0 stands between texts. The memo of words is emptied when it is full."""

    def __init__(self, most: int = 500_000):
        self.ids: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > self.most:
            ids.clear()
        for w in set(words).difference(ids):
            ids[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1
        ids[_GAP] = 0
        return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


def sampled_steps(repeat: int) -> list[int]:
    return sorted(np.random.default_rng(1000 + repeat).permutation(STEPS)[:SAMPLED].tolist())


def walk_keys(hashes: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the window that starts at each word, and where its walk ends; walks stop between texts."""
    bits = _mix(hashes, repeat + 1)
    bits[hashes == 0] = 0
    values = _mix(hashes, 977)
    here = np.arange(len(hashes), dtype=np.int64)
    at, key = here.copy(), np.zeros(len(hashes), np.uint64)
    wanted = set(sampled_steps(repeat))
    for j in range(STEPS):
        if j in wanted:
            key *= _PRIME
            key += values[at]
            key ^= key >> np.uint64(29)
        moved = (bits >> np.uint64(j)).astype(np.int64)
        moved &= 1
        moved += here
        at = moved[at]
    return key, at


@dataclass
class Index:
    """Windows of a block of items by their keys in each repetition. Items come in segments of bounded length."""

    words: np.ndarray  # a row of word hashes per segment, 0 beyond its end
    ids: np.ndarray  # item of each segment
    keys: list[np.ndarray]  # sorted distinct keys
    rows: list[np.ndarray]  # where the windows of each key begin in segment, place
    segment: list[np.ndarray]
    place: list[np.ndarray]
    seen: list[np.ndarray]  # by the low bits of a key, whether any key has them


_LOW_BITS = 20
_LOW = np.uint64(2**_LOW_BITS - 1)


def build_index(items: list[tuple[int, str | None]]) -> Index:
    """Items of fewer words than WINDOW cannot be found and are left out."""
    hashed, ids, parts = Words(), [], []
    for i, text in items:
        h = hashed(plain_words(text))
        for s in range(0, max(1, len(h) - OVERLAP), SEGMENT - OVERLAP):
            if len(h[s : s + SEGMENT]) >= WINDOW:
                ids.append(i)
                parts.append(h[s : s + SEGMENT])
    width = max((len(x) for x in parts), default=0)
    words = np.zeros((len(parts), width + 1), np.uint64)
    for k, x in enumerate(parts):
        words[k, : len(x)] = x
    out = Index(words[:, :width].copy(), np.array(ids, np.int64), [], [], [], [], [])
    for r in range(REPEATS if parts else 0):
        stream = words.ravel()
        key, end = walk_keys(stream, r)
        at = np.flatnonzero((stream != 0) & (stream[end] != 0))
        at = at[np.argsort(key[at], kind="stable")]
        unique, first = np.unique(key[at], return_index=True)
        low = np.zeros(2**_LOW_BITS, bool)
        low[(unique & _LOW).astype(np.int64)] = True
        for column, v in zip((out.keys, out.rows, out.segment, out.place, out.seen), (unique, np.append(first, len(at)), at // (width + 1), at % (width + 1), low)):
            column.append(v)
    return out


def candidates(index: Index, hashes: np.ndarray) -> np.ndarray:
    """Distinct (diagonal, segment) of the pairs of windows that share a key; the diagonal is the place in ``hashes``
    where the segment would begin, and may lie before their start."""
    n, width, found = len(index.ids), index.words.shape[1], []
    for r in range(len(index.keys)):
        if not len(index.keys[r]):
            continue
        key, end = walk_keys(hashes, r)
        hit = np.flatnonzero(index.seen[r][(key & _LOW).astype(np.int64)] & (hashes != 0) & (hashes[end] != 0))
        row = np.searchsorted(index.keys[r], key[hit])
        row[row == len(index.keys[r])] = 0
        same = index.keys[r][row] == key[hit]
        hit, row = hit[same], row[same]
        # a key that very many windows share is expanded piece by piece; of each piece only the distinct pairs stay
        first, last = index.rows[r][row], index.rows[r][row + 1]
        ends = np.cumsum(last - first)
        for low in range(0, int(ends[-1]) if len(ends) else 0, EXPANDED):
            at = np.arange(low, min(low + EXPANDED, int(ends[-1])))
            of = np.searchsorted(ends, at, "right")
            y = last[of] - (ends[of] - at)
            found.append(np.unique((hit[of] - index.place[r][y] + width) * n + index.segment[r][y]))
    every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.column_stack([every // max(n, 1) - width, every % max(n, 1)])


def near_matches(index: Index, hashes: np.ndarray, pairs: np.ndarray, block: int = 2048) -> np.ndarray:
    """The pairs with a stretch of WINDOW item words of which all but ERRORS stand within ERRORS of the diagonal.

    No true case is lost: within such a stretch an alignment leaves the diagonal by at most its errors.
    """
    width = index.words.shape[1]
    keep = np.zeros(len(pairs), bool)
    items = index.words.astype(np.uint32)  # equal words stay equal; the few clashes are undone by the exact step
    margin = np.zeros(width + ERRORS, np.uint32)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([margin, hashes.astype(np.uint32), margin]), width + 2 * ERRORS) if len(pairs) else None
    for s in range(0, len(pairs), block):
        diagonal, segment = pairs[s : s + block, 0], pairs[s : s + block, 1]
        near, words = around[diagonal + width], items[segment]
        match = np.zeros(words.shape, bool)
        for shift in range(2 * ERRORS + 1):
            match |= near[:, shift : shift + width] == words
        match &= words != 0
        total = np.zeros((len(match), width + 1), np.int16)
        np.cumsum(match, axis=1, out=total[:, 1:])
        keep[s : s + block] = (total[:, WINDOW:] - total[:, :-WINDOW]).max(axis=1) >= WINDOW - ERRORS
    return keep


def holds(item: list[int], doc: list[int], diagonal: int, slack: int = 2 * ERRORS) -> bool:
    """Whether a stretch of WINDOW item words, its first and last unchanged, aligns with ``doc`` near the diagonal
    with at most ERRORS words changed, left out or put in between."""
    n = len(doc)
    for i in range(len(item) - WINDOW + 1):
        for j in range(max(0, i + diagonal - slack), min(n, i + diagonal + slack + 1)):
            if item[i] != doc[j]:
                continue
            states = {0: 0}  # shift against this start -> fewest errors
            for t in range(1, WINDOW):
                after: dict[int, int] = {}
                for shift, e in states.items():
                    for put in range(ERRORS - e + 1):  # words put in before this one
                        k = j + t + shift + put
                        if k < n and item[i + t] == doc[k] and after.get(shift + put, 9) > e + put:
                            after[shift + put] = e + put
                    if e < ERRORS:
                        if after.get(shift, 9) > e + 1:
                            after[shift] = e + 1  # changed
                        if after.get(shift - 1, 9) > e + 1:
                            after[shift - 1] = e + 1  # left out
                states = after
                if not states:
                    break
            if any(j + WINDOW - 1 + s < n and item[i + WINDOW - 1] == doc[j + WINDOW - 1 + s] for s in states):
                return True
    return False


def find(index: Index, words: Words, texts: list[str | None]) -> list[tuple[int, int]]:
    """(number of the text, item id) of every text that holds a passage of an item."""
    tokens = _WORD.findall(plain(_GAP + _GAP.join([(t or "").replace(_GAP, " ") for t in texts]) + _GAP))
    hashes = words(tokens)
    gaps = np.flatnonzero(hashes == 0)
    pairs = candidates(index, hashes)
    pairs = pairs[near_matches(index, hashes, pairs)]
    out = set()
    for diagonal, k in pairs.tolist():
        item, doc_item = index.words[k][index.words[k] != 0].tolist(), int(index.ids[k])
        # the stretch of the stream that the segment may touch, cut into texts
        low, high = max(0, diagonal - 2 * ERRORS), diagonal + len(item) + 2 * ERRORS
        first = max(0, int(np.searchsorted(gaps, low, "right")) - 1)
        last = min(len(gaps) - 2, int(np.searchsorted(gaps, high, "left")))
        for text in range(first, last + 1):
            s, e = max(int(gaps[text]) + 1, low), min(int(gaps[text + 1]), high)
            if e - s >= WINDOW - ERRORS and (text, doc_item) not in out and holds(item, hashes[s:e].tolist(), diagonal - s):
                out.add((text, doc_item))
    return sorted(out)


def _scan(broadcast):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words = broadcast.value, Words()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            docs, items, s, size = [], [], 0, 0
            for e, t in enumerate(texts, 1):
                size += len(t or "") + 1
                if size >= PIECE_CHARS or e == len(texts):
                    for text, item in find(index, words, texts[s:e]):
                        docs.append(ids[s + text])
                        items.append(item)
                    s, size = e, 0
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return over


def leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id`` of every document that holds a passage of an item; each pair once per document row.

    docs: ``doc_id, text``; items: ``item_id, text`` with unique ids. Null, empty and short texts hold and give
    nothing; items with equal texts are each reported. Items are read to the driver in blocks of about
    ``block_chars`` characters, one scan of the documents each; the number of blocks follows the items.
    """
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    out = None
    for k in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        index = spark.sparkContext.broadcast(build_index(sorted((r[0], r[1]) for r in rows)))
        part = docs.select("doc_id", "text").mapInArrow(_scan(index), "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out

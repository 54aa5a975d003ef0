"""Reading level of documents by regularised ordinal regression.

A first pass over all documents counts their words and sets the labelled ones aside; the counts give the rarity of the common
words, and the labelled documents are what a proportional-odds model is fitted on per language. A second pass scores every document.
Remarks in brackets, fragments with numbers, and short formulas of address and thanks count as procedure and are left
out of the features.

Words are kept one by one as far as their share of the corpus is at least RAREST; of those there can be no more than
1 / RAREST, however large the corpus, and all others have the rarity of that share.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from locusforge.llm.leakage import REMARK
from locusforge.session import cut_lineage

LEVELS = 4
#: Labelled documents that the model is fitted on at most; of more, those with the smallest hash of doc_id.
SAMPLE = 20_000
#: Characters from which a document gets a level.
LEAST_CHARS = 200
#: Share of all words from which a word has a rarity of its own (so at most 270,000 words have one), and its rarity.
TOP_RARITY = 12.5
RAREST = math.exp(-TOP_RARITY)
#: Distinct words that a task counts before it passes the counts on.
WORDS = 500_000
PIECE_CHARS = 600_000
RIDGE = 0.002

# Words by which language, connectives, subordination and formulas are recognised.
ENGLISH = "the of and to a in is that for it was we this are not my you".split()
GERMAN = "der die das und zu in den nicht von wir ist ein eine mit dem wollen sind".split()
CONNECTIVES = """although because since while before after when if unless however therefore moreover nevertheless contrary despite whereas
obwohl weil nachdem bevor wenn falls sofern insofern jedoch deshalb daher sodass dennoch trotz während solange soweit unbeschadet""".split()
SUBORDINATORS = """which that who whom whose where why whether whereby upon irrespective notwithstanding
dass deren dessen welche welcher welches wodurch woraus worauf wonach warum ob""".split()
FORMULA = """president madam honourable colleagues thank members attention chair
präsidentin präsident damen herren danke dank kolleginnen kollegen aufmerksamkeit""".split()

_BROKEN = re.compile("­|(?<=\\w)-[ \t]*\r?\n[ \t]*(?=\\w)")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[.!?;:–—…,\x00]")
_GAP = "\x00"
_LENGTHS = np.array([8, 12, 17, 23, 30, 40])  # words of a sentence
_WIDTHS = np.array([4.0, 4.6, 5.2, 5.8, 6.5, 7.5])  # mean letters of its words
_RARITY = np.array([7.0, 9.0, 11.0])  # -log of a word's share of the corpus
N_FEATURES = (len(_LENGTHS) + 1) * (len(_WIDTHS) + 1) + 15

# what a token is, as bits
_LETTERS, _NUMBER, _STOP, _COMMA, _END = 1, 2, 4, 8, 16
_CONN, _SUB, _FORM, _EN, _DE = 32, 64, 128, 256, 512
_KIND = Counter()
for _words, _bit in ((CONNECTIVES, _CONN), (SUBORDINATORS, _SUB), (FORMULA, _FORM), (ENGLISH, _EN), (GERMAN, _DE)):
    for _w in _words:
        _KIND[_w] |= _bit


def tokens(texts: list[str | None]) -> list[str]:
    """Tokens of all texts in lower case; each text ends with ``\\x00``."""
    joined = _GAP.join([(t or "").replace(_GAP, " ") for t in texts]) + _GAP
    n = 1
    while n:
        joined, n = REMARK.subn(" ", joined)
    return _TOKEN.findall(_BROKEN.sub("", joined).lower())


class Lexicon:
    """Kind, length and rarity of each token, kept in a memo that is emptied when it is full."""

    def __init__(self, rarity: dict[str, float] | None = None, most: int = 500_000):
        self.ids: dict[str, int] = {}
        self.most = most
        self.rarity = rarity or {}
        self.table, self.rare = np.zeros((0, 2), np.int32), np.zeros(0)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self.ids
        if len(ids) > self.most:
            ids.clear()
            self.table, self.rare = self.table[:0], self.rare[:0]
        fresh = sorted(set(words).difference(ids))
        if fresh:
            rows = np.zeros((len(fresh), 2), np.int32)
            for k, w in enumerate(fresh):
                ids[w] = len(self.table) + k
                kind = _END if w == _GAP else _COMMA if w == "," else _NUMBER if w[0].isdigit() else _LETTERS if w.isalpha() else _STOP
                rows[k] = kind | _KIND.get(w, 0), len(w)
            self.table = np.concatenate([self.table, rows])
            self.rare = np.concatenate([self.rare, [self.rarity.get(w, TOP_RARITY) for w in fresh]])
        code = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        return code, self.table, self.rare


def features(texts: list[str | None], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """A row of N_FEATURES per text, and whether it reads as German."""
    n = len(texts)
    code, table, rarity = lexicon(tokens(texts))
    kind = table[code, 0]
    end = (kind & _END) > 0
    doc = np.cumsum(end) - end
    stop = (kind & (_STOP | _END)) > 0
    sentence = np.cumsum(stop) - stop
    s_count = int(sentence[-1]) + 1
    s_doc = np.zeros(s_count, np.int64)
    s_doc[sentence] = doc

    def per_sentence(x: np.ndarray) -> np.ndarray:
        return np.bincount(sentence, x, s_count)

    letters = (kind & _LETTERS) > 0
    words, width = per_sentence(letters), per_sentence(table[code, 1] * letters)
    procedure = (per_sentence((kind & _NUMBER) > 0) > 0) | (words < 3) | ((per_sentence((kind & _FORM) > 0) > 0) & (words <= 10))
    use = ~procedure
    own = letters & use[sentence]

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(s_doc[use], x[use], n)

    total = np.maximum(per_doc(words), 1)
    sentences = np.maximum(per_doc(np.ones(s_count)), 1)
    mean = width / np.maximum(words, 1)
    columns = (len(_LENGTHS) + 1) * (len(_WIDTHS) + 1)
    grid = np.searchsorted(_LENGTHS, words, "right") * (len(_WIDTHS) + 1) + np.searchsorted(_WIDTHS, mean, "right")
    # share of sentences in each cell of length and width
    shares = np.bincount((s_doc * columns + grid)[use], minlength=n * columns).reshape(n, columns) / sentences[:, None]

    def of_words(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc[own], x[own], n) / total

    rare = rarity[code]
    length = table[code, 1].astype(float)
    pair = np.sort(doc[own].astype(np.int64) * (len(table) + 1) + code[own])
    types = np.bincount(pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]] // (len(table) + 1), minlength=n) if len(pair) else np.zeros(n)
    other = [
        np.log(total / sentences),
        per_doc(words * words) / total / 30,
        of_words(length),
        *(of_words(length >= k) for k in (7, 10, 13, 17)),
        of_words(rare),
        *(of_words(rare >= k) for k in _RARITY),
        np.log(np.maximum(types, 1)) - 0.7 * np.log(total),  # distinct words for the length of the text
        of_words((kind & _CONN) > 0) * total / sentences,
        of_words((kind & _SUB) > 0) * total / sentences,
        per_doc(per_sentence((kind & _COMMA) > 0)) / sentences,
    ]
    german = np.bincount(doc, (kind & _DE) > 0, n) > np.bincount(doc, (kind & _EN) > 0, n)
    return np.column_stack([shares, *other]), german


@dataclass
class Ordinal:
    """Proportional odds: P(level > k) = logistic(x w - threshold_k)."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 1500, rate: float = 0.03) -> Ordinal:
        """Penalised likelihood by full-batch Adam; y: levels from 1. Needs no more than one level to be present."""
        center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = np.clip((x - center) / scale, -6, 6)
        above = (y[:, None] > np.arange(1, LEVELS)).astype(float)
        share = np.clip(above.mean(axis=0), 0.01, 0.99)
        p = np.concatenate([np.zeros(z.shape[1]), [-np.log(share[0] / (1 - share[0]))], np.full(LEVELS - 2, 0.5)])
        m, v = np.zeros_like(p), np.zeros_like(p)
        d = z.shape[1]
        for t in range(1, steps + 1):
            w, cuts = p[:d], np.cumsum(np.append(p[d], np.exp(p[d + 1 :])))
            q = 1 / (1 + np.exp(-np.clip((z @ w)[:, None] - cuts, -30, 30)))
            err = (q - above) / len(z)
            g_cut = -err.sum(axis=0)
            tail = np.cumsum(g_cut[::-1])[::-1]  # a later cut moves with every earlier gap
            g = np.concatenate([z.T @ err.sum(axis=1) + ridge * w, [tail[0]], tail[1:] * np.exp(p[d + 1 :])])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        return cls(center, scale, p[:d], np.cumsum(np.append(p[d], np.exp(p[d + 1 :]))))

    def level(self, x: np.ndarray) -> np.ndarray:
        score = np.clip((x - self.center) / self.scale, -6, 6) @ self.weights
        return 1 + (score[:, None] > self.thresholds).sum(axis=1)


def _pieces(ids: list, texts: list):
    s, size = 0, 0
    for e, t in enumerate(texts, 1):
        size += len(t or "") + 1
        if size >= PIECE_CHARS or e == len(texts):
            yield ids[s:e], texts[s:e]
            s, size = e, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, labelled) to (word, n) of all texts and (doc_id, text) of the labelled ones."""
    seen: Counter = Counter()

    def rows(words: list, counts: list, ids: list, texts: list) -> pa.RecordBatch:
        none = [None] * len(words), [None] * len(ids)
        columns = [words + none[1], counts + none[1], none[0] + ids, none[0] + texts]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n", "doc_id", "text"])

    def counted() -> Iterator[pa.RecordBatch]:
        words = [w for w in seen if w.isalpha()]
        for s in range(0, len(words), 50_000):
            part = words[s : s + 50_000]
            yield rows(part, [seen[w] for w in part], [], [])
        seen.clear()

    for b in batches:
        ids, texts, labelled = (c.to_pylist() for c in b.columns)
        for _, some in _pieces(ids, texts):
            seen.update(tokens(some))
        kept = [k for k, x in enumerate(labelled) if x]
        if kept:
            yield rows([], [], [ids[k] for k in kept], [texts[k] for k in kept])
        if len(seen) > WORDS:
            yield from counted()
    yield from counted()


def common_words(counts: DataFrame) -> dict[str, float]:
    """Rarity, -log of its share of all words, of every word whose share is at least RAREST, from ``word, n`` rows.

    At most 1 / RAREST words come to the driver."""
    sums = counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    top = sums.where(F.col("n") >= RAREST * total).toArrow()
    return dict(zip(top["word"].to_pylist(), (math.log(total) - np.log(top["n"].to_numpy())).tolist())) if total else {}


def _features(broadcast):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(broadcast.value)
        for b in batches:
            for ids, texts in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, german = features(texts, lexicon)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(german), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "german", "x"])

    return over


def _score(broadcast):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, models = broadcast.value
        lexicon = Lexicon(rarity)
        for b in batches:
            for ids, texts in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, german = features(texts, lexicon)
                level = np.where(german, models[True].level(x), models[False].level(x))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(level.astype(np.int32))], names=["doc_id", "level"])

    return over


def fit(x: np.ndarray, german: np.ndarray, y: np.ndarray, least: int = 60) -> dict[bool, Ordinal]:
    """A model per language; one with fewer than ``least`` labelled documents takes those of both."""
    out = {}
    for g in (False, True):
        own = german == g
        if own.sum() < least:
            own = np.ones(len(y), bool)
        out[g] = Ordinal.fit(x[own], y[own])
    return out


def ratings(labels: DataFrame, sample: int = SAMPLE) -> dict[int, list[int]]:
    """The ratings of at most ``sample`` documents, those with the smallest hash of doc_id; two raters give two ratings."""
    rated = labels.where(f"level between 1 and {LEVELS} and doc_id is not null").select("doc_id", "level")
    chosen = rated.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = rated.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.collect_list("level").alias("levels"))
    return {r[0]: r[1] for r in some.collect()}


def counted(docs: DataFrame, ids: Iterable[int]) -> DataFrame:
    """``word, n`` of all documents and ``doc_id, text`` of those in ``ids`` (at most SAMPLE) that are long enough, written once."""
    wanted = docs.sparkSession.createDataFrame([(k,) for k in ids], "__id long")
    marked = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("__id"), "left")
    marked = marked.select("doc_id", "text", (F.col("__id").isNotNull() & (F.length("text") >= LEAST_CHARS)).alias("labelled"))
    return cut_lineage(marked.mapInArrow(_count, "word string, n long, doc_id long, text string"))


def training_rows(texts: DataFrame, of: dict[int, list[int]], rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, language and label of labelled documents, a rating each."""
    rows = texts.select("doc_id", "text").mapInArrow(_features(rarity), "doc_id long, german boolean, x array<double>").toArrow()
    x, german, y = [], [], []
    for i, g, v in sorted(zip(*(rows[c].to_pylist() for c in ("doc_id", "german", "x")))):
        for level in sorted(of[i]):
            x.append(v)
            german.append(g)
            y.append(level)
    return np.array(x, float).reshape(len(y), N_FEATURES), np.array(german, bool), np.array(y, int)


def reading_levels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, level`` (1 easiest to 4 hardest) of every document of at least LEAST_CHARS characters.

    docs: ``doc_id, text``; labels: ``doc_id, level``, repeated and null ratings allowed. Null, empty and short texts get
    no row; repeated documents are repeated. Without any usable label, so that nothing can be fitted, every level is null.
    """
    spark = docs.sparkSession
    wanted = docs.where(f"length(text) >= {LEAST_CHARS}").select("doc_id", "text")
    of = ratings(labels, sample)
    first = counted(docs, of) if of else None
    if first is not None:
        rarity = common_words(first)
        x, german, y = training_rows(first.where("word is null"), of, spark.sparkContext.broadcast(rarity))
    if first is None or not len(y):
        return wanted.select("doc_id", F.lit(None).cast("int").alias("level"))
    both = spark.sparkContext.broadcast((rarity, fit(x, german, y)))
    return wanted.mapInArrow(_score(both), "doc_id long, level int")

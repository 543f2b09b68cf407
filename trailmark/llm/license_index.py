"""Licence scan with a positional index of rare tokens.

The words of the licence wordings are counted over all documents. The index holds, for each wording, the places of
its rarest words, as many as any acceptable place must share one of. All of a document's words are looked up in it; each hit says where the wording would
begin, hits that agree (give or take a few words) are intersected, and such a place is accepted if the words that
stand there carry enough of the wording's IDF and every mandatory phrase of the wording stands near it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .license_templates import BASE, TEMPLATES

#: A word is a run of these: digits, letters a to z and whatever is not ASCII.
LETTER = ((B.BYTES >= 0x30) & (B.BYTES <= 0x39)) | ((B.BYTES >= 0x61) & (B.BYTES <= 0x7A)) | (B.BYTES >= 0x80)
#: Words by which a hit may be out of place, share of IDF that accepts.
SLACK, ACCEPT = 2, 0.6


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = B.LOWER[data]
    start, end = B.spans(LETTER[low], offsets)
    return B.span_hash(low, start, end), B.bounds(start, offsets)


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return hashed_words(raw, np.array([0, len(raw)]))[0]


def vocabulary() -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for _, t, _ in TEMPLATES]))


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of docs, and for each word of the vocabulary the rows that have it."""
    known = vocabulary()

    def run(rows, data, offsets):
        h, of = hashed_words(data, offsets)
        at = np.flatnonzero(B.among(h, known))
        pairs = np.unique(B.owners(of)[at] * len(known) + np.searchsorted(known, h[at]))
        n = np.bincount(pairs % len(known), minlength=len(known))
        return pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(known)), -1)), pa.array(np.append(n, rows.num_rows))], ["word", "n"])

    counted = dict(docs.select("text").mapInArrow(B.mapped(run), "word long, n long").groupBy("word").agg(F.sum("n")).collect())
    return counted.get(-1, 0), np.array([counted.get(i, 0) for i in range(len(known))])


class Index:
    """Postings of the wordings' rare words."""

    def __init__(self, rows: int, df: np.ndarray):
        self.known = vocabulary()
        self.idf = np.log((rows + 1) / (df + 1)) + 0.05
        self.words = [np.searchsorted(self.known, _hashes(t)) for _, t, _ in TEMPLATES]
        self.mass = np.array([self.idf[w].sum() for w in self.words])
        self.phrases = [[_hashes(p) for p in phrases] for _, _, phrases in TEMPLATES]
        posts = []
        for t, ws in enumerate(self.words):
            order = np.argsort(-self.idf[ws], kind="stable")
            # the words before have less than 1 - ACCEPT of the IDF, so that without this one a place could do without all
            needed = np.cumsum(self.idf[ws][order]) - self.idf[ws][order] <= (1 - ACCEPT) * self.mass[t]
            posts += [(ws[i], t, i) for i, must in zip(order, needed) if must or self.idf[ws[i]] >= 0.5 * self.idf[ws].max()]
        posts = np.array(sorted(posts), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(posts[:, 0], np.arange(len(self.known) + 1))
        self.wording, self.place = posts[:, 1], posts[:, 2]

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Distinct (wording, place in h where it would begin), from all the texts' words that have postings."""
        at = np.flatnonzero(B.among(h, self.known))
        word = np.searchsorted(self.known, h[at])
        n = np.diff(self.first)[word]
        hit = np.repeat(np.arange(len(at)), n)
        post = self.first[word][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.stack([self.wording[post], at[hit] - self.place[post]], axis=1), axis=0)

    def share(self, h: np.ndarray, lo: int, hi: int, wording: int, begin: int) -> float:
        """Part of the wording's IDF whose words stand where they should, give or take SLACK."""
        words = self.words[wording]
        found = np.zeros(len(words), bool)
        for off in range(-SLACK, SLACK + 1):
            place = begin + off + np.arange(len(words))
            ok = (place >= lo) & (place < hi)
            found[ok] |= h[place[ok]] == self.known[words[ok]]
        return float(self.idf[words[found]].sum() / self.mass[wording])

    def phrase_near(self, h: np.ndarray, lo: int, hi: int, wording: int, begin: int) -> bool:
        a, b = max(lo, begin - SLACK), min(hi, begin + len(self.words[wording]) + SLACK)
        return all(len(_places(h[a:b], phrase)) > 0 for phrase in self.phrases[wording])


def _places(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = h[:n] == phrase[0]
    for i in range(1, len(phrase)):
        ok &= h[i : i + n] == phrase[i]
    return np.flatnonzero(ok)


def scan_piece(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, index: Index) -> pa.RecordBatch:
    h, of = hashed_words(data, offsets)
    n_docs = len(of) - 1
    owner = B.owners(of)
    places, labels = [], [set() for _ in range(n_docs)]
    for phrase, label in BASE:
        words = _hashes(phrase)
        at = _places(h, words)
        at = at[owner[at] == owner[at + len(words) - 1]]
        places.append(at)
        for doc in np.unique(owner[at]):
            labels[doc].add(label)
    base = [",".join(sorted(x)) for x in labels]
    at = np.sort(np.concatenate(places))
    cut = np.searchsorted(at, of)
    n_base = np.diff(cut)
    first = [int(at[a] - o) if a < b else None for a, b, o in zip(cut, cut[1:], of)]
    last = [int(at[b - 1] - o) if a < b else None for a, b, o in zip(cut, cut[1:], of)]
    score = np.zeros(n_docs)
    for wording, begin in index.candidates(h):
        # a wording that would begin before its text is cut off there; which text: that of its rare words
        inside = min(max(begin, 0), len(h) - 1)
        for doc in {int(owner[inside]), int(owner[min(begin + len(index.words[wording]) - 1, len(h) - 1)])}:
            lo, hi = int(of[doc]), int(of[doc + 1])
            share = index.share(h, lo, hi, wording, begin)
            if share >= ACCEPT and index.phrase_near(h, lo, hi, wording, begin):
                labels[doc].add(TEMPLATES[wording][0])
                score[doc] = max(score[doc], min(1.0, share))
    columns = [
        rows.column("doc_id"),
        pa.array(np.diff(of)),
        pa.array(n_base),
        pa.array(first, pa.int64()),
        pa.array(last, pa.int64()),
        pa.array(base),
        pa.array([",".join(sorted(x)) for x in labels]),
        pa.array(score),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    score: the largest share of a wording's IDF found at an accepted place, 0 without one. Null and empty texts have
    no words and no labels; repeated rows repeat.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = Index(*document_frequency(narrow))
    run = B.mapped(lambda rows, data, offsets: scan_piece(rows, data, offsets, index))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

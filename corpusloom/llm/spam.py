"""Keyword-stuffed and link-list pages by pointwise mutual information of neighbouring words.

A text is cut into windows of a line or about 32 words.  Two measures give a
few windows a first label: a collocation repeated beyond measure or a line of
links, tags or short separated phrases is *outside* sentences, a line with
sentence ends and few separators is *inside*.  Corpus counts of words and of
neighbouring words are then taken in both kinds, and each window gets two mean
pointwise mutual informations: that of its neighbours by the counts of
sentences and by those of what stands outside, both against the same shares of
words in the corpus.  Prose is coherent by the counts of sentences, word salad,
repeated collocations and lists only by the others: a window whose mean PMI is the
lower by the counts of sentences is outside.  Windows are labelled anew by that, counts are taken
again, and a document is a case if most of its words lie in windows outside.

The counts are exact sums over all documents, kept by the 64-bit hash of the
word and of both neighbours in a table.  Documents are cut into chunks of many
words; a chunk gives each of its words and pairs one row, the rows of all
chunks are summed by key, and each chunk gets the sums of its own keys back.
Nothing is collected or broadcast but three totals.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.scratch import Scratch

#: Words at which a chunk of documents ends: the bound of what a task holds at once.
CHUNK_WORDS = 1 << 21
#: Words of a window at which it is cut, and words that a line needs to be a window of its own.
WINDOW_WORDS, LINE_WORDS = 32, 8
#: Weight of the word alone in a neighbour's share, and the most that one neighbour may say.
BACKOFF, MOST = 5.0, 6.0
#: Documents of fewer words are never cases.
LEAST_WORDS = 8

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
#: A link with its scheme, or a host (in small letters): names joined by dots, the last of letters; a file's name looks the same and counts as one word too.
_URL = re.compile(r"(?:https?|ftp)://[^\s<>()\[\]|]+|www\.[^\s<>()\[\]|]+|(?<![\w.@/-])[a-z0-9][a-z0-9-]*\.(?:[a-z0-9][a-z0-9-]*\.)*[a-z]{2,}(?![\w@-])(?:/[^\s<>()\[\]|]*)?")
#: What every link holds; most texts hold none and are not searched for links.
_HINT = re.compile(r"\.[a-z]{2}|://")
_TAG = re.compile(r"#\w+")
_BREAK = re.compile(r"\r\n|[\r\n  ]|<br */?>")
_BULLET = re.compile(r"[\s>#*•»\-–—]*(?:\[\d+\]|\d+[.)](?=\s))?[\s*•»\-–—]*")
_IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿가-힯]")
_WORD = re.compile(r"\w+(?:[’'\-]\w+|[.,]\d+)*")
_WORD_OR_SIGN = re.compile("[぀-ヿ㐀-鿿가-힯]|[^\\W぀-ヿ㐀-鿿가-힯]+(?:[’'\\-][^\\W぀-ヿ㐀-鿿가-힯]+|[.,]\\d+)*")
_END = re.compile(r"[.!?。！？…][\"”’')\]]*(?:\s|$)|[。！？]")
_SEPARATORS = ",;|/•·~>、：，"
#: Stand-ins for whole links, tags, numbers and letter-spaced words.
LINK, TAG, NUMBER, SPACED = "xlinkx", "xtagx", "xnumberx", "xspacedx"


def words(line: str) -> list[str]:
    """The words of a line in lower case: a link, a tag and a number are one word each, an ideograph is one, and so is each letter of a word spelled with blanks between its letters."""
    found = (_WORD_OR_SIGN if _IDEOGRAPH.search(line) else _WORD).findall(line)
    out: list[str] = []
    letters = 0
    for w in found:
        if len(w) == 1 and (w == "_" or (w.isalpha() and not _IDEOGRAPH.match(w))):
            letters += 1
            out.append(w)
            continue
        if letters >= 4:
            _merge(out, letters)
        letters = 0
        out.append(NUMBER if w[0].isdigit() else w)
    if letters >= 4:
        _merge(out, letters)
    return out


def _merge(out: list[str], letters: int) -> None:
    n = letters - out[-letters:].count("_")
    del out[-letters:]
    out.extend([SPACED] * n)


def windows(text: str) -> list[tuple[list[str], str | None]]:
    """``(words, line)`` of each window; the line only where the window is the whole line."""
    text = text.lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if _HINT.search(text):
        text = _URL.sub(f" {LINK} ", text)
    if "#" in text:
        text = _TAG.sub(f" {TAG} ", text)
    out: list[tuple[list[str], str | None]] = []
    short: list[str] = []
    for line in _BREAK.split(text):
        line = line[_BULLET.match(line).end() :]
        found = words(line)
        if not found:
            continue
        if len(found) < LINE_WORDS:
            short = short + found
            if len(short) >= WINDOW_WORDS:
                out.append((short, None))
                short = []
            continue
        if short:
            out.append((short, None))
            short = []
        parts = max(1, round(len(found) / WINDOW_WORDS))
        step = -(-len(found) // parts)
        out += [(found[k : k + step], line if parts == 1 else None) for k in range(0, len(found), step)]
    if short:
        out.append((short, None))
    return out


def first_label(found: list[str], line: str | None) -> int:
    """1 outside sentences, 0 inside, -1 undecided."""
    n = len(found)
    if found.count(LINK) * 4 >= n or found.count(TAG) * 4 >= n:
        return 1
    if n < LINE_WORDS:
        return -1
    often = max(3, math.ceil(0.15 * n))
    # A pair that comes so often leaves at most so many different words.
    if len(set(found)) <= n - 2 * (often - 1) and max(Counter(x for x in zip(found, found[1:]) if NUMBER not in x).values(), default=0) >= often:
        return 1
    if line is None:
        return -1
    separators = sum(map(line.count, _SEPARATORS)) + line.count(" - ")
    ends = len(_END.findall(line))
    if separators * 4 >= n and ends * 12 <= n:
        return 1
    return 0 if ends and separators * 6 <= n else -1


def _cut(chunk_words: int):
    """Documents as rows of chunks: the windows of each document, their lengths and first labels, the hashes of the chunk's words and the words as places among these."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk = TaskContext.get().partitionId(), 0
        ids, of, lengths, labels, codes, known, kind = [], [], [], [], array("I"), {}, None

        def row() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known)).view(np.int64)
            packed = pa.compress(np.frombuffer(codes, np.uint32).tobytes(), "zstd", asbytes=True) if codes else b""
            values = [
                pa.array([task << 32 | chunk], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([of], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([labels], pa.list_(pa.int8())), pa.array([hashes], pa.list_(pa.int64())), pa.array([len(codes)], pa.int64()), pa.array([packed], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(values, ["chunk", "ids", "windows", "lengths", "labels", "hashes", "n", "codes"])

        for b in batches:
            kind = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = windows(t)
                ids.append(i)
                of.append(len(ws))
                for found, line in ws:
                    codes.extend([known.setdefault(w, len(known)) for w in found])
                    lengths.append(len(found))
                    labels.append(first_label(found, line))
                if len(codes) >= chunk_words:
                    yield row()
                    chunk += 1
                    ids, of, lengths, labels, codes, known = [], [], [], [], array("I"), {}
        if ids:
            yield row()

    return cut


class Chunk:
    """A row of ``_cut`` with its pairs numbered: ``w`` the words, ``of`` the window of each, ``at`` the words with a neighbour before them, ``pair`` the number of that pair."""

    def __init__(self, t: pa.Table | pa.RecordBatch, k: int = 0):
        cell = {c: t.column(c)[k] for c in t.schema.names}
        flat = lambda c: cell[c].values.to_numpy(zero_copy_only=False)
        n = cell["n"].as_py()
        self.chunk, self.ids = cell["chunk"].as_py(), cell["ids"].values
        self.lengths, self.first, self.hashes = flat("lengths").astype(np.int64), flat("labels").astype(np.int64), flat("hashes")
        self.w = np.frombuffer(pa.decompress(cell["codes"].as_py(), n * 4, "zstd", asbytes=True), np.uint32).astype(np.int64) if n else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.document = np.repeat(np.arange(len(self.ids)), flat("windows"))
        self.at = np.nonzero(self.of[1:] == self.of[:-1])[0] + 1
        size = max(1, len(self.hashes))
        different, self.pair = np.unique(self.w[self.at - 1] * size + self.w[self.at], return_inverse=True)
        self.a, self.b = different // size, different % size

    def counts(self, label: np.ndarray) -> pa.RecordBatch:
        """A row a word (``b`` null) and pair of the chunk: its number in the chunk, its hashes, and how often it stands in windows inside and outside."""
        label = label[self.of]
        sums = [np.concatenate([np.bincount(self.w[label == k], minlength=len(self.hashes)), np.bincount(self.pair[label[self.at] == k], minlength=len(self.a))]) for k in (0, 1)]
        number = np.arange(len(self.hashes) + len(self.a))
        first = np.concatenate([self.hashes, self.hashes[self.a]])
        second = np.concatenate([np.zeros(len(self.hashes), np.int64), self.hashes[self.b]])
        columns = [pa.array(np.full(len(number), self.chunk)), pa.array(number, pa.int32()), pa.array(first), pa.array(second, mask=number < len(self.hashes)), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "number", "a", "b", "inside", "outside"])

    def labels(self, model: Model) -> np.ndarray:
        return (model.scores(self) < 0).astype(np.int64) if model.usable else self.first


class Model:
    """Pointwise mutual information of a chunk's neighbouring words by the corpus counts of windows inside sentences, outside, and both."""

    def __init__(self, c: Chunk, sums: pa.Table, totals: tuple[int, int, int]):
        size = len(c.hashes)
        number = sums.column("number").to_numpy()
        self.totals, different = [float(t) for t in totals[:2]], max(1, totals[2])
        self.usable = min(self.totals) > 0
        self.word, self.before, self.pair = [], [], []
        for name, t in zip(("inside", "outside"), self.totals):
            u = np.zeros(size + len(c.a))
            u[number] = sums.column(name).to_numpy()
            self.before.append(u[:size])
            self.pair.append(u[size:])
            self.word.append((u[:size] + 0.5) / (t + 0.5 * different))
        self.share = (self.before[0] + self.before[1] + 1.0) / (sum(self.totals) + different)

    def association(self, c: Chunk) -> np.ndarray:
        """Pointwise mutual information in bits of each word and the one before it over the whole corpus; 0 where there is none before."""
        out = np.zeros(len(c.w))
        both, single = self.pair[0] + self.pair[1], np.maximum(self.before[0] + self.before[1], 1.0)
        out[c.at] = np.log2(np.maximum(both[c.pair], 1.0) * max(1.0, sum(self.totals)) / (single[c.w[c.at - 1]] * single[c.w[c.at]]))
        return out

    def pmi(self, c: Chunk, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """``log p(word | word before) / p(word)`` of each pair, and ``log p(word) / p(word)`` of each word that has none before: the former share by the counts inside (0) or outside (1), the latter that of the corpus."""
        given = (self.pair[kind] + BACKOFF * self.word[kind][c.b]) / (self.before[kind][c.a] + BACKOFF)
        return np.log(given / self.share[c.b]), np.log(self.word[kind] / self.share)

    def scores(self, c: Chunk) -> np.ndarray:
        """The mean PMI of each window by the counts inside, less that by the counts outside; one pair says ``MOST`` at most."""
        inside, outside = self.pmi(c, 0), self.pmi(c, 1)
        difference = (inside[1] - outside[1])[c.w]
        difference[c.at] = np.clip(inside[0] - outside[0], -MOST, MOST)[c.pair]
        return np.bincount(c.of, difference, len(c.lengths)) / np.maximum(1, c.lengths)


_COUNTS = "chunk long, number int, a long, b long, inside long, outside long"


def _first_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            c = Chunk(b, k)
            yield c.counts(c.first)


def _summed(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple[int, int, int]]:
    """The corpus counts of the words and pairs of every chunk, and the words inside, outside and different ones in either."""
    same = Window.partitionBy("a", "b")
    sums = counts.select("chunk", "number", "b", F.sum("inside").over(same).alias("inside"), F.sum("outside").over(same).alias("outside"), F.min("chunk").over(same).alias("least"))
    once = F.col("b").isNull() & (F.col("chunk") == F.col("least"))
    seen = Observation()
    sums = sums.observe(
        seen,
        F.sum(F.when(once, F.col("inside"))).alias("inside"),
        F.sum(F.when(once, F.col("outside"))).alias("outside"),
        F.count_if(once & (F.col("inside") + F.col("outside") > 0)).alias("different"),
    )
    saved = scratch.save(sums.select("chunk", "number", "inside", "outside"), "counts")
    return saved, tuple(seen.get[k] or 0 for k in ("inside", "outside", "different"))


def page_shares(df: DataFrame, record_id: str, text: str, scratch: Scratch, rounds: int = 2, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``(id, words, outside, mean_pmi)`` of every row: its words, those in windows outside sentences, and the mean PMI of its neighbouring words in bits.

    The mean over all counts does not tell the kinds apart (lists of known
    phrases reach that of prose), which is why windows are judged by the
    difference of their mean PMI by the counts of either kind.
    Null, empty and blank texts have no words.  Rows keep their number.  Where
    the corpus gives no window of one kind a first label, first labels count and
    undecided windows are inside.  ``chunk_words`` bounds memory, the result does not depend on it.
    """
    rows = df.select(F.col(record_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cut = scratch.save(rows.mapInArrow(_cut(chunk_words), f"chunk long, ids array<{kind}>, windows array<int>, lengths array<int>, labels array<tinyint>, hashes array<long>, n long, codes binary"), "cut")

    def judged(f, schema: str) -> DataFrame:
        sums, totals = known

        def of_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
            c = Chunk(left)
            return pa.Table.from_batches([f(c, Model(c, right, totals))])

        return cut.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(of_chunk, schema)

    def share(c: Chunk, model: Model) -> pa.RecordBatch:
        outside = c.labels(model) == 1
        n = len(c.ids)
        words_, out = (np.bincount(c.document, x, n).astype(np.int64) for x in (c.lengths, c.lengths * outside))
        of_word = c.document[c.of]
        pmi = np.bincount(of_word, model.association(c), n) / np.maximum(1, np.bincount(of_word[c.at], minlength=n))
        return pa.RecordBatch.from_arrays([c.ids, pa.array(words_), pa.array(out), pa.array(np.round(pmi, 4))], ["id", "words", "outside", "mean_pmi"])

    known = _summed(cut.mapInArrow(_first_counts, _COUNTS), scratch)
    for _ in range(rounds - 1):
        known = _summed(judged(lambda c, model: c.counts(c.labels(model)), _COUNTS), scratch)
    return judged(share, f"id {kind}, words long, outside long, mean_pmi double")


def stuffed_pages(df: DataFrame, record_id: str, text: str, scratch: Scratch) -> DataFrame:
    """``(id)`` of the documents of ``LEAST_WORDS`` words or more, most of which stand outside sentences."""
    return page_shares(df, record_id, text, scratch).where((F.col("words") >= LEAST_WORDS) & (2 * F.col("outside") > F.col("words"))).select("id")

"""Encoding of a corpus with a public byte-level BPE vocabulary by tree concatenation.

A text longer than a leaf is halved at any character until its parts are
leaves; the leaves are encoded on their own and joined pair by pair.  Around a
join a window is cut and encoded again: it begins at the last cut of the left
part that stays whatever follows, and grows to the right until a cut of it is
also one of the right part.  What lies before and behind is kept from the parts.
Where the window holds one long unsplit run, the ids of its two halves are
joined in the same way: the ids next to the join are encoded again, more and
more of them, until both ends agree with what the halves have there.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that goes with the vocabulary byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the module regex, whose white space is another set than the tokenizer's.
_CUTS = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: Characters of a leaf; of the first window to the right of a join; of an unsplit run from which its halves' ids are joined instead of encoding it again.
LEAF_CHARS, WINDOW_CHARS, RUN_CHARS = 2048, 16, 128
_CODECS: dict[str, "Codec"] = {}

#: A part of a text and its ids.
Part = tuple[str, list[int]]


class Codec:
    """The tokenizer of one worker process."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = [0] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        #: Joins done, and the most characters or ids that one of them looked at.
        self.joins, self.widest = 0, 0

    def plain(self, text: str) -> list[int]:
        """The ids of a whole text in one call; strings that look like special tokens are ordinary text."""
        return self.encoding.encode_ordinary(text)

    def ids(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        """The same ids by the tree."""
        return tree([(t, self.plain(t)) for t in halves(text, leaf_chars)], self)[1]

    def run(self, raw: bytes) -> list[int]:
        """The ids of bytes that the pattern doesn't cut."""
        return self.encoding._encode_single_piece(raw)

    def bytes_of(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def spanned(self, ids: Iterator[int], length: int) -> int:
        """How many of the first ``ids`` make up ``length`` bytes."""
        n = 0
        while length > 0:
            length -= self.size[next(ids)]
            n += 1
        return n


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def vocabulary(name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> str:
    return f"{tokenizer_dir}/{name}.tiktoken"


def halves(text: str, leaf_chars: int) -> list[str]:
    """``text`` halved until no part is longer than ``leaf_chars``."""
    if len(text) <= max(1, leaf_chars):
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf_chars) + halves(text[mid:], leaf_chars)


def settled(text: str) -> int:
    """The last cut of the pattern in ``text`` that stays a cut whatever follows.

    A blank before something visible always begins a token.  From there on a
    cut stays if the match before it didn't look at the end: no match looks
    further than one character beyond the one that follows it.
    """
    at = len(text) - 1
    while (at := text.rfind(" ", 0, at)) > 0 and text[at + 1].isspace():
        pass
    at = max(0, at)
    for m in _CUTS.finditer(text, at):
        if m.end() + 2 > len(text):
            break
        at = m.end()
    return at


def join(left: Part, right: Part, c: Codec) -> Part:
    """The ids of two neighbouring parts as the ids of the whole; what the parts hold must be the ids of their own texts."""
    if not left[0] or not right[0]:
        return left if left[0] else right
    tail = left[0][settled(left[0]) :]
    width = WINDOW_CHARS
    while True:
        head = right[0][:width]
        last = width >= len(right[0])
        window = tail + head
        own = {m.end() for m in _CUTS.finditer(head) if last or m.end() + 2 <= len(head)} | {0}
        cuts = [m.end() for m in _CUTS.finditer(window)]
        agree = next((k for k, e in enumerate(cuts) if e - len(tail) in own and (last or e + 2 <= len(window))), None)
        if agree is not None:
            break
        width *= 2
    c.joins += 1
    c.widest = max(c.widest, len(tail) + min(width, len(right[0])))
    over = cuts[agree] - len(tail)
    before = c.spanned(reversed(left[1]), len(tail.encode()))
    after = c.spanned(iter(right[1]), len(head[:over].encode()))
    out = left[1][: len(left[1]) - before]
    start = 0
    for end in cuts[: agree + 1]:
        if end - start > RUN_CHARS and start < len(tail) < end and _one_run(tail[start:]) and _one_run(head[: end - len(tail)]):
            a = c.spanned(reversed(left[1]), len(tail[start:].encode()))
            b = c.spanned(iter(right[1]), len(head[: end - len(tail)].encode()))
            out += join_run(left[1][len(left[1]) - a :], right[1][:b], c)
        else:
            out += c.run(window[start:end].encode())
        start = end
    return left[0] + right[0], out + right[1][after:]


def _one_run(text: str) -> bool:
    return _CUTS.match(text).end() == len(text)


def join_run(left: list[int], right: list[int], c: Codec, window: int = 4) -> list[int]:
    """The ids of two neighbouring parts of one unsplit run as the ids of the whole.

    The last and first ``window`` ids around the join are encoded again; if the
    new ids begin and end with the ids that the parts have there, every pair of
    neighbours in the result also stands in a proper encoding, which makes the
    result one.  Otherwise the window doubles, up to the whole of both parts.
    """
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        again = c.run(c.bytes_of(left[a:] + right[:b]))
        c.widest = max(c.widest, len(left) - a + b)
        if (a == 0 or again[0] == left[a]) and (b == len(right) or again[-1] == right[b - 1]):
            return left[:a] + again + right[b:]
        window *= 2


def tree(parts: Sequence[Part], c: Codec) -> Part:
    """Neighbours joined pair by pair, level by level."""
    while len(parts) > 1:
        parts = [join(parts[k], parts[k + 1], c) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _lists(found: list[list[int]]) -> pa.ListArray:
    ends = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))))


def encode(df: DataFrame, keep: Sequence[str], text: str, path: str | None = None, count_only: bool = False, long_chars: int = 65_536, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``keep`` and ``ids``, the ids of every text, or their number ``size``; null and empty texts have an empty list, or 0.

    Rows keep their number: repeated and null keys each have their row; the kept
    columns may have any names but ``text``'s stand-ins ``__text`` and ``__row``.  Every text
    is encoded by the tree.  The parts of a text of up to ``long_chars`` are
    encoded and joined where the text is read, without a shuffle; those of a
    longer one are spread over the tasks and joined by one.
    """
    path = path or vocabulary()
    rows = df.select(*keep, F.col(text).alias("__text"))
    n, names = len(keep), list(keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    schema = kinds + ("size long" if count_only else "ids array<int>")

    def out(columns: list, found: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in found], pa.int64()) if count_only else _lists(found)], [*names, "size" if count_only else "ids"])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield out(b.columns[:n], [c.ids(t, leaf_chars) if t else [] for t in b.column(n).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(n).to_pylist()):
                parts = halves(t, long_chars // 4)
                at = pa.array([i] * len(parts), pa.int32())
                yield pa.RecordBatch.from_arrays([*(x.take(at) for x in b.columns[:n]), pa.array(parts), b.column(n + 1).take(at), pa.array(range(len(parts)), pa.int32())], [*names, "__text", "__row", "leaf"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _lists([c.ids(t, leaf_chars) for t in b.column(n).to_pylist()])], [*names, "__text", "__row", "leaf", "part"])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("leaf")
        ids = tree(list(zip(table["__text"].to_pylist(), table["part"].to_pylist())), codec(path))[1]
        return pa.Table.from_batches([out([table[k].combine_chunks().slice(0, 1) for k in names], [ids])])

    size = F.coalesce(F.length("__text"), F.lit(0))
    long = rows.where(size > long_chars).withColumn("__row", F.monotonically_increasing_id())  # only keeps repeated keys apart
    leaf = kinds + "`__text` string, `__row` long, leaf int"
    spread = long.mapInArrow(cut, leaf).repartition("__row", "leaf").mapInArrow(each, leaf + ", part array<int>")
    return rows.where(size <= long_chars).mapInArrow(here, schema).unionByName(spread.groupBy("__row").applyInArrow(whole, schema))

"""Held-out evaluation texts inside training documents.

The held-out items are few and do not grow with the corpus: their normalised word n-grams form a hash set
that is broadcast, in blocks of at most ``block_items`` items, so that its size is bounded whatever the
number of items. Each document is scanned once, window by window, against the set; a document with enough
hits of an item is verified by aligning the words of both. The bound on hits is exact: the length of the
grams is chosen per item, so that a passage of half of it with one word in eight altered keeps at least
one gram, and usually many, intact; items of very few words are searched by single words.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.visual import _ALIKE, _IGNORABLE

_TAG = regex.compile(r"</?[A-Za-z][^<>\n]{0,300}>|<!--.*?-->", regex.DOTALL)
_DROP = re.compile(r"[^\w\s]+|_+")
_ALIKE_LETTER = re.compile("[" + "".join(map(chr, _ALIKE)) + "]")
_SCANNED = 4_000_000  # letters that are looked up at once
_ENTITY = regex.compile(r"&(?:[A-Za-z]{2,8}|#\d{1,7}|#x[0-9A-Fa-f]{1,6});")


def plain_words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup, layout and look-alike characters.

    Words are parted by white space and tags only: ``kernel.go`` and ``kernelgo`` are the same word.
    """
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text))
    for _ in range(2):  # escaped markup may have been escaped again
        if not _ENTITY.search(text):
            break
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text))
        text = _ALIKE_LETTER.sub(lambda m: _ALIKE[ord(m[0])], text)
    return _DROP.sub("", text.casefold()).split()


def _fewest_hits(length: int, n: int, share: float, altered: int) -> int:
    """The least number of intact n-grams in a passage of at least ``share`` of an item; 0 or less if none is sure."""
    shortest = max(1, math.ceil(length * share))
    return min(k - (n - 1) - n * (k // altered) for k in range(shortest, length + 1))


def gram_width(length: int, n: int, share: float, altered: int) -> tuple[int, int]:
    """The longest grams, up to ``n`` words, of which a passage is sure to keep one, and how many it keeps."""
    for width in range(min(n, length), 1, -1):
        fewest = _fewest_hits(length, width, share, altered)
        if fewest >= 1:
            return width, fewest
    return 1, max(1, _fewest_hits(length, 1, share, altered))


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two word lists."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, word = best[i], best[i + 1], a[i]
        right = 0
        for j in range(m - 1, -1, -1):
            right = below[j + 1] + 1 if word == b[j] else (below[j] if below[j] >= right else right)
            row[j] = right
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def longest_passage(item: list[str], words: list[str], altered: int = 8) -> tuple[int, int, int]:
    """``(length in the item, first word, last word)`` of the longest passage of ``item`` in ``words``.

    Of the passage, on either side, at most one word in ``altered`` is not matched in order.
    """
    found = _common(item, words)
    best = (0, 0, 0)
    for a in range(len(found)):
        for b in range(len(found) - 1, a - 1, -1):
            span = found[b][0] - found[a][0] + 1
            if span <= best[0]:
                break
            if (b - a + 1) * altered >= (altered - 1) * max(span, found[b][1] - found[a][1] + 1):
                best = (span, found[a][1], found[b][1])
                break
    return best


class _Index:
    """Word n-grams of the held-out items with their items and positions.

    Words of the items are numbered; a document becomes an array of numbers, and all its grams are looked up
    at once by a hash, which is then checked against the gram itself.
    """

    def __init__(self, items: list[tuple[int, list[str]]], n: int, share: float, altered: int) -> None:
        self.share, self.altered = share, altered
        self.items = {i: w for i, w in items if w}
        self.numbers: dict[str, int] = {}
        self.fewest: dict[int, int] = {}
        grams: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        for i, words in self.items.items():
            numbered = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
            width, self.fewest[i] = gram_width(len(words), n, share, altered)
            for k in range(len(words) - width + 1):
                grams.setdefault(width, {}).setdefault(tuple(numbered[k : k + width]), []).append((i, k))
        self.grams = grams
        self.hashes = {width: np.sort(self._hash(np.array(list(table), dtype=np.uint64).T)) for width, table in grams.items()}

    @staticmethod
    def _hash(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        for column in columns:
            out = (out ^ (column + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def hits(self, texts: Sequence[list[str]]) -> list[dict[int, dict[int, set[int]]]]:
        """Per text the grams found: item to place in the text to places in the item. All texts are looked up at once."""
        ends = np.cumsum([len(words) + 1 for words in texts])
        # a word that no item has parts the texts
        numbered = np.array([*map(self.numbers.get, chain.from_iterable((*words, None) for words in texts), repeat(-1))], dtype=np.int64)
        sure = numbered >= 0
        out: list[dict[int, dict[int, set[int]]]] = [{} for _ in texts]
        for width, table in self.grams.items():
            size = len(numbered) - width + 1
            if size < 1:
                continue
            run = sure[:size].copy()
            for s in range(1, width):
                run &= sure[s : s + size]
            places = np.flatnonzero(run)
            if not len(places):
                continue
            hashed = self._hash([numbered[places + s].astype(np.uint64) for s in range(width)])
            known = self.hashes[width]
            at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
            found = places[known[at] == hashed]
            for k, text in zip(found.tolist(), np.searchsorted(ends, found, side="right").tolist(), strict=True):
                first = int(ends[text]) - len(texts[text]) - 1
                for item, place in table.get(tuple(numbered[k : k + width].tolist()), ()):
                    out[text].setdefault(item, {}).setdefault(k - first, set()).add(place)
        return out

    def search(self, words: list[str], hits: dict[int, dict[int, set[int]]]) -> list[tuple[int, int, int, float]]:
        """``(item, first word, last word, share of the item)`` of every item that ``words`` give away."""
        out = []
        for item, places in hits.items():
            wanted = self.items[item]
            length = len(wanted)
            if len(set().union(*places.values())) < self.fewest[item]:
                continue
            # hits far apart belong to different passages
            order = sorted(places)
            groups = [[order[0]]]
            for k in order[1:]:
                if k - groups[-1][-1] <= length:
                    groups[-1].append(k)
                else:
                    groups.append([k])
            best = (0, 0, 0)
            for group in groups:
                if len(set().union(*(places[k] for k in group))) < self.fewest[item]:
                    continue
                first = group[0] - min(places[group[0]])
                if first >= 0 and words[first : first + length] == wanted:
                    best = (length, first, first + length - 1)
                    break
                # windows overlap by more than a passage can be long
                for start in range(group[0], group[-1] + 1, 3 * length):
                    end = min(start + 3 * length, group[-1])
                    low, high = max(0, start - 2 * length), end + 2 * length
                    span, first, last = longest_passage(wanted, words[low:high], self.altered)
                    if span > best[0]:
                        best = (span, low + first, low + last)
            # altered words at the ends of a passage are not seen, hence the allowance
            if best[0] >= self.share * length * (self.altered - 1) / self.altered:
                out.append((item, best[1], best[2], best[0] / length))
        return out


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 5,
    share: float = 0.5,
    altered: int = 8,
    block_items: int = 20_000,
) -> DataFrame:
    """Documents with the held-out items they contain, wholly or in part.

    Result: ``doc_id``, ``item_id``, ``first_word``, ``last_word`` (of the longest passage, in words of the
    document) and ``share`` of the item's words it spans. A document leaks an item if it contains, in order,
    at least ``share`` of its words with at most one in ``altered`` changed.

    Defined cases: null ids and texts, and items without any word, give no rows; short items are
    searched by shorter grams, see :func:`gram_width`; repeated documents and items count once; whole texts are searched,
    whatever their length; other columns are ignored.
    """
    spark = docs.sparkSession
    held_out = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, first_word int, last_word int, share double"
    found: DataFrame | None = None
    # a block of items at a time: what is broadcast never exceeds a block
    reader = held_out.toLocalIterator()
    while True:
        block = [r for _, r in zip(range(block_items), reader, strict=False)]
        if not block and found is not None:
            break
        shared = spark.sparkContext.broadcast([(r["item_id"], plain_words(r["text"])) for r in block])

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = _Index(shared.value, n, share, altered)
            for batch in batches:
                rows = []
                bodies = list(dict.fromkeys(batch["text"]))
                known: dict[str, list] = {}
                while bodies:
                    texts, words = [], []
                    letters = 0
                    while bodies and letters < _SCANNED:
                        texts.append(bodies.pop())
                        words.append(plain_words(texts[-1]))
                        letters += len(texts[-1])
                    known.update({t: index.search(w, h) for t, w, h in zip(texts, words, index.hits(words), strict=True)})
                for doc, body in zip(batch["doc_id"], batch["text"], strict=True):
                    rows.extend((doc, *hit) for hit in known[body])
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "last_word", "share"])

        part = corpus.mapInPandas(scan, schema)
        found = part if found is None else found.unionByName(part)
        if len(block) < block_items:
            break
    best = F.max(F.struct("share", "first_word", "last_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.first_word", "b.last_word", "b.share")


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that give nothing away."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")

"""Evaluation texts leaking into training text: a BM25 index of the held-out items, queried by every passage.

Terms are five-word shingles.  The corpus is read once, whatever the number of
items: a scan keeps the places of each text where enough terms stand in a row,
these few are sent to the blocks of the index that hold their terms, and there
each passage is a query by block-max WAND.  What it retrieves is verified on
the words.
"""
from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.lookup import salted_lookup
from loomgrid.sources.staging import stage

SHINGLE = 5
PASSAGE = 64  # words; passages overlap by one word less than a stretch, so each stretch lies in one as a whole
K1, B = 1.2, 0.75

# Tags that may stand inside a word; all others part words.
_INLINE_TAG = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u|wbr)\b[^<>]{0,300}>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,300}>")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_BROKEN_WORD = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]")


def normal_words(text: str | None) -> list[str]:
    """Words without case, punctuation, layout, markup and variants of characters."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
        if not text.isascii():
            text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def unbroken(text: str | None) -> str | None:
    """The text with words joined that a hyphen parts at the end of a line; None if there are none."""
    if not text or not _BROKEN_WORD.search(text):
        return None
    return _BROKEN_WORD.sub("", text)


def term(words: list[str]) -> int:
    """A shingle as a signed number of 64 bits."""
    h = xxhash.xxh64_intdigest(" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def terms_of(words: list[str]) -> list[int]:
    return [term(words[p : p + SHINGLE]) for p in range(len(words) - SHINGLE + 1)]


@dataclass
class Postings:
    """The items of a term in order, what it adds to each, and the largest addition of each block of them."""

    items: list[int]
    impacts: list[float]
    tops: list[float]
    best: float


@dataclass
class LeakIndex:
    """Inverted index over items, read by block-max WAND.

    What a term adds to an item is its BM25 impact over the item's threshold,
    the least score of a passage that holds one whole stretch of it: the least
    sum of impacts over ``stretch - 4`` terms in a row.  So all items have the
    same threshold of 1, and none with a stretch in the passage is missed.
    """

    stretch: int = 8
    share: float = 1 / 3
    block: int = 64
    ids: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # term -> (item, position)
    postings: dict[int, Postings] = field(default_factory=dict)
    scored: int = 0  # items whose full score was summed, for tests

    @classmethod
    def build(cls, items: list[tuple[int, list[str]]], **kw) -> LeakIndex:
        """``items``: id and normal words; an item of fewer than ``stretch`` words cannot be held."""
        self = cls(**kw)
        rows = [(i, terms_of(w), len(w)) for i, w in sorted(items, key=lambda x: x[0]) if len(w) >= self.stretch]
        for n, (item_id, grams, length) in enumerate(rows):
            self.ids.append(item_id)
            self.lengths.append(length)
            for p, g in enumerate(grams):
                self.places.setdefault(g, []).append((n, p))
        average = sum(self.lengths) / max(len(self.lengths), 1)
        frequency = {g: Counter(n for n, _ in where) for g, where in self.places.items()}
        idf = {g: math.log(1 + (len(rows) - len(f) + 0.5) / (len(f) + 0.5)) for g, f in frequency.items()}

        def impact(g: int, n: int) -> float:
            tf = frequency[g][n]
            return idf[g] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.lengths[n] / average))

        run = self.stretch - SHINGLE + 1
        least = [min(sum(impact(g, n) for g in set(grams[p : p + run])) for p in range(len(grams) - run + 1)) for n, (_, grams, _) in enumerate(rows)]
        for g, f in frequency.items():
            holders = sorted(f)
            impacts = [impact(g, n) / least[n] for n in holders]
            tops = [max(impacts[i : i + self.block]) for i in range(0, len(impacts), self.block)]
            self.postings[g] = Postings(holders, impacts, tops, max(tops))
        return self

    def retrieve(self, query: list[int], threshold: float = 1 - 1e-9) -> list[int]:
        """All items whose score reaches the threshold, by block-max WAND.

        A cursor runs through the postings of each term.  The pivot is the first
        item up to which the terms' best impacts could reach the threshold; if
        the largest impacts of the blocks around it cannot, all cursors before
        it leave their blocks without a look inside.
        """
        lists = [self.postings[g] for g in query if g in self.postings]
        at, block, found = [0] * len(lists), self.block, []
        live = list(range(len(lists)))
        while live:
            live.sort(key=lambda i: lists[i].items[at[i]])
            bound, last = 0.0, -1
            for k, i in enumerate(live):
                bound += lists[i].best
                if bound >= threshold:
                    last = k
                    break
            if last < 0:
                break
            pivot = lists[live[last]].items[at[live[last]]]
            while last + 1 < len(live) and lists[live[last + 1]].items[at[live[last + 1]]] == pivot:
                last += 1
            # where the pivot would stand in each list up to it
            spots = [bisect_left(lists[i].items, pivot, at[i]) for i in live[: last + 1]]
            tops = sum(lists[i].tops[s // block] for i, s in zip(live, spots) if s < len(lists[i].items))
            if tops < threshold:
                # no item up to the end of the nearest block can reach it
                ends = [lists[i].items[min((s // block + 1) * block, len(lists[i].items)) - 1] + 1 for i, s in zip(live, spots) if s < len(lists[i].items)]
                target = max(min(ends, default=pivot + 1), pivot + 1)
                if last + 1 < len(live):
                    target = min(target, lists[live[last + 1]].items[at[live[last + 1]]])
                moved = live[: last + 1]
            else:
                self.scored += 1
                score = sum(lists[i].impacts[s] for i, s in zip(live, spots) if s < len(lists[i].items) and lists[i].items[s] == pivot)
                if score >= threshold:
                    found.append(pivot)
                target, moved = pivot + 1, live[: last + 1]
            for i in moved:
                at[i] = bisect_left(lists[i].items, target, at[i])
            live = [i for i in live if at[i] < len(lists[i].items)]
        return found

    def candidates(self, matches: list[tuple[int, int]]) -> set[int]:
        """Items retrieved by any passage of a text, given the places of its terms."""
        step = PASSAGE - self.stretch + 1
        passages: dict[int, dict[int, None]] = defaultdict(dict)
        for p, g in matches:
            for k in range(max(0, -(-(p + SHINGLE - PASSAGE) // step)), p // step + 1):
                passages[k][g] = None
        return {n for q in passages.values() if len(q) > 0 for n in self.retrieve(list(q))}

    def covered(self, matches: list[tuple[int, int]], chosen: set[int]) -> dict[int, int]:
        """Words of each chosen item in unbroken stretches of at least ``stretch`` words."""
        diagonals: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, g in matches:
            for n, q in self.places.get(g, ()):
                if n in chosen:
                    diagonals[n, p - q].append(q)
        marked: dict[int, set[int]] = defaultdict(set)
        for (n, _), at in diagonals.items():
            start = last = at[0]
            for q in [*at[1:], None]:
                if q is not None and q == last + 1:
                    last = q
                    continue
                if last - start + SHINGLE >= self.stretch:
                    marked[n].update(range(start, last + SHINGLE))
                if q is not None:
                    start = last = q
        return {n: len(s) for n, s in marked.items()}

    def held(self, matches: list[tuple[int, int]]) -> dict[int, float]:
        """Item ids of which a text holds enough, with the share held."""
        chosen = self.candidates(matches)
        words = self.covered(matches, chosen) if chosen else {}
        return {self.ids[n]: w / self.lengths[n] for n, w in words.items() if w >= self.share * self.lengths[n] - 1e-9}


class TermFilter:
    """Tells texts that may hold a stretch of an item from those that cannot; never says no to one that does.

    Of the items' words and terms it keeps sets while they are of a bounded
    size; beyond it, words are not looked at and terms are kept in a Bloom
    filter of fixed size.
    """

    def __init__(self, words: frozenset[str] | None, terms: np.ndarray | None, bloom: np.ndarray | None, stretch: int):
        self.words, self.terms, self.bloom, self.stretch = words, terms, bloom, stretch

    @staticmethod
    def bits(terms: np.ndarray, size: int) -> np.ndarray:
        h = terms.view(np.uint64)
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        return np.stack([(low + np.uint64(i) * high) % np.uint64(size) for i in range(4)])

    def known(self, terms: np.ndarray) -> np.ndarray:
        if self.terms is not None:
            if not len(self.terms):
                return np.zeros(len(terms), dtype=bool)
            return self.terms[np.minimum(self.terms.searchsorted(terms), len(self.terms) - 1)] == terms
        at = self.bits(terms, len(self.bloom) * 8)
        return ((self.bloom[at // 8] >> (at % 8).astype(np.uint8)) & 1).all(axis=0)

    def matches(self, words: list[str]) -> list[tuple[int, int]]:
        """Places of terms, of those parts of the text where a whole stretch of them stands in a row."""
        runs, start = [], 0
        if self.words is None:
            runs = [(0, len(words))]
        else:
            have, start = self.words, None
            for p, w in enumerate(words):
                if w in have:
                    if start is None:
                        start = p
                elif start is not None:
                    runs.append((start, p))
                    start = None
            if start is not None:
                runs.append((start, len(words)))
        out = []
        need = self.stretch - SHINGLE + 1
        for a, b in runs:
            if b - a < self.stretch:
                continue
            grams = np.array(terms_of(words[a:b]), dtype=np.int64)
            hit = np.flatnonzero(self.known(grams))
            if len(hit) < need:
                continue
            cuts = np.flatnonzero(np.diff(hit) > 1) + 1
            for part in np.split(hit, cuts):
                if len(part) >= need:
                    out += [(a + int(p), int(grams[p])) for p in part]
        return out


def leaks_of(text: str | None, index: LeakIndex, known: TermFilter) -> dict[int, float]:
    """Items of which the text holds enough, as the operator finds them."""
    found: dict[int, float] = {}
    for version in versions(text):
        for i, s in index.held(known.matches(version)).items():
            found[i] = max(found.get(i, 0.0), s)
    return found


def versions(text: str | None) -> list[list[str]]:
    """The normal words of the text, and those with words joined that were parted at line ends."""
    joined = unbroken(text)
    return [normal_words(text)] + ([normal_words(joined)] if joined is not None else [])


def filter_of(items: list[list[str]], stretch: int = 8) -> TermFilter:
    grams = sorted({g for w in items if len(w) >= stretch for g in terms_of(w)})
    return TermFilter(frozenset(x for w in items for x in w), np.array(grams, dtype=np.int64), None, stretch)


def _filter(indexed: DataFrame, stretch: int, most: int, bloom_bytes: int) -> TermFilter:
    """The filter over all items; sets of up to ``most`` words and terms come to the driver, more go through it into a Bloom filter."""
    words = indexed.select(F.explode("words").alias("w")).distinct()
    terms = indexed.select(F.explode("terms").alias("t")).distinct()
    vocabulary = frozenset(r["w"] for r in words.collect()) if words.count() <= most else None
    if terms.count() <= most:
        return TermFilter(vocabulary, np.array(sorted(r["t"] for r in terms.collect()), dtype=np.int64), None, stretch)
    bloom = np.zeros(bloom_bytes, dtype=np.uint8)
    batch: list[int] = []

    def put() -> None:
        at = TermFilter.bits(np.array(batch, dtype=np.int64), bloom_bytes * 8)
        np.bitwise_or.at(bloom, at // 8, (1 << (at % 8)).astype(np.uint8))
        batch.clear()

    for r in terms.toLocalIterator():
        batch.append(r["t"])
        if len(batch) == 100_000:
            put()
    put()
    return TermFilter(vocabulary, None, bloom, stretch)


def leaked_items(documents: DataFrame, items: DataFrame, stretch: int = 8, share: float = 1 / 3, block_items: int = 2_000, most: int = 1_000_000, bloom_bytes: int = 1 << 26, per_task: int = 20_000) -> DataFrame:
    """``doc_id, item_id, held``: documents that hold a part of an item, and the share of its words.

    ``documents``: ``doc_id, text``; ``items``: ``item_id, text``.  Each text is
    read once and to its end.  NULL and empty texts hold nothing; an item of
    fewer than ``stretch`` words cannot be held.  Equal items are each reported,
    equal documents too.  No items: no rows.

    The index is cut into blocks of about ``block_items`` items.  A text goes to
    the blocks that hold one of the terms it kept; a block that gets more than
    ``per_task`` texts is searched by several tasks.  ``most`` and
    ``bloom_bytes`` bound what is sent to the workers and change no result.
    """
    spark = documents.sparkSession
    id_type = dict(documents.dtypes)["doc_id"]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [normal_words(t) for t in batch["text"]]
            kept = [i for i, w in enumerate(words) if len(w) >= stretch]
            yield pd.DataFrame({"item_id": batch["item_id"].iloc[kept], "words": [words[i] for i in kept], "terms": [terms_of(words[i]) for i in kept]})

    usable = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    indexed = stage(usable.mapInPandas(index, "item_id bigint, words array<string>, terms array<bigint>"), "items")
    blocks = max(1, -(-indexed.count() // block_items))
    indexed = indexed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    known = spark.sparkContext.broadcast(_filter(indexed, stretch, most, bloom_bytes))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = known.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                both = [m for m in map(look.matches, versions(text)) if m]
                if both:
                    rows.append((doc, [[p for p, _ in m] for m in both], [[g for _, g in m] for m in both]))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "places", "terms"])

    matched = documents.select("doc_id", "text").mapInPandas(scan, f"doc_id {id_type}, places array<array<int>>, terms array<array<bigint>>")
    matched = stage(matched.withColumn("row", F.monotonically_increasing_id()), "matched")
    if blocks == 1:
        routed = matched.withColumn("block", F.lit(0))
    else:
        homes = indexed.select(F.explode("terms").alias("term"), "block").distinct()
        asked = matched.select("row", F.explode(F.array_distinct(F.flatten("terms"))).alias("term"))
        routed = matched.join(salted_lookup(asked, homes, "term", "row", how="inner").select("row", "block").distinct(), "row")
    load = routed.groupBy("block").agg(F.ceil(F.count("*") / per_task).cast("int").alias("tasks"))
    # a column of its own, as the other side of the cogroup has one of the same origin
    own = indexed.join(load, "block").select((F.col("block") + 0).alias("block"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "item_id", "words")
    routed = routed.join(load, "block").withColumn("task", F.pmod(F.xxhash64("row"), F.col("tasks")).cast("int")).drop("tasks")

    def search(texts: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(texts) and len(held):
            found = LeakIndex.build([(i, list(w)) for i, w in zip(held["item_id"], held["words"])], stretch=stretch, share=share)
            for doc, places, grams in zip(texts["doc_id"], texts["places"], texts["terms"]):
                best: dict[int, float] = {}
                for p, g in zip(places, grams):
                    for item, part in found.held([(int(a), int(b)) for a, b in zip(p, g)]).items():
                        best[item] = max(best.get(item, 0.0), part)
                rows += [(doc, item, part) for item, part in best.items()]
        out = pd.DataFrame(rows, columns=["doc_id", "item_id", "held"])
        return out if rows else out.astype({"item_id": "int64", "held": float})

    return routed.groupBy("block", "task").cogroup(own.groupBy("block", "task")).applyInPandas(search, f"doc_id {id_type}, item_id bigint, held double")

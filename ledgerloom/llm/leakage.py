"""Evaluation texts leaking into documents: one Aho-Corasick automaton over the items, one scan of every text.

Items and texts are compared as letters and digits only, in lower case and without accents, so case, punctuation, line
breaks, hyphenation and spacing do not matter. The automaton holds every run of ``WORDS`` words of every item. Its hits
in a text are joined to blocks (runs of an item found unbroken), and blocks in the item's order to a passage, which may
be interrupted. A document leaks an item if the passage holds more than half of the item's words.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 3
#: Share of an item's words beyond which a passage is a leak.
SHARE = 0.5
#: Letters and digits that may interrupt a passage between two blocks.
GAP = 1200
#: A block counts if it has this many words, or a run of words that at most ``DISTINCT_ITEMS`` items have.
LONG_BLOCK, DISTINCT_ITEMS = 5, 2
#: Letters of item text in one automaton; larger item sets are scanned for in several passes. An automaton takes about 140
#: bytes a letter (measured: 2.4 million letters, 328 MB), so one takes at most 280 MB in each Python worker.
MAX_CHARS = 2 << 20
SCHEMA = "doc_id bigint, item_id bigint, share double, start int, end int"
_NOT_WORD = re.compile(r"[\W_]+")


def words(text: str) -> list[str]:
    plain = text if text.isascii() else unicodedata.normalize("NFKD", re.sub("[­​-‏⁠﻿]", "", text))
    if not plain.isascii():
        plain = "".join(c for c in plain if not unicodedata.combining(c))
    return [w for w in _NOT_WORD.split(plain.lower()) if w]


def flat(text: str) -> str:
    return "".join(words(text))


def original_offsets(text: str) -> list[int]:
    """For each character of ``flat(text)`` its offset in ``text``."""
    return [i for i, c in enumerate(text) for _ in flat(c)]


_WORKERS: dict[str, "Automaton"] = {}


def worker_automaton(token: str, shared) -> "Automaton":
    """The automaton of a broadcast block of items, built once in each Python worker."""
    if token not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[token] = Automaton(shared.value)
    return _WORKERS[token]


class Automaton:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        same: dict[str, list[int]] = defaultdict(list)  # items of one wording are one pattern set
        split: dict[str, list[str]] = {}
        for item_id, text in items:
            w = words(text or "")
            if w:
                same["".join(w)].append(item_id)
                split["".join(w)] = w
        self.ids, self.size = list(same.values()), [len(split[t]) for t in same]
        runs: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, text in enumerate(same):
            w = split[text]
            for k in range(max(1, len(w) - WORDS + 1)):
                runs["".join(w[k:k + WORDS])].append((n, k))
        self.machine = ahocorasick.Automaton()
        for run, at in runs.items():
            self.machine.add_word(run, (len(run), len({n for n, _ in at}), at))
        if runs:
            self.machine.make_automaton()
        self.empty = not runs

    def leaks(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item number, share, start, end in the flat text) of every item of which more than ``SHARE`` is found."""
        found = defaultdict(list)
        for end, (length, items, at) in self.machine.iter(text):
            for n, k in at:
                found[n].append((end + 1 - length, end + 1, k, items))
        out, stretches = [], None
        for n, hits in found.items():
            width, least = min(WORDS, self.size[n]), SHARE * self.size[n]
            # No passage holds more than the words that any hit covers.
            if width * len(hits) > least and len({i for _, _, k, _ in hits for i in range(k, k + width)}) > least:
                blocks = self._blocks(hits, width)
                share, start, end = self._passage(blocks, self.size[n])
                if share > SHARE and len(hits) + WORDS - 1 <= least:  # in several pieces
                    if stretches is None:
                        stretches = [(m, b) for m, h in found.items() for b in self._blocks(h, min(WORDS, self.size[m])) if b[3] - b[2] > LONG_BLOCK]
                    share, start, end = self._passage(self._own(n, blocks, stretches), self.size[n])
                if share > SHARE:
                    out.append((n, share, start, end))
        return out

    @staticmethod
    def _own(n: int, blocks: list[list[int]], stretches: list[tuple[int, list[int]]]) -> list[list[int]]:
        """Blocks without the short ones that are a phrase of another item's wording: a stretch at least ``LONG_BLOCK`` words
        longer that holds no other block of item n. They belong to what interrupts the passage, not to it."""
        others = [f for m, f in stretches if m != n]
        inside = lambda b, f: f[0] <= b[0] and b[1] <= f[1]
        words_of = lambda b: b[3] - b[2]
        return [b for b in blocks if words_of(b) >= LONG_BLOCK or not any(
            inside(b, f) and words_of(f) >= words_of(b) + LONG_BLOCK and not any(a is not b and a[0] < f[1] and a[1] > f[0] for a in blocks)
            for f in others)]

    @staticmethod
    def _blocks(hits: list[tuple[int, int, int, int]], width: int) -> list[list[int]]:
        hits.sort()
        blocks: list[list[int]] = []  # start, end, first word, word after the last, rarest run's items
        growing: dict[int, list[int]] = {}
        for start, end, k, items in hits:
            block = growing.get(k - 1)
            if block is not None and block[0] < start < block[1]:
                block[1], block[3], block[4] = end, k + width, min(block[4], items)
            else:
                block = [start, end, k, k + width, items]
                blocks.append(block)
            growing[k] = block
        return blocks

    @staticmethod
    def _passage(blocks: list[list[int]], size: int) -> tuple[float, int, int]:
        blocks = sorted(b for b in blocks if b[3] - b[2] >= LONG_BLOCK or b[4] <= DISTINCT_ITEMS)
        best: list[tuple[int, int]] = []  # words held, start
        top, low = (0, 0, 0), 0
        for j, b in enumerate(blocks):
            held = (b[3] - b[2], b[0])
            while blocks[low][0] + size * 64 + GAP < b[0]:
                low += 1
            for i in range(low, j):
                a = blocks[i]
                if a[0] < b[0] and a[2] < b[2] and a[3] < b[3] and b[0] - a[1] <= GAP:
                    more = best[i][0] + b[3] - max(b[2], a[3])
                    if more > held[0]:
                        held = (more, best[i][1])
            best.append(held)
            top = max(top, (held[0], -held[1], b[1]))
        return top[0] / size, -top[1], top[2]


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, share, start, end)``: every document and item of which more than half is found as a passage.

    ``start`` and ``end`` are offsets in the original text. Null or empty texts and items hold and leak nothing; items of
    equal wording are all reported; repeated documents count once per id with the largest share. Texts are scanned whole
    where they lie, without a shuffle; the item set is broadcast in blocks of about ``MAX_CHARS`` letters, each a pass over the
    documents, so its size is bounded whatever the number of items.
    """
    wanted = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-chars // MAX_CHARS))
    out = None
    for b in range(passes):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == b) if passes > 1 else wanted
        shared = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.distinct().collect()])

        def scan(frames: Iterator[pd.DataFrame], shared=shared, token=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            automaton = worker_automaton(token, shared)
            for df in frames:
                rows = []
                for doc_id, text in zip(df["doc_id"], df["text"]):
                    if automaton.empty or not text:
                        continue
                    leaks = automaton.leaks(flat(text))
                    if leaks:
                        at = original_offsets(text)
                        rows += [(doc_id, i, share, at[start], at[min(end, len(at)) - 1] + 1)
                                 for n, share, start, end in leaks for i in automaton.ids[n]]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

        texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        part = texts.mapInPandas(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("share", F.col("start"), F.col("end"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")

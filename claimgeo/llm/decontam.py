"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of ``e`` edits is cut into ``e + 1`` pieces:
an occurrence within the budget leaves one piece untouched, so exact piece
hits lose no occurrence. All pieces are searched at once in each whole text;
every hit's surroundings are verified with Myers' bit-parallel distance. The
test items are a stated query set: they go to the tasks in blocks of bounded
size, one pass over the documents per block, and nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, texts

WORD = re.compile(r"\w+")
EDIT_RATE = 0.08
ITEMS_PER_BLOCK = 20_000


def normal(text: str) -> str:
    """Lower-case words joined by single spaces."""
    return " ".join(WORD.findall(text.lower()))


def budget(length: int, rate: float) -> int:
    return int(length * rate + 1e-9)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces (offset, piece) that cover the item,
    of lengths that differ by one at most."""
    n = min(errors + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern_bits: dict[str, int], m: int, text: str, errors: int) -> tuple[int, int] | None:
    """Best ``(distance, end)`` of a pattern of ``m`` symbols anywhere in
    ``text``, at most ``errors`` edits, the first end among equals; None if
    there is none. One column per symbol, all rows of it at once in the bits
    of an integer (Myers 1999, as simplified by Hyyrö)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, left = full, 0, m, None, len(text)
    limit = errors
    for at, c in enumerate(text, 1):
        left -= 1
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= limit:
            best, limit = (score, at), score - 1
            if not score:
                break
        elif score - left > limit:
            break
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
    return best


def symbol_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


class Matcher:
    """A block of test items, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normal(text)
            if not t:
                continue
            errors = budget(len(t), rate)
            for offset, piece in pieces(t, errors):
                hits.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, t, errors, symbol_bits(t), symbol_bits(t[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        if hits:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``(item_id, distance, budget, start, end)`` for each item found in
        ``text``: its best occurrence, offsets in the normalised text."""
        if not self.items:
            return []
        t = normal(text)
        begins: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(t):
            for item, offset in where:
                begins.setdefault(item, set()).add(end + 1 - length - offset)
        found = []
        for item, at in begins.items():
            item_id, pattern, errors, bits, reverse = self.items[item]
            m, best = len(pattern), None
            for lo, hi in _windows(sorted(at), m, errors):
                lo, limit = max(0, lo), errors if best is None else best[0] - 1
                if limit < 0:
                    break
                hit = myers(bits, m, t[lo:hi], limit)
                if hit:
                    best = (hit[0], lo + hit[1])
            if best:
                distance, end = best
                back = myers(reverse, m, t[max(0, end - m - errors):end][::-1], distance)
                found.append((item_id, distance, errors, end - back[1], end))
        return found


def _windows(begins: list[int], m: int, errors: int):
    """Text windows that hold every occurrence whose start is within
    ``errors`` of one of ``begins``; windows that overlap are merged."""
    lo, hi = None, None
    for b in begins:
        a, z = b - errors, b + m + errors
        if hi is not None and a <= hi - m:
            hi = z
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, z
    if hi is not None:
        yield lo, hi


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", edit_rate: float = EDIT_RATE,
                 items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``(<id_col>, <item_col>, distance, budget, start, end)`` for every
    document row and test item such that the item occurs in the document
    within ``budget = floor(edit_rate * length)`` edits: the occurrence of
    least distance, the first among equals.

    Texts and items are compared as lower-case words joined by single spaces;
    ``start`` and ``end`` are offsets in that form. Null and empty documents
    match nothing, items that are null or hold no word match nothing. A row
    with a null id keeps its matches under a null id. Repeated document rows
    each match; repeated item rows (same id and text) count once, items with
    equal texts under different ids all match. Empty tables give an empty
    result. Other columns are ignored, whatever their names. Texts of any
    length are searched whole, in linear time.
    """
    spark = docs.sparkSession
    wanted = (items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("body"))
              .filter("body is not null").distinct())
    blocks = -(-wanted.count() // items_per_block)
    schema = pa.schema([(c, pa.int64()) for c in ("doc", "item", "distance", "budget", "start", "end")])
    ddl = "doc long, item long, distance long, budget long, start long, end long"
    source = docs.select(F.col(id_col).cast("long").alias("doc"), texts(docs, text_col).alias("body"))
    out = spark.createDataFrame([], ddl)
    for number in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == number)
        sent = spark.sparkContext.broadcast(tuple(sorted((r.item, r.body) for r in block.collect())))

        def run(batches, sent=sent):
            matcher = _matcher(sent.value, edit_rate)
            for b in batches:
                rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        for hit in matcher.find(t)]
                yield batch(dict(zip(schema.names, map(list, zip(*rows)))) if rows else dict.fromkeys(schema.names, []),
                            schema)

        out = out.unionByName(source.mapInArrow(run, ddl))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "distance", "budget", "start", "end")

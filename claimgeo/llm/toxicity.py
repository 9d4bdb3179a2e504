"""Toxicity by nearest labelled examples.

Labelled examples and documents are TF-IDF vectors over terms that the
labelled sample shows to go with toxic texts (words and their prefixes). Each
document's exact cosine neighbours come from a block-max inverted index of
the examples: blocks are visited by falling upper bound and the search stops
when no block left can reach the k-th best similarity. Distance-weighted
votes, shrunk towards the base rate, are the score; the neighbours are its
evidence.

Scale: the fit reads at most ``max_labelled`` labelled rows (documented
bound); terms, examples and index are bounded by it and by ``max_terms`` and
are the only things broadcast. Document frequencies count all documents.
Every document is tokenised whole, twice at most; no text is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, texts

WORD = re.compile(r"\w+")
PREFIXES = (6, 8)
MAX_LABELLED = 20_000
MAX_TERMS = 4096
MIN_SUPPORT = 4            # toxic examples a term must occur in
MIN_CHI2 = 28.0            # about one chance in ten million
NEIGHBOURS = 25
BLOCK = 64


def terms(text: str) -> Counter:
    """Term frequencies: lower-case words, and for longer ones their prefixes
    (marked by a trailing ``*``)."""
    out = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        out[word] += n
        for k in PREFIXES:
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True for the ids whose labels must not be learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """``(id, toxic)``: at most ``max_labelled`` labelled ids outside the
    held-out fold, in hash order of the id; an id with several labels is toxic
    if one of them is."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    ids = ids.filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
    return ids.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)


def informative_terms(sample: DataFrame, max_terms: int = MAX_TERMS, min_support: int = MIN_SUPPORT,
                      min_chi2: float = MIN_CHI2) -> list[str]:
    """Terms of the labelled texts ``(t, toxic)`` that go with toxic ones, by
    a one-sided chi-square over document counts, best first."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("pos", pa.int64())])

    def count(batches):
        n, pos = Counter(), Counter()
        for b in batches:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = terms(t)
                n.update(found.keys())
                if toxic:
                    pos.update(found.keys())
                if len(n) > 400_000:                      # bounded memory: Spark adds the parts up
                    yield batch({"term": list(n), "n": list(n.values()), "pos": [pos[k] for k in n]}, schema)
                    n, pos = Counter(), Counter()
        yield batch({"term": list(n), "n": list(n.values()), "pos": [pos[k] for k in n]}, schema)

    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    if not sizes.pos or sizes.pos == sizes.n:
        return []
    rate = sizes.pos / sizes.n
    counts = (sample.select("t", "toxic").mapInArrow(count, "term string, n long, pos long")
              .groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
    expected = F.col("n") * rate
    chi2 = (F.col("pos") - expected) ** 2 / expected / (1 - rate)
    best = (counts.filter((F.col("pos") >= min_support) & (F.col("pos") > expected))
            .withColumn("chi2", chi2).filter(F.col("chi2") >= min_chi2)
            .orderBy(F.desc("chi2"), "term").limit(max_terms))
    return [r.term for r in best.select("term").collect()]


def vectors(docs: DataFrame, wanted: list[str], id_col: str, text_col: str) -> DataFrame:
    """``(id, term_ids, tf)`` of every document over the wanted terms."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(wanted)})
    schema = pa.schema([("id", pa.int64()), ("term_ids", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def run(batches):
        number = sent.value
        for b in batches:
            ids, tfs = [], []
            for t in b.column(1).to_pylist():
                found = sorted((number[k], n) for k, n in terms(t).items() if k in number)
                ids.append([i for i, _ in found])
                tfs.append([n for _, n in found])
            yield batch({"id": b.column(0), "term_ids": ids, "tf": tfs}, schema)

    return (docs.select(F.col(id_col).cast("long").alias("id"), texts(docs, text_col).alias("t"))
            .mapInArrow(run, "id long, term_ids array<int>, tf array<int>"))


def weigh(term_ids, tf, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector over ``term_ids``."""
    w = (1 + np.log(np.asarray(tf, dtype=np.float64))) * idf[term_ids]
    return w / math.sqrt(float(w @ w))


@dataclass
class BlockMaxIndex:
    """Inverted index of unit vectors. Examples lie in blocks of ``BLOCK``;
    each term knows its greatest weight in every block."""

    ids: np.ndarray             # example number -> document id
    toxic: np.ndarray
    maxima: np.ndarray          # (terms, blocks) greatest weight
    begins: np.ndarray          # (terms, blocks + 1) postings of a term and block
    examples: np.ndarray        # postings: example number
    weights: np.ndarray         # postings: weight

    @classmethod
    def build(cls, rows: list[tuple[int, int, list[int], np.ndarray]], n_terms: int) -> BlockMaxIndex:
        """``rows``: (id, toxic, term ids, unit weights). Examples with the
        same main terms become neighbours, so that block bounds are tight."""
        rows = sorted(rows, key=lambda r: ([r[2][k] for k in np.argsort(-r[3], kind="stable")], r[0]))
        blocks = -(-len(rows) // BLOCK)
        where = np.concatenate([np.full(len(r[2]), e) for e, r in enumerate(rows)] or [np.zeros(0)]).astype(np.int32)
        term = np.concatenate([r[2] for r in rows] or [np.zeros(0)]).astype(np.int64)
        weight = np.concatenate([r[3] for r in rows] or [np.zeros(0)])
        order = np.lexsort((where, term))
        where, term, weight = where[order], term[order], weight[order]
        cell = term * blocks + where // BLOCK
        maxima = np.zeros(n_terms * blocks)
        np.maximum.at(maxima, cell, weight)
        edges = np.searchsorted(cell, np.arange(n_terms * blocks + 1))
        begins = np.empty((n_terms, blocks + 1), dtype=np.int64)
        if blocks:
            begins[:, :-1] = edges[:-1].reshape(n_terms, blocks)
            begins[:, -1] = edges[blocks::blocks]
        return cls(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64),
                   maxima.reshape(n_terms, blocks), begins, where, weight)

    def nearest(self, term_ids, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of greatest positive cosine (fewer if there are
        no more), and the cosines; earlier examples first among equals."""
        bound = weights @ self.maxima[term_ids]
        best_e, best_s, floor = np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best_e) == k and bound[b] < floor - 1e-9:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(term_ids, weights):
                lo, hi = self.begins[t, b], self.begins[t, b + 1]
                if lo < hi:
                    score[self.examples[lo:hi] - b * BLOCK] += w * self.weights[lo:hi]
            hit = np.flatnonzero(score > max(0.0, floor - 1e-9))
            best_e = np.concatenate([best_e, hit + b * BLOCK])
            best_s = np.concatenate([best_s, score[hit]])
            keep = np.lexsort((best_e, -np.round(best_s, 9)))[:k]
            best_e, best_s = best_e[keep], best_s[keep]
            if len(best_e) == k:
                floor = float(best_s.min())
        return best_e, best_s


def vote(similarity: np.ndarray, toxic: np.ndarray, base: float, prior_weight: float = 1.0) -> float:
    """Distance-weighted share of toxic neighbours, shrunk to the base rate."""
    w = similarity ** 2
    return float((w @ toxic + prior_weight * base) / (w.sum() + prior_weight))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", neighbours: int = NEIGHBOURS, max_labelled: int = MAX_LABELLED,
           max_terms: int = MAX_TERMS) -> DataFrame:
    """``(<id_col>, held_out, score, predicted, evidence)`` per row of ``docs``.

    ``score`` (0 to 1) estimates the probability of label 1, ``predicted`` is
    1 from 0.5 on, ``evidence`` lists the nearest labelled examples
    ``(example_id, cosine, toxic)``, at most five. Labels are learnt only
    from ids outside the held-out fold (``crc32(id) mod 5 <> 0``); only the
    text enters a score.

    A document without any informative term (also null and empty texts) gets
    the share of toxic examples among labelled texts without one. No usable
    labels, or labels of one class: every score is the smoothed base rate.
    Rows with a null id are scored, never learnt from, and count as not held
    out. Repeated rows are scored alike; texts of labelled ids that repeat
    count once each. Ties among neighbours go to a fixed order of the
    examples. Empty tables give an empty result; other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    chosen = cut(labelled_sample(labels, id_col, label_col, max_labelled))          # bounded by max_labelled
    lean = docs.select(F.col(id_col).cast("long").alias("id"), texts(docs, text_col).alias("t"))
    wanted = informative_terms(lean.join(F.broadcast(chosen), "id"), max_terms)
    every = cut(vectors(docs, wanted, id_col, text_col))
    total = every.count()
    idf = np.full(len(wanted), math.log(1 + total))
    for r in every.select(F.explode("term_ids").alias("term")).groupBy("term").count().collect():
        idf[r.term] = math.log((1 + total) / (1 + r["count"])) + 1e-6                # at most max_terms rows
    known = every.join(F.broadcast(chosen), "id")
    plain = known.filter(F.size("term_ids") == 0).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")).first()
    first = known.filter(F.size("term_ids") > 0).groupBy("id").agg(F.min(F.struct("term_ids", "tf", "toxic")).alias("x"))
    rows = [(r.id, r.toxic, list(r.term_ids), weigh(r.term_ids, r.tf, idf))         # at most max_labelled rows
            for r in first.select("id", "x.*").collect()]
    pos = sum(r[1] for r in rows)
    overall = (pos + (plain.pos or 0) + 0.5) / (len(rows) + plain.n + 5)
    without = ((plain.pos or 0) + 5 * overall) / (plain.n + 5)
    base = (pos + 5 * overall) / (len(rows) + 5)
    sent = spark.sparkContext.broadcast((BlockMaxIndex.build(rows, len(wanted)), idf))
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.struct(
        [("example_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))])

    def run(batches):
        index, weight = sent.value
        for b in batches:
            out, why = [], []
            for term_ids, tf in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not term_ids:
                    out.append(without)
                    why.append([])
                    continue
                near, cosine = index.nearest(term_ids, weigh(term_ids, tf, weight), neighbours)
                out.append(vote(np.clip(cosine, 0, 1), index.toxic[near], base))
                why.append([{"example_id": int(index.ids[e]), "cosine": round(float(c), 6), "toxic": int(index.toxic[e])}
                            for e, c in zip(near[:5], cosine[:5])])
            yield batch({"id": b.column(0), "score": out, "evidence": why}, schema)

    scored = every.mapInArrow(run, "id long, score double, "
                                   "evidence array<struct<example_id: long, cosine: double, toxic: int>>")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")

"""Quality classifier from weak labels (operator 4).

Overlapping heuristic labellers vote yes or no on each document, or abstain. Expectation-
maximisation over the counts of all vote patterns estimates how each labeller votes on
either class, the labels that are given among them. The posterior labels train a linear
scorer on hashed features, which then scores every document.

Two questions are asked the same way: is the text of low quality, is it toxic.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch
from ._words import ASCII_SPACE, LOWER_AZ, NOT_ALNUM, RUN, U64, Words, letters_upto, mix, slices, words_of

#: Features are hashed into so many cells.
BITS = 21
#: English insults, in three lexicons that overlap: each is a toxicity labeller. Fixed values.
INSULTS = (
    ("idiot", "moron", "stupid", "clown", "loser", "worthless"),
    ("scum", "trash", "loser", "clown", "worthless", "pathetic"),
    ("pathetic", "disgusting", "scum", "trash", "stupid", "idiot", "moron"),
)
#: Words by which a text is taken for English; the lexicons abstain on others. Fixed values.
ENGLISH = ("the", "and", "of", "that", "with", "this", "from", "are")
#: A lexicon or learned labeller says no to texts of so many words only.
NO_FROM_WORDS = 20
#: Votes: yes (bad), no, abstain. A pattern is a number with a base-3 digit per labeller.
ABSTAIN, NO, YES = 0, 1, 2
QUALITY_LABELLERS = ("odd words", "symbol bytes", "repeats", "few words", "one word", "given")
TOXIC_LABELLERS = ("insults a", "insults b", "insults c", "learned words", "learned stems", "given")
#: Where the labellers whose votes the sample teaches, and the given labels, stand among the toxicity labellers.
LEARNED_WORDS, LEARNED_STEMS, GIVEN_T = 3, 4, 5
GIVEN_Q = 5
#: Before anything is counted, given labels are taken to be right this often.
GIVEN_ACCURACY = 0.98
#: What is believed before counting weighs as much as this share of the documents.
BELIEF = 0.02
#: Stems are the first letters (bytes) of longer words, so many of them.
STEM_SIZES = range(4, 8)
#: Cells from here on are of stems that several words of a text share, the others of words and style.
STEM_CELLS = 1 << (BITS - 1)
#: So many different words share a stem at least; each size and number is a family of cells.
STEM_WORDS = (2, 3)
FAMILY_CELLS = STEM_CELLS // (len(STEM_SIZES) * len(STEM_WORDS))
FAMILIES = (0, *range(STEM_CELLS, (1 << BITS) + 1, FAMILY_CELLS))
#: Fitting is done on so many documents, with so many cells in all, at most: what one task holds.
SAMPLE, SAMPLE_CELLS = 20_000, 8_000_000
#: Shares of a text above which a quality labeller says yes, and below which no; for few words it is one minus the share of different words.
BAD = (0.25, 0.15, 0.2, 0.85, 0.2)
GOOD = (0.1, 0.08, 0.1, 0.7, 0.1)
#: The last two of these say something of texts of so many words only.
MANY_WORDS = 50


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(65 - BITS)).astype(np.int64)


def _word_cells(words: tuple[str, ...]) -> np.ndarray:
    return _cells(words_of(pa.array(words), NOT_ALNUM).hash)


def _stems(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of stems that two or three different longer words of a row begin with; a cell for either."""
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((w.hash, w.row))
    hashes, row = w.hash[order], w.row[order]
    one = order[np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))]
    rows, cells = [], []
    for size, long, h in letters_upto(w, one, STEM_SIZES):
        with np.errstate(over="ignore"):
            key, first, count = np.unique(mix(h + w.row[long].astype(U64) * RUN[40]), return_index=True, return_counts=True)
            for i, least in enumerate(STEM_WORDS):
                own = first[count >= least]
                rows.append(w.row[long][own])
                family = (size - STEM_SIZES.start) * len(STEM_WORDS) + i
                cells.append(STEM_CELLS + family * FAMILY_CELLS + (mix(h[own] * RUN[41]) % U64(FAMILY_CELLS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(cells)


def _shares(part: pa.RecordBatch, count: np.ndarray, distinct: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Five shares of each row: of odd words (in capitals, with two symbols at the end, or a lone symbol), of symbols among its
    bytes, of words that repeat the one before, of words that are not the first of their kind, of its most frequent word."""
    w = words_of(part.column("text"), ASCII_SPACE, LOWER_AZ)
    n, size = np.diff(w.first), w.end - w.start
    rows = len(n)
    if not len(w.hash):
        return np.full((5, rows), np.nan)
    last, before, begin, second = w.data[w.end - 1], w.data[np.maximum(w.end - 2, 0)], w.data[w.start], w.data[np.minimum(w.start + 1, len(w.data) - 1)]
    capital = lambda b: (b >= 65) & (b <= 90)
    odd = ((size > 2) & NOT_ALNUM[last] & NOT_ALNUM[before]) | ((size > 1) & capital(begin) & capital(second)) | ((size == 1) & NOT_ALNUM[last])
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    symbols = np.concatenate(([0], np.cumsum(NOT_ALNUM[w.data] & ~ASCII_SPACE[w.data])))
    of_row = lambda m: np.bincount(w.row, weights=m, minlength=rows)
    with np.errstate(invalid="ignore", divide="ignore"):
        few = np.where(count >= MANY_WORDS, 1 - distinct / count, np.nan)
        one = np.where(count >= MANY_WORDS, top / count, np.nan)
        return np.stack([of_row(odd) / n, (symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]) / of_row(size), of_row(same) / n, few, one])


class Features(NamedTuple):
    """Cells of a slice of rows: all rows' cells in a row, ascending in each, and where each row's begin; and the number of words and the votes of each row."""

    cells: np.ndarray
    first: np.ndarray
    words: np.ndarray  # different words and style cells of each row
    quality: np.ndarray
    toxic: np.ndarray


def _per_row(first: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many of each row's cells are marked."""
    upto = np.concatenate(([0], np.cumsum(marks)))
    return upto[first[1:]] - upto[first[:-1]]


def _marked(*cells: np.ndarray) -> np.ndarray:
    """For every cell, a bit for each of the given sets that holds it."""
    out = np.zeros(1 << BITS, np.uint8)
    for k, own in enumerate(cells):
        out[own] |= 1 << k
    return out


#: Bits of the cells of the lexicons' words, then of the English ones.
_KNOWN = _marked(*map(_word_cells, INSULTS), _word_cells(ENGLISH))
_ENGLISH_BIT = 1 << len(INSULTS)


def extract(part: pa.RecordBatch) -> Features:
    """Of each row: the cells of its distinct words, style and shared stems; its votes on quality and on toxicity but for learned and given."""
    rows = part.num_rows
    w = words_of(pc.utf8_lower(part.column("text")), NOT_ALNUM)
    count = np.diff(w.first)
    keys, times = np.unique((w.row << BITS) | _cells(w.hash), return_counts=True)
    first = np.searchsorted(keys, np.arange(rows + 1) << BITS)
    known = _KNOWN[keys & ((1 << BITS) - 1)]
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, keys >> BITS, times)
    share = _shares(part, count, np.diff(first), top)
    votes_q = np.full((rows, len(QUALITY_LABELLERS)), ABSTAIN)
    votes_t = np.full((rows, len(TOXIC_LABELLERS)), ABSTAIN)
    with np.errstate(invalid="ignore"):
        votes_q[:, :5][(share > np.array(BAD)[:, None]).T] = YES
        votes_q[:, :5][(share < np.array(GOOD)[:, None]).T] = NO
        style = np.minimum(np.nan_to_num(share * 10), 9).astype(np.int64)
    english = (count >= NO_FROM_WORDS) & (_per_row(first, known & _ENGLISH_BIT > 0) >= 2)
    for k in range(len(INSULTS)):
        votes_t[english, k] = NO
        votes_t[_per_row(first, known & (1 << k) > 0) > 0, k] = YES
    look = _cells(mix((np.arange(len(share))[:, None] * 16 + style + 1).astype(U64)))
    stem_row, stem_cell = _stems(w)
    keys = np.sort(np.concatenate((keys, ((np.arange(rows) << BITS) | look).ravel(), (stem_row << BITS) | stem_cell)))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    first = np.searchsorted(keys, np.arange(rows + 1) << BITS)
    cells = keys & ((1 << BITS) - 1)
    return Features(cells, first, _per_row(first, cells < STEM_CELLS), votes_q, votes_t)


def learned_votes(cells: np.ndarray, first: np.ndarray, words: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """Votes of the learned labellers: yes to two learned words, or a learned stem of as many words.

    No if there is none and the text isn't short; to single words, which few texts of a language
    with few labels share, only if it is English.
    """
    rows, cut = len(first) - 1, np.searchsorted(learned, STEM_CELLS)
    out = np.full((rows, 2), ABSTAIN)
    known = _marked(learned[:cut], learned[cut:])[cells]
    long = words >= NO_FROM_WORDS
    english = _per_row(first, _KNOWN[cells] & _ENGLISH_BIT > 0) >= 2
    for k, (taught, least, says_no) in enumerate(((cut, 2, long & english), (len(learned) - cut, 1, long))):
        if taught:
            n = _per_row(first, known & (1 << k) > 0)
            out[(n == 0) & says_no, k] = NO
            out[n >= least, k] = YES
    return out


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def believed(labellers: int, given: int | None) -> np.ndarray:
    """Chances that a vote is no and yes, by class and labeller, before anything is counted: yes to few of the good and to many of the bad."""
    chance = np.empty((2, labellers, 2))
    chance[0], chance[1] = (0.97, 0.03), (0.5, 0.5)
    if given is not None:
        chance[0, given], chance[1, given] = (GIVEN_ACCURACY, 1 - GIVEN_ACCURACY), (1 - GIVEN_ACCURACY, GIVEN_ACCURACY)
    return chance


def fit_labellers(counts: dict[int, int], labellers: int, prior: float, given: int | None = None, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """By expectation-maximisation over pattern counts: the posterior probability of yes for every pattern, and each labeller's estimated chances of no and yes.

    Every labeller has its own chances on either class, all of them estimated; what is
    ``believed`` beforehand weighs BELIEF of its votes. That a labeller abstains tells
    nothing, so that a class can't be, say, the texts of a language that some don't read.
    """
    patterns = np.array(list(product(range(3), repeat=labellers)))[:, ::-1]
    weight = np.array([counts.get(int(p), 0) for p in pattern_of(patterns)], float)
    belief = believed(labellers, given)
    chance, total = belief.copy(), weight.sum()
    for k in range(rounds):
        log = sum((patterns == v) @ np.log(chance[:, :, v - 1]).T for v in (NO, YES)).T + np.log([1 - prior, prior])[:, None]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if k == rounds - 1 or not total:
            break
        share = np.stack([weight * (1 - post), weight * post])
        votes = np.stack([share @ (patterns == v) for v in (NO, YES)], axis=2)
        chance = votes + belief * (BELIEF * votes.sum(axis=2, keepdims=True) + 1)
        chance /= chance.sum(axis=2, keepdims=True)
        prior = float(np.clip(share[1].sum() / total, 1e-4, 0.5))
    out = np.empty(len(patterns))
    out[pattern_of(patterns)] = post
    return out, chance


class Scorer(NamedTuple):
    """A linear scorer: the cells whose weights are not zero, their weights, and the bias."""

    cells: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.cells] = self.weights
        return out


def train_scorer(rows: list[np.ndarray], target: np.ndarray, passes: int = 3, rate: float = 0.1, sparse: float = 0.4) -> Scorer:
    """Logistic regression on sets of cells by per-coordinate gradient steps with an L1 pull to zero. State is held for the cells of the rows only."""
    used = np.flatnonzero(_counts(rows))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    z, n = np.zeros(len(used)), np.zeros(len(used))
    bias, order = 0.0, np.random.Generator(np.random.PCG64(7))
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            x = place[rows[i]]
            zx, nx = z[x], np.sqrt(n[x])
            w = -(zx - np.sign(zx) * sparse) * rate / (1 + nx) * (np.abs(zx) > sparse)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - target[i]
            step = (np.sqrt(n[x] + g * g) - nx) / rate
            z[x] += g - step * w
            n[x] += g * g
            bias -= 0.01 * g
    own = np.flatnonzero(np.abs(z) > sparse)
    weights = -(z[own] - np.sign(z[own]) * sparse) * rate / (1 + np.sqrt(n[own]))
    return Scorer(used[own], weights.astype(np.float32), bias)


def _first_of_kind(rows: list[np.ndarray], alike: float = 0.8) -> np.ndarray:
    """Whether each row is the first of its kind: no earlier such row shares so much of its cells, of those that all of a band's least hashes suggest or that are equal."""
    bands, each = 8, 8
    salts = (np.arange(1, bands * each + 1, dtype=U64) << U64(40))[:, None]
    seen, out = {}, np.ones(len(rows), bool)
    for i, x in enumerate(rows):
        least = np.full(bands * each, np.iinfo(np.uint64).max, U64)
        for lo in range(0, len(x), 1 << 14):
            least = np.minimum(least, mix(x[lo : lo + (1 << 14)].astype(U64)[None, :] + salts).min(axis=1))
        least = least.reshape(bands, each)
        keys = [(k, hash(band.tobytes())) for k, band in enumerate(least)]
        for j in sorted({j for key in keys for j in seen.get(key, ())}):
            both = len(np.intersect1d(x, rows[j], assume_unique=True))
            if both >= alike * (len(x) + len(rows[j]) - both):
                out[i] = False
                break
        else:
            for key in keys:
                seen.setdefault(key, []).append(i)
    return out


def learn_words(rows: list[np.ndarray], toxic: np.ndarray, precision: float = 0.95, chance: float = 0.5) -> np.ndarray:
    """Cells that stand in rows given as toxic, and hardly in others, more often than luck explains; ascending.

    Cells are judged by family. One must stand in so many different toxic rows that, were cells and labels
    unrelated, less than ``chance`` cells of the family would.
    """
    group = {v: [x for x, t in zip(rows, toxic, strict=True) if t == v] for v in (YES, NO)}
    group = {v: [x for x, first in zip(g, _first_of_kind(g), strict=True) if first] for v, g in group.items()}
    yes, no = _counts(group[YES]), _counts(group[NO])
    share = len(group[YES]) / max(1, len(group[YES]) + len(group[NO]))
    out = []
    for a, b in zip(FAMILIES[:-1], FAMILIES[1:], strict=True):
        least, own = 2, yes[a:b] + no[a:b]
        while least < 64 and (own >= least).sum() * share**least >= chance:
            least += 1
        out.append(a + np.flatnonzero((yes[a:b] >= least) & (yes[a:b] >= precision * own)))
    return np.concatenate(out)


def _slices_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's list as a view of the column's own memory."""
    out = []
    for chunk in column.chunks:
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """How many of the rows hold each cell."""
    out = np.zeros(1 << BITS, np.int32)
    for x in rows:
        out[x] += 1
    return out


def _given(labels: DataFrame, column: str, yes: int) -> Column:
    """The majority of the labels given for a document; abstains in a tie."""
    n = F.sum(F.when(F.col(column) == yes, 1).when(F.col(column) == 1 - yes, -1).otherwise(0))
    return F.when(n > 0, YES).when(n < 0, NO).otherwise(ABSTAIN)


def _votes(docs: DataFrame, learned: np.ndarray, scorers: list[Scorer] | None) -> DataFrame:
    """(doc_id, text_key, quality, toxic, score_q, score_t): patterns without given labels, and scores as log-odds of bad."""
    shared = docs.sparkSession.sparkContext.broadcast((learned, [tuple(x) for x in scorers or []]))

    def vote(batches):
        learned, scorers = shared.value
        scorers = [(Scorer(*x).dense(), x[2]) for x in scorers]
        for batch in batches:
            for part in slices(batch, "text"):
                own = extract(part)
                own.toxic[:, [LEARNED_WORDS, LEARNED_STEMS]] = learned_votes(own.cells, own.first, own.words, learned)
                # every row has cells, so none of the sums is of nothing
                scores = [np.add.reduceat(w[own.cells].astype(np.float64), own.first[:-1]) + b for w, b in scorers] or [np.zeros(part.num_rows)] * 2
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(pattern_of(own.quality)), pa.array(pattern_of(own.toxic)), *map(pa.array, scores)], ["doc_id", "text_key", "quality", "toxic", "score_q", "score_t"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(vote, "doc_id long, text_key long, quality long, toxic long, score_q double, score_t double")


def sample_table(docs: DataFrame, given: DataFrame, size: int, cells: int, store: Scratch) -> DataFrame:
    """The rows that scorers are fitted on, in the order of ``place``: labelled ones first, then by hash; ``size`` rows and ``cells`` cells at most, or one row.

    Each has all its cells. The same documents give the same rows however they are partitioned.
    """
    known = given.where(f"given_q <> {ABSTAIN} OR given_t <> {ABSTAIN}").withColumn("labelled", F.lit(1))
    keys = docs.where("doc_id IS NOT NULL").select("doc_id", "text_key").distinct()
    order = [F.col("labelled").desc_nulls_last(), F.xxhash64("doc_id", "text_key"), "doc_id", "text_key"]
    picked = keys.join(known, "doc_id", "left").orderBy(*order).limit(size)
    # numbered in one task: ``size`` rows of numbers
    picked = picked.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    picked = store.keep(picked.select("place", "doc_id", "text_key", F.coalesce("given_q", F.lit(ABSTAIN)).alias("given_q"), F.coalesce("given_t", F.lit(ABSTAIN)).alias("given_t")), "picked")
    names = ["place", "given_q", "given_t"]

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own = extract(part)
                lists = pa.ListArray.from_arrays(pa.array(own.first.astype(np.int32)), pa.array(own.cells.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(pattern_of(own.quality)), pa.array(pattern_of(own.toxic)), pa.array(own.words), lists], [*names, "quality", "toxic", "words", "cells"])

    # repeated rows go before they reach Python
    own = docs.join(F.broadcast(picked), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    kept = store.keep(own.select("text", *names).mapInArrow(features, "place int, given_q int, given_t int, quality long, toxic long, words long, cells array<int>"), "features")
    upto = kept.select("place", F.sum(F.size("cells").cast("long")).over(Window.orderBy("place")).alias("upto"))
    last = upto.where((F.col("upto") <= cells) | (F.col("place") == 1)).agg(F.max("place")).first()[0]
    return kept.where(F.col("place") <= (last or 0))


class Sample(NamedTuple):
    """The sample in the task that fits on it, by place."""

    rows: list[np.ndarray]
    given_q: np.ndarray
    given_t: np.ndarray
    quality: np.ndarray
    toxic: np.ndarray
    words: np.ndarray


def _sampled(batches) -> Sample | None:
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    if table is None or not table.num_rows:
        return None
    order = np.argsort(table.column("place").to_numpy())
    rows = _slices_of(table.column("cells"))
    return Sample([rows[i] for i in order], *(table.column(c).to_numpy()[order] for c in ("given_q", "given_t", "quality", "toxic", "words")))


def learn_from(sample: DataFrame) -> np.ndarray:
    """``learn_words`` on the sample, in one task; the learned cells come to the driver."""

    def learn(batches):
        own = _sampled(batches)
        cells = learn_words(own.rows, own.given_t) if own else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64())], ["cell"])

    return np.sort(sample.coalesce(1).mapInArrow(learn, "cell long").toArrow().column("cell").to_numpy())


def train_on(sample: DataFrame, learned: np.ndarray, posts: list[np.ndarray]) -> list[Scorer]:
    """Scorers for quality and for toxicity, each trained in a task; weights that are not zero come to the driver."""
    shared = sample.sparkSession.sparkContext.broadcast((learned, posts))

    def trained(question: int):
        def train(batches):
            learned, posts = shared.value
            own = _sampled(batches)
            if own is None:
                return
            if question:
                said = learned_votes(np.concatenate(own.rows), np.concatenate(([0], np.cumsum([len(x) for x in own.rows]))), own.words, learned)
                pattern = own.toxic + said[:, 0] * 3**LEARNED_WORDS + said[:, 1] * 3**LEARNED_STEMS + own.given_t * 3**GIVEN_T
            else:
                pattern = own.quality + own.given_q * 3**GIVEN_Q
            made = train_scorer(own.rows, posts[question][pattern])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(made.cells, -1)), pa.array(np.append(made.weights.astype(np.float64), made.bias))], ["cell", "weight"])

        return train

    out = []
    for question in (0, 1):
        rows = sample.coalesce(1).mapInArrow(trained(question), "cell long, weight double").toArrow()
        cells, weights = rows.column("cell").to_numpy(), rows.column("weight").to_numpy()
        own = np.argsort(cells)
        own = own[cells[own] >= 0]
        out.append(Scorer(cells[own], weights[own].astype(np.float32), float(weights[cells < 0].sum())))
    return out


def fit(docs: DataFrame, given: DataFrame, size: int, cells: int, store: Scratch) -> tuple[np.ndarray, list[np.ndarray], list[Scorer], list[np.ndarray]]:
    """The learned cells, the posteriors of all patterns, the scorers, and the labellers' chances, each for quality then toxicity."""
    sample = sample_table(docs, given, size, cells, store)
    learned = learn_from(sample)
    votes = store.keep(with_given(_votes(docs, learned, None).select("doc_id", "quality", "toxic"), given).select("quality", "toxic"), "votes")
    posts, chances = [], []
    for column, labellers, prior, at in (("quality", len(QUALITY_LABELLERS), 0.2, GIVEN_Q), ("toxic", len(TOXIC_LABELLERS), 0.1, GIVEN_T)):
        # a row for each pattern: 3 ** labellers at most
        counts = {r[column]: r["count"] for r in votes.groupBy(column).count().collect()}
        post, chance = fit_labellers(counts, labellers, prior, at)
        posts.append(post)
        chances.append(chance)
    scorers = train_on(sample, learned, posts)
    store.drop("votes", "picked", "features")
    return learned, posts, scorers, chances


def with_given(votes: DataFrame, given: DataFrame) -> DataFrame:
    """Patterns with the given labels in them."""
    joined = votes.join(given, "doc_id", "left")
    return joined.withColumns({"quality": F.col("quality") + F.coalesce("given_q", F.lit(ABSTAIN)) * 3**GIVEN_Q, "toxic": F.col("toxic") + F.coalesce("given_t", F.lit(ABSTAIN)) * 3**GIVEN_T})


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cells: int = SAMPLE_CELLS) -> DataFrame:
    """Score every document and decide which to keep.

    ``docs`` needs doc_id and text, ``labels`` doc_id, quality (1 good, 0 bad) and toxic (1, 0), for some
    documents; other columns of either are ignored and not returned. A document with several labels has the majority's. The scorers are
    fitted on at most ``sample`` documents, labelled ones first, then by hash, as many as have ``cells`` features in all, each with all of its own;
    labeller statistics come from all documents. Returns a row per
    input row: doc_id, p_low_quality and p_toxic (the weak labels'
    posterior and the scorer's probability, averaged as log-odds; the posterior
    alone where a label is given), keep (both below a half), text_key. The same
    documents give the same result however they are partitioned.

    Null and empty texts give no evidence: heuristics abstain and the scorer's bias
    decides. Null labels abstain, null ids have no labels and are not fitted on. Repeated rows are scored
    alike and fitted on once. Very long texts are scored whole. Without labels the heuristics decide; an empty table gives an empty result.
    """
    store = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    given = store.keep(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(_given(labels, "quality", 0).alias("given_q"), _given(labels, "toxic", 1).alias("given_t")), "given")
    learned, (post_q, post_t), scorers, _ = fit(docs, given, sample, cells, store)
    store.release()
    scored = with_given(_votes(docs, learned, scorers), given)

    def chance(pattern: str, score: str, given: str, post: np.ndarray) -> Column:
        odds = np.clip(np.log(np.clip(post, 1e-9, 1) / np.clip(1 - post, 1e-9, 1)), -6, 6)
        own = F.element_at(F.array(*[F.lit(round(float(x), 6)) for x in odds]), (F.col(pattern) + 1).cast("int"))
        both = (own + F.least(F.greatest(F.col(score), F.lit(-6.0)), F.lit(6.0))) / 2
        return F.round(1 / (1 + F.exp(-F.when(F.col(given) > ABSTAIN, own).otherwise(both))), 6)

    out = scored.select("doc_id", "text_key", chance("quality", "score_q", "given_q", post_q).alias("p_low_quality"), chance("toxic", "score_t", "given_t", post_t).alias("p_toxic"))
    return out.select("doc_id", "p_low_quality", "p_toxic", ((F.col("p_low_quality") < 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"), "text_key")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cells: int = SAMPLE_CELLS) -> DataFrame:
    """The documents that ``classify`` keeps, with all their columns.

    Rows of one (doc_id, text) are scored alike, so all of them stay or none; null ids and null texts
    are compared as values. An empty table gives an empty result.
    """
    bad = classify(docs, labels, sample, cells).where("NOT keep").select(F.col("doc_id").cast("long").alias("__mr_id"), F.col("text_key").alias("__mr_key")).distinct()
    keyed = docs.withColumn("__mr_key", F.xxhash64("text"))
    return keyed.join(bad, keyed["__mr_key"].eqNullSafe(bad["__mr_key"]) & keyed["doc_id"].eqNullSafe(bad["__mr_id"]), "left_anti").drop("__mr_key")

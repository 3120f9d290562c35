"""N-gram Jaccard self-join (operator 5).

Texts are sets of word n-grams. Grams are put in one global order, rare first,
so that two texts that are similar enough share a gram within their short
prefixes. Texts meet on those prefix grams; length, positional and suffix
filters drop most pairs from counts alone, and each pair left is verified once
against the whole sets.

A pair is formed under the first gram of the order that both prefixes hold, and
nowhere else: what stands before it differs, and what follows is compared by
sketches of the two suffixes.

Groups of mutually similar texts do not become all their pairs. Under a shared
gram every text is first paired with one pivot, then with some others at random;
once the links found are components, only pairs across components are formed, and
of these, in the end, all: no link that could join two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bitmap import bitmap, in_bitmap
from ._graph import components
from ._skew import count_by, hot_keys, salted_join
from ._store import Scratch
from ._words import ASCII_SPACE, LOWER_AZ, U64, sets_of, shingles, slices, words_of

#: Gram frequencies are counted in 2**FREQ_BITS cells; the order needs no more than that.
FREQ_BITS = 20
#: The suffix filter compares this many cells, 64 to a long: whether each holds an odd number of a suffix's grams.
SKETCH_LONGS = 4
SKETCH = [f"sketch{k}" for k in range(SKETCH_LONGS)]
#: A row carries so many of its text's first shared grams, to tell under which one a pair is formed.
FIRSTS = 32
#: Rows of shared grams that a task makes at once, if a text has no more.
PLACES = 1 << 14
#: Rounds of looking for links between components; the last one tries all pairs.
ROUNDS = 3
#: Texts that meet at once in the other rounds.
BUCKET = 32
#: A list of texts to verify is broadcast up to so many, 16 bytes each; else it is joined.
BROADCAST_TEXTS = 1 << 20
#: Shared grams are told apart from most others by a bitmap of 2**BITMAP_BITS bits.
BITMAP_BITS = 25
#: In the last round the texts under a gram are dealt over tasks by so many.
BLOCK = 2048
_PART = 1 << 14


def _gram_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batch, "text"):
        words = words_of(part.column("text"), ASCII_SPACE, LOWER_AZ)
        yield part, sets_of(*shingles(words, n), part.num_rows)


def gram_frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Rows whose set holds a gram of each cell, over all rows: an array of 2**FREQ_BITS counts."""

    def count(batches):
        cells = np.zeros(1 << FREQ_BITS, np.int64)
        for batch in batches:
            for _, sets in _gram_sets(batch, n):
                cell, times = np.unique((np.concatenate(sets) >> U64(64 - FREQ_BITS)).astype(np.int64), return_counts=True)
                cells[cell] += times
        parts = cells.reshape(-1, _PART)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "lane": pa.array([int(cells.sum()) % 512] * len(parts), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(c.as_py(), np.int64) for c in table.column("counts")))
        return pa.Table.from_pydict({"part": table.column("part")[:1], "lane": table.column("lane")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, lane int, counts binary"
    each = docs.select("text").mapInArrow(count, schema)
    lanes = each.groupBy("part", "lane").applyInArrow(add, schema)
    rows = lanes.groupBy("part").applyInArrow(add, schema).collect()
    out = np.zeros((1 << FREQ_BITS) // _PART * _PART, np.int64).reshape(-1, _PART)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def _ceil_div(a, b):
    return -(-a // b)


def _bits(grams: np.ndarray) -> list[np.ndarray]:
    """For each long of a sketch, the bit that each gram has in it, if any; a sketch has the exclusive or of its grams."""
    cell = grams & U64(64 * SKETCH_LONGS - 1)
    bit = U64(1) << (cell & U64(63))
    return [np.where(cell >> U64(6) == k, bit, U64(0)) for k in range(SKETCH_LONGS)]


def features(docs: DataFrame, n: int, percent: int, order: np.ndarray) -> DataFrame:
    """Per row of (rid, doc_id, text): set size, sketch of the whole set (which cells hold an odd number of grams), and the prefix in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(order.astype(np.uint32))

    def extract(batches):
        rank = shared.value
        for batch in batches:
            for part, sets in _gram_sets(batch, n):
                sizes, prefixes, sketches = [], [], []
                for s in sets:
                    size = len(s)
                    keep = size - _ceil_div(percent * size, 100) + 1 if size else 0
                    cell = (s >> U64(64 - FREQ_BITS)).astype(np.int64)
                    place = (rank[cell].astype(U64) << U64(40)) | (s & U64((1 << 40) - 1))
                    prefixes.append(s[np.argsort(place, kind="stable")[:keep]].view(np.int64))
                    sketches.append([np.bitwise_xor.reduce(b) for b in _bits(s)])
                    sizes.append(size)
                at = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), pa.array(sizes, pa.int32()),
                     *[pa.array(np.array(sketches, U64)[:, k].view(np.int64)) for k in range(SKETCH_LONGS)],
                     pa.ListArray.from_arrays(at, pa.array(np.concatenate(prefixes)))],
                    ["rid", "doc_id", "n", *SKETCH, "prefix"],
                )

    return docs.select("rid", "doc_id", "text").mapInArrow(extract, f"rid long, doc_id long, n int, {', '.join(f'{c} long' for c in SKETCH)}, prefix array<long>")


def needed_overlap(a: Column, b: Column, percent: int) -> Column:
    """Least intersection size with 100 * intersection >= percent * union."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9)).cast("int")


def _by_places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with PLACES shared grams in all, or one text: each becomes a row with a list of FIRSTS grams."""
    upto, lo = batch.column("shared").offsets.to_numpy(), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PLACES, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _shared_rows(texts: DataFrame) -> DataFrame:
    """(gram, rid, n, i, sketches, firsts): a row for each prefix gram that three texts share, with the sketch of what follows it.

    ``texts`` has rid, n, the sketch of the whole set, prefix, and shared: the places of these grams. A
    suffix's sketch is the whole one without the grams up to its place.
    """

    def emit(batches):
        for batch in (part for whole in batches for part in _by_places(whole)):
            prefix, shared = batch.column("prefix"), batch.column("shared")
            grams, begin = prefix.flatten().to_numpy().view(U64), prefix.offsets.to_numpy() - prefix.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(shared.offsets.to_numpy()))
            place = shared.flatten().to_numpy()
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            at = begin[row] + place
            sketches = []
            for c, bits in zip(SKETCH, _bits(grams), strict=True):
                upto = np.concatenate(([U64(0)], np.bitwise_xor.accumulate(bits))) if len(bits) else np.zeros(1, U64)
                sketches.append(pa.array((upto[at + 1] ^ upto[begin[row]] ^ batch.column(c).to_numpy().view(U64)[row]).view(np.int64)))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            size = np.minimum(np.diff(first), FIRSTS)
            upto = np.concatenate(([0], np.cumsum(size)))
            which = np.arange(upto[-1]) - np.repeat(upto[:-1], size) + np.repeat(first[:-1], size)
            firsts = pa.ListArray.from_arrays(upto.astype(np.int32), pa.array(grams[at[which]].view(np.int64)))
            back = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), batch.column("rid").take(back), batch.column("n").take(back), pa.array(place.astype(np.int32)), *sketches, firsts.take(back)], ["gram", "rid", "n", "i", *SKETCH, "firsts"])

    return texts.select("rid", "n", *SKETCH, "prefix", "shared").mapInArrow(emit, f"gram long, rid long, n int, i int, {', '.join(f'{c} long' for c in SKETCH)}, firsts array<long>")


def _in_reach(x: str, y: str, percent: int) -> Column:
    """Length and positional filter for two rows of a gram.

    Of two texts, the one with fewer grams (the lesser rid if equal) meets within a shorter prefix still.
    """
    col = lambda side, c: F.col(side + c)
    na, ia, nb, ib = col(x, "n"), col(x, "i"), col(y, "n"), col(y, "i")
    short = lambda n, i: i < n - F.ceil(n * F.lit(2 * percent) / F.lit(100.0 + percent) - F.lit(1e-9)) + 1
    within = F.when((na < nb) | ((na == nb) & (col(x, "rid") < col(y, "rid"))), short(na, ia)).otherwise(short(nb, ib))
    length = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return length & (F.least(na - ia, nb - ib) >= needed_overlap(na, nb, percent)) & within


def _may_match(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filter for two rows of a gram, and whether it is the first that both texts have in their lists.

    At the first shared gram nothing before it is common, so the places themselves count
    as differences; a cell that is odd in one suffix only holds a gram that the other lacks. (A common gram
    that no third text has isn't in the lists; but then the pair has been formed under that gram.) Where neither
    list has a gram of the other, the pair is formed under every gram.
    """
    col = lambda side, c: F.col(side + c)
    na, ia, nb, ib = col(x, "n"), col(x, "i"), col(y, "n"), col(y, "i")
    may_lack = na + nb - 2 * needed_overlap(na, nb, percent)
    suffixes = sum((F.bit_count(col(x, c).bitwiseXOR(col(y, c))) for c in SKETCH), F.lit(0))
    common = F.array_intersect(col(x, "firsts"), col(y, "firsts"))
    first = F.when(F.size(common) > 0, F.element_at(common, 1) == F.col("gram"))
    return _in_reach(x, y, percent) & (suffixes <= may_lack) & F.coalesce(first, F.lit(True)) & (suffixes + F.when(first, ia + ib).otherwise(F.lit(0)) <= may_lack)


def _sets(docs: DataFrame, wanted: DataFrame, n: int, hot: DataFrame | None) -> DataFrame:
    """(rid, grams): the whole sets of the wanted texts, each once. A list of texts that is short is broadcast, so that others aren't moved."""

    def extract(batches):
        for batch in batches:
            for part, sets in _gram_sets(batch, n):
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).view(np.int64)))], ["rid", "grams"])

    if wanted.count() <= BROADCAST_TEXTS:
        own = docs.join(F.broadcast(wanted), "rid")
    else:
        own = salted_join(docs.select("rid", "doc_id", "text"), wanted, "rid", F.xxhash64("doc_id"), hot)
    return own.select("rid", "text").mapInArrow(extract, "rid long, grams array<long>").groupBy("rid").agg(F.first("grams").alias("grams"))


def _verify(pairs: DataFrame, docs: DataFrame, hot: DataFrame | None, n: int, percent: int, store: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) of rids whose whole sets are similar enough, as (u, v); the sets of a text that is in many pairs go to several tasks.

    ``hot`` tells which texts many documents have.
    """
    wanted = store.keep(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), f"wanted{name}")
    sets = store.keep(_sets(docs, wanted, n, hot), f"sets{name}")
    rows = pairs.count()
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("grams").alias(f"g{x}"))
    both = salted_join(pairs, side("a"), "a", F.xxhash64("b"), hot_keys(count_by(pairs, "a"), "a", rows))
    both = salted_join(both, side("b"), "b", F.xxhash64("a"), hot_keys(count_by(pairs, "b"), "b", rows))
    common = F.size(F.array_intersect("ga", "gb"))
    links = store.keep(both.where(100 * common >= percent * (F.size("ga") + F.size("gb") - common)).select(F.col("a").alias("u"), F.col("b").alias("v")), f"links{name}")
    store.drop(f"wanted{name}", f"sets{name}")
    return links


def _pairs_of_two(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) under grams that two texts share: length and positional filter, then the sketches of the whole sets."""
    of = F.struct("rid", "n", "i")
    two = rows.where("c = 2").groupBy("gram").agg(F.min(of).alias("x"), F.max(of).alias("y"))
    pairs = two.select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("rid", "n", "i")]).where(_in_reach("x_", "y_", percent))
    pairs = pairs.select(F.col("x_rid").alias("a"), F.col("y_rid").alias("b")).distinct()
    side = lambda k: texts.select(F.col("rid").alias(k), F.col("n").alias(f"n{k}"), *[F.col(c).alias(f"{k}_{c}") for c in SKETCH])
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH), F.lit(0))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(apart <= F.col("na") + F.col("nb") - 2 * needed_overlap(F.col("na"), F.col("nb"), percent)).select("a", "b")


def _by_gram(rows: DataFrame, grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows with what ``grams`` has of their gram; those of a gram that very many texts share are dealt over tasks. ``counts`` has gram and n."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return salted_join(rows, grams, "gram", F.xxhash64("rid"), hot_keys(counts, "gram", total))


def _mixed(rows: DataFrame, found: DataFrame, store: Scratch, name: str) -> DataFrame:
    """Rows of grams that texts of several components share, with root and c, the gram's texts."""
    rows = rows.join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    grams = rows.groupBy("gram").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    grams = store.keep(grams.select("gram", "c"), f"grams{name}")
    return _by_gram(rows, grams, grams.select("gram", F.col("c").alias("n")))


def _candidates(x: DataFrame, y: DataFrame, on: list[str], percent: int, once: Column) -> DataFrame:
    """Distinct pairs of different components that meet under a gram, in the direction that ``once`` says, and may be similar enough."""
    x = x.select(*on, *[F.col(c).alias(f"x_{c}") for c in ("rid", "n", "i", "root", "firsts", *SKETCH)])
    y = y.select(*on, *[F.col(c).alias(f"y_{c}") for c in ("rid", "n", "i", "root", "firsts", *SKETCH, *[c for c in y.columns if c == "main"])])
    met = x.join(y, on).where("x_root <> y_root").where(once).where(_may_match("x_", "y_", percent))
    return met.select(F.least("x_rid", "y_rid").alias("a"), F.greatest("x_rid", "y_rid").alias("b")).distinct()


def _some_across(rows: DataFrame, k: int, percent: int, store: Scratch) -> DataFrame:
    """Pairs within buckets of about BUCKET texts, dealt by the text, anew each round."""
    buckets = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("c") / F.lit(BUCKET), F.lit(1.0))))).cast("long")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("rid", F.lit(k)), buckets))
    return _candidates(rows, rows, ["gram", "bucket"], percent, F.col("x_rid") < F.col("y_rid"))


def _all_across(rows: DataFrame, k: int, percent: int, store: Scratch) -> DataFrame:
    """All pairs, from all but the largest component under each gram; a gram's texts are dealt over tasks by BLOCK."""
    main = rows.groupBy("gram", "root").count().groupBy("gram").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("n"))
    main = store.keep(main, f"main{k}")
    rows = _by_gram(rows, main.select("gram", "main"), main.select("gram", "n")).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    x = rows.where("root <> main").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    y = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _candidates(x, y, ["gram", "block"], percent, (F.col("y_root") == F.col("y_main")) | (F.col("x_rid") < F.col("y_rid")))


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by word n-gram Jaccard similarity of percent / 100 or more.

    ``docs`` needs a long ``doc_id`` and a string ``text``; other columns are
    ignored. Words are runs of bytes other than ASCII white space, A-Z lower-cased;
    a text of fewer than n words is one gram. Returns a row per input row:
    doc_id, n_shingles, component_id (the smallest doc_id reachable by links),
    text_key (equal for equal texts), group_key (equal for rows of one component, never null).

    Null and empty texts have no grams, link with nothing and are their own
    component; of these, rows of one id and text have one group_key. Repeated rows and equal texts share a component. Null ids take part
    but cannot name a component; a component of null ids only has a null id. Very long
    texts are compared whole. An empty table gives an empty result. Texts are told apart by a 64-bit hash of
    their bytes and grams by a 64-bit hash of their words.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "ngram_join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rid"))
    feats = store.keep(features(docs, n, percent, gram_frequencies(docs, n)), "feats")
    store.release()

    # one row for each distinct text
    texts = feats.where("n > 0").groupBy("rid").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in SKETCH], F.first("prefix").alias("prefix"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    texts = store.keep(texts, "texts")
    feats = store.keep(feats.select("doc_id", "rid", "n"), "rows_of_docs")
    store.drop("feats")
    store.release()
    each = texts.select("rid", "n", F.posexplode("prefix").alias("i", "gram"))
    shared = store.keep(each.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    store.release()
    # most grams are in one text only: a bitmap of fixed size keeps their rows from being moved again
    some = each.join(F.broadcast(bitmap(shared, "gram", BITMAP_BITS)), in_bitmap("gram", BITMAP_BITS)).drop("words")
    slim = store.keep(_by_gram(some, shared, shared.select("gram", F.col("c").alias("n"))), "slim")
    store.release()
    places = slim.where("c > 2").groupBy("rid").agg(F.collect_list("i").alias("shared"))
    rows = store.keep(_shared_rows(texts.join(places, "rid")), "rows")

    # texts that many documents have, those without words among them
    hot = hot_keys(count_by(feats, "rid"), "rid", feats.count())
    check = lambda pairs, k: _verify(pairs, docs, hot, n, percent, store, str(k))

    # under a gram of two texts these two; under others every text with the gram's pivot
    of_pivot = F.struct("n", "i", "firsts", *SKETCH)
    pivots = rows.groupBy("gram").agg(F.min("rid").alias("p_rid"), F.min_by(of_pivot, "rid").alias("p")).select("gram", "p_rid", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("n", "i", "firsts", *SKETCH)])
    met = salted_join(rows.select("gram", *[F.col(c).alias(f"x_{c}") for c in ("rid", "n", "i", "firsts", *SKETCH)]), pivots, "gram", F.xxhash64("x_rid"), hot_keys(count_by(rows, "gram"), "gram", rows.count()))
    star = met.where("x_rid <> p_rid").where(_may_match("x_", "p_", percent)).select(F.least("x_rid", "p_rid").alias("a"), F.greatest("x_rid", "p_rid").alias("b"))
    checked = store.keep(star.union(_pairs_of_two(slim, texts, percent)).distinct(), "star")
    store.drop("slim", "shared")
    links = check(checked, 0)
    found = store.keep(components(links, store, "cc0_"), "found0")

    # then pairs across components: those that fall in one bucket under a gram, anew each round while that finds links, and in the end all
    for k in range(1, ROUNDS + 1):
        rows = store.keep(_mixed(rows, found, store, str(k)), f"mixed{k}")
        last = k == ROUNDS or not links.head(1)
        pairs = (_all_across if last else _some_across)(rows, k, percent, store).join(checked, ["a", "b"], "left_anti")
        pairs = store.keep(pairs, f"pairs{k}")
        links = check(pairs, k)
        if links.head(1):
            found = store.keep(components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links), store, f"cc{k}_"), f"found{k}")
        # under a gram of no more than BUCKET texts all have met
        rows, checked = rows.where(F.col("c") > BUCKET).drop("root", "c"), checked.union(pairs)
        store.release()
        if last:
            break

    # names of components: the least doc_id among all copies of all members
    named = texts.select("rid", "least").join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    roots = store.keep(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    named = salted_join(named, roots.select("root", "component_id"), "root", F.xxhash64("rid"), hot_keys(roots, "root", texts.count()))
    named = store.keep(named.select("rid", "root", "component_id"), "named")
    # the result below reads the documents' rows and named only
    store.drop("texts", "rows", "star", "links0", "roots", *[f"{x}{j}" for j in range(k + 1) for x in ("mixed", "grams", "main", "pairs", "links", "found")])
    out = salted_join(feats.select("doc_id", "rid", "n"), named, "rid", F.xxhash64("doc_id"), hot, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("rid").alias("text_key"), F.coalesce("root", F.xxhash64(F.lit("alone"), "doc_id", "rid")).alias("group_key"))

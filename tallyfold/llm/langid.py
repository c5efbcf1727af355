"""Language identification by words first, with backoff to character n-grams.

Method: words are runs of letters, lower-cased. For each language a known word weighs
the log of its frequency against that of a word seen nowhere (half a count in the
largest language, and the same frequency in all others, so that a small language
neither wins nor loses by what it has not seen); a word not known is scored by the
longest character n-grams of it (5 letters down to 1, with ``_`` at its ends) of which any
is known: the sum of their weights. A text's score of a language is the sum over all
its words; the prediction is the best language (ties: the first by name) and ``score``
its share after a softmax.

Fit: words are counted by language over all texts given, pre-aggregated in every
task, and so are the n-grams of those words. All counts are kept. The most frequent
words and n-grams, at most ``WORDS`` and ``GRAMS``, cut at a count so that ties stay
together, are broadcast; all others are tables in the shared folder.

Prediction: a scan sums the broadcast words of each text and lists its other words,
each once with its count. The distinct ones of these are joined to the table of words;
what is not there is looked up by its n-grams, broadcast ones first and the table's by
a join. The weights are joined back to the lists (terms of more than one row in
``HOT`` by broadcast) and summed by row. Without such tables the scan is all.

Defined results: null texts and texts without a letter are ``und`` with a score of 0,
and so is every text if nothing was learned. Rows are judged one by one, so
repeated rows and null ids give rows of their own; rows without language teach
nothing. More than ``LANGUAGES`` languages are an error. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.shared import Scratch
from tallyfold.llm.tokens import text_slices
from tallyfold.llm.wordhash import mix

#: Words and n-grams that are broadcast at most; all others are tables. About 100 bytes each for every Python worker.
WORDS = 150_000
GRAMS = 80_000
LONGEST = 5
#: Languages a model may have.
LANGUAGES = 1000
#: Entries that a task counts before it hands them on; unseen words a worker remembers, and those a scan numbers before it starts anew.
HELD = 400_000
NUMBERED = 100_000
#: Bytes of texts that are split into words at once; about 30 bytes of words and arrays for each of them.
SLICE = 1 << 20
#: A term of more than this part of the rows of a join is broadcast, not shuffled.
HOT = 1000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Words of a text, lower-cased; runs of other numerals alone are none."""
    found = _WORD.findall(text.lower()) if text else []
    return found if not text or text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; single letters without the marks."""
    if n == 1:
        return list(word)
    w = f"_{word}_"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


_NAMES = ["lang", "term", "n"]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=_NAMES)
        held.clear()

    for batch in batches:
        for lo, hi in text_slices(batch.column(1), SLICE):
            for lang, text in zip(*(batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 1))):
                held[lang].update(words(text))
            if sum(map(len, held.values())) > HELD:
                yield from out()
    yield from out()


def gram_counts(found: list[str], n: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """(order and n-gram, count) of words that occur ``n`` times, for each order."""
    text = f"_{'_'.join(found)}_"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = codes == ord("_")
    of = np.minimum(np.cumsum(edge) - 1, len(found) - 1)  # the word that starts at or holds a place
    for k in range(1, LONGEST + 1):
        size = len(codes) - k + 1
        if size <= 0:
            return
        whole = ~edge[:size] if k == 1 else np.ones(size, bool)
        for j in range(1, k - 1):
            whole &= ~edge[j : j + size]
        if k == 2:
            whole &= ~(edge[:size] & edge[1 : 1 + size])
        at = np.flatnonzero(whole)
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = mix(h + codes[at + j])
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        yield [f"{k}{text[i : i + k]}" for i in at[first].tolist()], np.bincount(inverse, n[of[at]]).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (found, n) in held.items():
            for terms, counts in gram_counts(found, np.array(n)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array(terms, pa.string()), pa.array(counts)], names=_NAMES)
        held.clear()

    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            held[lang][0].append(word)
            held[lang][1].append(n)
        if sum(len(x) for x, _ in held.values()) > HELD // 4:
            yield from out()
    yield from out()


def _frequent(counts: DataFrame, most: int) -> tuple[pa.Table | None, DataFrame | None]:
    """(lang, term, n) of the terms with the largest total counts, at most ``most`` terms, and the counts of all others if there are any."""
    totals = counts.groupBy("term").agg(F.sum("n").alias("total"))
    sizes = totals.groupBy("total").count().orderBy(F.desc("total")).limit(most + 1).collect()
    kept, least = 0, None
    for r in sizes:
        kept += r["count"]
        if kept > most:
            break
        least = r.total
    split = counts.join(totals, "term")
    head = None if least is None else split.where(F.col("total") >= least).select("lang", "term", "n").toArrow()
    if kept <= most:
        return head, None
    return head, split if least is None else split.where(F.col("total") < least)


def _logs(rows: pa.Table | None, langs: list[str], scale: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Index of terms, and their weights (terms, languages)."""
    if rows is None:
        return {}, np.zeros((0, len(langs)))
    terms, of = (rows.column(name).combine_chunks().dictionary_encode() for name in ("term", "lang"))
    col = np.array([langs.index(x) for x in of.dictionary.to_pylist()], np.int64)
    counts = np.zeros((len(terms.dictionary), len(langs)))
    np.add.at(counts, (terms.indices.to_numpy(), col[of.indices.to_numpy()]), rows.column("n").to_numpy())
    return dict(zip(terms.dictionary.to_pylist(), range(len(counts)))), np.log1p(counts * scale)


_CELLS = "cells array<struct<l: int, d: double>>"
_LEFT = f"term string, {_CELLS}"


def _left(counts: DataFrame | None, langs: list[str], scale: np.ndarray, scratch: Scratch, name: str) -> str:
    """Path of a table of the terms that are not broadcast, each with its weights that are not 0."""
    spark = scratch.spark
    if counts is None:
        scratch.write(spark.createDataFrame([], _LEFT), name)
    else:
        scales = spark.createDataFrame([(x, i, float(w)) for i, (x, w) in enumerate(zip(langs, scale))], "lang string, l int, scale double")
        cell = F.struct("l", F.log1p(F.col("n") * F.col("scale")).alias("d"))
        scratch.write(counts.join(F.broadcast(scales), "lang").groupBy("term").agg(F.collect_list(cell).alias("cells")), name)
    return scratch.path(name)


@dataclass
class Model:
    langs: list[str]
    word_at: dict[str, int]
    word_log: np.ndarray
    gram_at: dict[str, int]
    gram_log: np.ndarray
    #: Paths of the tables of all other words and n-grams, if there are any.
    left: tuple[str, str] | None = None

    def __post_init__(self):
        self._forget()

    @cached_property
    def orders(self) -> list[dict[str, int]]:
        """Index of the n-grams of each order, the longest first."""
        return [{g[1:]: i for g, i in self.gram_at.items() if g[0] == str(k)} for k in range(LONGEST, 0, -1)]

    def __reduce__(self):
        # workers make what follows from the counts themselves, and only what they use
        return Model, (self.langs, self.word_at, self.word_log, self.gram_at, self.gram_log, self.left)

    def _forget(self) -> None:
        self.seen: dict[str, int] = {} if self.left else dict(self.word_at)
        self.table = self.word_log

    def unseen(self, new: list[str]) -> np.ndarray:
        """Scores of words that are not known: (words, languages)."""
        out = np.zeros((len(new), len(self.langs)))
        left = range(len(new))
        for k, order in zip(range(LONGEST, 0, -1), self.orders):
            at, of, rest = [], [], []
            for i in left:
                known = [order[g] for g in grams(new[i], k) if g in order]
                if known:
                    at += known
                    of += [i] * len(known)
                else:
                    rest.append(i)
            if at:
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                out[np.array(of)[starts]] = np.add.reduceat(self.gram_log[at], starts)
            left = rest
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores of texts, by a model that is broadcast as a whole."""
        if self.left:
            raise ValueError("words of this model are in tables; use predict(docs, model)")
        found = [words(t) for t in texts]
        if len(self.seen) > HELD + len(self.word_at):
            self._forget()
        seen, new = self.seen, set()
        for x in found:
            new.update(filterfalse(seen.__contains__, x))
        if new:
            order = list(new)
            seen.update(zip(order, range(len(self.table), len(self.table) + len(order))))
            self.table = np.concatenate([self.table, self.unseen(order)])
        sizes = np.array([len(x) for x in found], np.int64)
        at = np.fromiter(map(seen.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        total, full = np.zeros((len(texts), len(self.langs))), np.flatnonzero(sizes)
        if self.langs and len(full):
            total[full] = np.add.reduceat(self.table[at], (np.cumsum(sizes) - sizes)[full])
        return self.decide(total, full)

    def decide(self, total: np.ndarray, full: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores by the sums of texts; ``full`` are the places of those with words."""
        langs, scores = ["und"] * len(total), np.zeros(len(total))
        if not self.langs or not len(full):
            return langs, scores
        p = np.exp(total - total.max(1, keepdims=True))
        best, share = p.argmax(1), 1 / p.sum(1)
        for i in full.tolist():
            langs[i], scores[i] = self.langs[best[i]], share[i]
        return langs, scores


def fit(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", most_words: int | None = None, most_grams: int | None = None) -> Model:
    """A model of all rows of ``docs`` with a language; at most ``most_words`` words and ``most_grams`` n-grams are broadcast."""
    scratch = Scratch(docs.sparkSession, "langid")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    schema = "lang string, term string, n long"
    counts = scratch.write(rows.mapInArrow(_count_words, schema).groupBy("lang", "term").agg(F.sum("n").alias("n")), "words")
    pieces = scratch.write(counts.mapInArrow(_count_grams, schema).groupBy("lang", "term").agg(F.sum("n").alias("n")), "grams")
    sums = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()}
    if len(sums) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(sums)
    parts = {r.lang: r.n for r in pieces.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    out, rest = [], []
    for table, total, most in ((counts, sums, WORDS if most_words is None else most_words), (pieces, parts, GRAMS if most_grams is None else most_grams)):
        scale = 2 * max(total.values(), default=0) / np.array([total[x] for x in langs], float)
        head, others = _frequent(table, most)
        out += _logs(head, langs, scale)
        rest.append((others, langs, scale, scratch))
    left = None
    if any(r[0] is not None for r in rest):
        left = _left(*rest[0], "words_left"), _left(*rest[1], "grams_left")
    scratch.drop("words", "grams")
    return Model(langs, *out, left)


def _predict(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), SLICE):
                langs, scores = model.value.predict(batch.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def _cells(row: np.ndarray, lang: np.ndarray, weight: np.ndarray, rows: int) -> pa.Array:
    """Lists of (l, d) for each of ``rows`` rows; ``row`` is sorted."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(lang.astype(np.int32)), pa.array(weight)], names=["l", "d"]))


_SCANNED = f"row long, doc_id long, full boolean, {_CELLS}, terms array<struct<term: string, times: int>>"


def _scan(model) -> Callable:
    """Of each text the sums of its broadcast words, and its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        seen, names, most = dict(m.word_at), [], len(m.word_at)
        table = np.concatenate([m.word_log, np.zeros((1, len(m.langs)))])
        for batch in batches:
            for lo, hi in text_slices(batch.column(2), SLICE):
                found = [words(t) for t in batch.column(2).slice(lo, hi - lo).to_pylist()]
                if len(names) > NUMBERED:
                    seen, names = dict(m.word_at), []
                new = set()
                for x in found:
                    new.update(filterfalse(seen.__contains__, x))
                seen.update(zip(new, range(most + len(names), most + len(names) + len(new))))
                names += new
                sizes = np.array([len(x) for x in found], np.int64)
                at = np.fromiter(map(seen.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
                total, full = np.zeros((hi - lo, len(m.langs))), np.flatnonzero(sizes)
                if len(full):
                    total[full] = np.add.reduceat(table[np.minimum(at, most)], (np.cumsum(sizes) - sizes)[full])
                row, lang = np.nonzero(total)
                other = at >= most
                pair, times = np.unique((np.repeat(np.arange(hi - lo), sizes)[other] << 32) | (at[other] - most), return_counts=True)
                terms = pa.array([names[i] for i in (pair & 0xFFFFFFFF).tolist()], pa.string())
                offsets = np.searchsorted(pair >> 32, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([terms, pa.array(times.astype(np.int32))], names=["term", "times"]))
                held = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(sizes > 0), _cells(row, lang, total[row, lang], hi - lo), lists], names=["row", "doc_id", "full", "cells", "terms"])

    return run


_PIECES = f"word string, rows long, known int, {_CELLS}, grams array<string>"


def _pieces(model) -> Callable:
    """Of each unseen word the longest order of which a broadcast n-gram is known, its sums, and the other n-grams of that order and longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            known, cells, other = [], [], []
            for word in batch.column(0).to_pylist():
                asked, total, k = [], {}, 0
                for k, order in zip(range(LONGEST, 0, -1), m.orders):
                    mine = grams(word, k)
                    found = [order[g] for g in mine if g in order]
                    asked += [f"{k}{g}" for g in mine if g not in order]
                    if found:
                        total = m.gram_log[found].sum(0)
                        break
                else:
                    k = 0
                known.append(k)
                cells.append([(int(i), float(total[i])) for i in np.flatnonzero(total)] if k else [])
                other.append(asked)
            kind = pa.list_(pa.struct([("l", pa.int32()), ("d", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known, pa.int32()), pa.array(cells, kind), pa.array(other, pa.list_(pa.string()))], names=["word", "rows", "known", "cells", "grams"])

    return run


def _looked_up(rows: DataFrame, sizes: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined to the (term, cells) of ``table``; ``sizes`` holds how often each (term, rows) occurs. Terms of many rows are broadcast."""
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    many = [r.term for r in sizes.where(F.col("rows") > total // HOT + 1).select("term").collect()]
    if not many:
        return rows.join(table, "term")
    hot = F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in many], "term string"))
    return rows.join(F.broadcast(table.join(hot, "term")), "term").unionByName(rows.join(hot, "term", "left_anti").join(table.join(hot, "term", "left_anti"), "term"))


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of the cells of ``rows`` (cells, times), by the keys ``by``, dealt out by the first of them."""
    cells = rows.repartition(by[0]).select(*by, "times", F.explode("cells").alias("c"))
    return cells.groupBy(*by, F.col("c.l").alias("l")).agg(F.sum(F.col("c.d") * F.col("times")).alias("d")).groupBy(*by).agg(F.collect_list(F.struct("l", "d")).alias("sums"))


def _weights(asked: DataFrame, model: Model, held, scratch: Scratch) -> DataFrame:
    """(term, rows, cells) of the ``asked`` (term, rows), by the tables of the model."""
    spark = scratch.spark
    words_left, grams_left = (spark.read.schema(_LEFT).parquet(p) for p in model.left)
    seen = asked.join(words_left, "term")
    pieces = scratch.write(asked.join(words_left, "term", "left_anti").select("term", "rows").mapInArrow(_pieces(held), _PIECES), "pieces")
    lists = pieces.select("word", F.explode("grams").alias("term"))
    found = _looked_up(lists, lists.groupBy("term").agg(F.count("*").alias("rows")), grams_left)
    sums = _summed(found.select("word", F.substring("term", 1, 1).cast("int").alias("k"), F.lit(1).alias("times"), "cells"), "word", "k")
    best = sums.groupBy("word").agg(F.max_by(F.struct("k", "sums"), "k").alias("best"))
    cells = F.when(F.col("best").isNull(), F.col("cells")).when(F.col("best.k") > F.col("known"), F.col("best.sums")).otherwise(F.concat("cells", "best.sums"))
    unseen = pieces.join(best, "word", "left").select(F.col("word").alias("term"), "rows", cells.alias("cells"))
    return scratch.write(seen.select("term", "rows", "cells").unionByName(unseen), "weights")


def _decided(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            total = np.zeros((len(batch), len(m.langs)))
            for k in (2, 3):
                lists = batch.column(k)
                row, flat = lists.value_parent_indices().to_numpy(), lists.flatten()
                np.add.at(total, (row, flat.field(0).to_numpy()), flat.field(1).to_numpy())
            langs, scores = m.decide(total, np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    spark, out = docs.sparkSession, "doc_id long, lang_pred string, score double"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = spark.sparkContext.broadcast(model)
    if not model.left:
        return texts.mapInArrow(_predict(held), out)
    scratch = Scratch(spark, "langid")
    scanned = scratch.write(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_scan(held), _SCANNED), "scanned")
    lists = scanned.select("row", F.inline("terms"))
    asked = scratch.write(lists.groupBy("term").agg(F.count("*").alias("rows")), "asked")
    weights = _weights(asked, model, held, scratch)
    scratch.keep("scanned", "asked", "weights")
    sums = _summed(_looked_up(lists, asked, weights.select("term", "cells")), "row")
    both = scanned.select("row", "doc_id", "full", "cells").join(sums, "row", "left")
    none = F.array().cast("array<struct<l: int, d: double>>")
    return both.select("doc_id", "full", "cells", F.coalesce("sums", none).alias("sums")).mapInArrow(_decided(held), out)

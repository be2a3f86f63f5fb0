"""Reading level of documents: a latent difficulty model of word occurrences.

For each language, a document d of level t and a word w of difficulty b are linked as in a Rasch model with
rated items: the chance that a running word of the document is w is in proportion to p(w) * exp(t * b). Levels
and difficulties are estimated in turn. A pass over the documents finds every level given the difficulties and
sums what the difficulties need. Documents stand in blocks, each with a list of its words; a pass joins the
difficulties to these lists and gives out one sum for each of their words, so that what is shuffled follows the
number of words in blocks, not of occurrences. Difficulties are a table of any size, and words are told apart exactly.

Grades of some documents, where there are any, start the alternation and pull their documents' levels while
the model is fitted, so that the latent scale is one of difficulty. The levels given out come from the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..tables import cut

#: Documents in one block, at most.
BLOCK_DOCS = 2_000
GRID = np.linspace(-4.0, 4.0, 81)
#: The alternation ends when a running word's difficulty moves by less than this on average, or after so many rounds.
MOVED = 0.05
ROUNDS = 12
#: Rows of a word table up to which it is sent to all tasks instead of being shuffled, at a few dozen bytes each.
SMALL_TABLE = 1_000_000
#: Graded documents from which a language starts from its grades.
LEAST_GRADES = 5
#: Prior precision of a level, of a difficulty (in words), and weight of a document's grade (in words).
LEVEL_PRIOR = 1.0
WORD_PRIOR = 20.0
GRADE_WEIGHT = 60.0

# Frequent words that tell the languages apart.
_FUNCTION_WORDS = {
    "en": frozenset("the and is of to that it in a this you with for are was not be which each its we if".split()),
    "de": frozenset("der die das und ist den nicht ein eine mit von zu dem des auf wenn wird jeder nur dass im sich".split()),
    "fr": frozenset("le la les et est des une un dans que pour qui pas sur avec du au ne se chaque cette ce".split()),
    "es": frozenset("el los las y es una un en que para con por no se del al su cada esta este como lo".split()),
}
LANGUAGES = (*sorted(_FUNCTION_WORDS), "zh", "other")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]+")
_NO_PROSE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|https?://\S+|<[^<>\n]{1,200}>|&#?\w{1,8};", re.S)


def words(text: str) -> tuple[str, list[str]]:
    """The language of a text by its script and function words, and its running words.

    Chinese text is read in pairs of characters. Code between fences, links and tags are no words. 'other'
    where too little tells the language.
    """
    prose = _NO_PROSE.sub(" ", text)
    cjk = _CJK.findall(prose)
    plain = [w.lower() for w in _WORD.findall(_CJK.sub(" ", prose) if cjk else prose)]
    n = sum(map(len, cjk))
    if n > 0.4 * (n + len(plain)) and n >= 4:
        return "zh", [run[i : i + 2] for run in cjk for i in range(max(1, len(run) - 1))]
    score = {lang: sum(1 for w in plain if w in ws) for lang, ws in _FUNCTION_WORDS.items()}
    best = max(sorted(score), key=lambda lang: score[lang])
    return (best if score[best] >= 2 and score[best] * 20 >= len(plain) else "other"), plain


def word_vectors(documents: DataFrame, *, key: str, text: str) -> DataFrame:
    """Per row: key, ``lang_used``, ``n_words``, ``words`` (different ones) and ``counts``."""
    src = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    key_type = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, totals, names, counts = [], [], [], []
            for t in b.column(1).to_pylist():
                lang, ws = words(t) if t else ("other", [])
                own = Counter(ws)
                langs.append(lang)
                totals.append(len(ws))
                names.append(list(own))
                counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(totals, pa.int32()), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))],
                ["k", "lang_used", "n_words", "words", "counts"],
            )

    out = src.mapInArrow(run, f"k {key_type}, lang_used string, n_words int, words array<string>, counts array<int>")
    return out.withColumnRenamed("k", key)


_BLOCK = "block string, lang string, words array<string>, ends array<int>, item array<int>, count array<int>, n array<int>, grade array<double>"


def word_blocks(vectors: DataFrame, *, key: str) -> DataFrame:
    """Documents of one language and task, at most BLOCK_DOCS, as one row: its different words, and a sparse matrix of counts.

    ``ends`` are the ends of the documents in ``item`` (places in ``words``) and ``count``; ``keys`` has their keys.
    A word is stored once in a block, so all that a pass has to fetch or give out is a row for each word of a block.
    """
    key_type = vectors.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            langs = t.column("lang_used").to_numpy()
            for lang in sorted(set(langs)):
                own = t.filter(pa.array(langs == lang))
                for at in range(0, own.num_rows, BLOCK_DOCS):
                    part = own.slice(at, BLOCK_DOCS).combine_chunks()
                    column = lambda c: part.column(c).combine_chunks()
                    names, counts = column("words"), column("counts")
                    coded = names.flatten().dictionary_encode()
                    ends = (names.offsets.to_numpy() - names.offsets[0].as_py())[1:]
                    one = lambda v, kind: pa.array([v], pa.list_(kind))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{task}-{made}"]), pa.array([lang]), one(coded.dictionary.to_pylist(), pa.string()), one(ends, pa.int32()), one(coded.indices.to_numpy(), pa.int32()),
                            one(counts.flatten().to_numpy(), pa.int32()), one(column("n_words").to_numpy(), pa.int32()), one(column("grade").to_pylist(), pa.float64()), one(column(key).to_pylist(), to_arrow_type(key_type)),
                        ],
                        ["block", "lang", "words", "ends", "item", "count", "n", "grade", "keys"],
                    )
                    made += 1

    src = vectors.select(key, "lang_used", "n_words", "words", "counts", "grade")
    return src.mapInArrow(run, f"{_BLOCK}, keys array<{key_type.simpleString()}>")


class Curves(NamedTuple):
    """What a language's words say about all levels of the grid: a few numbers, however many words there are."""

    norm: np.ndarray
    slope: np.ndarray


#: For documents of a language in which no text has words.
NO_WORDS = Curves(np.zeros(len(GRID)), np.zeros(len(GRID)))


def levels(curves: Curves, n: np.ndarray, mean_b: np.ndarray, weight: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """The level of each document: the root of a monotone equation, found by interpolation on the grid."""
    want = n * mean_b + weight * grade
    have = n[:, None] * curves.slope[None, :] + (LEVEL_PRIOR + weight)[:, None] * GRID[None, :]
    k = np.clip((have < want[:, None]).sum(1), 1, len(GRID) - 1)
    rows = np.arange(len(n))
    lo, hi = have[rows, k - 1], have[rows, k]
    return np.clip(GRID[k - 1] + (want - lo) / np.maximum(hi - lo, 1e-9) * (GRID[k] - GRID[k - 1]), GRID[0], GRID[-1])


def _matrix(row: dict):
    """Words' number, documents' number, item, count and row of each entry, words and grade of each document."""
    ends = np.asarray(row["ends"], dtype=np.int64)
    item, count = np.asarray(row["item"], dtype=np.int64), np.asarray(row["count"], dtype=float)
    n = np.asarray(row["n"], dtype=float)
    grade = np.asarray([np.nan if g is None else g for g in row["grade"]], dtype=float)
    return item, count, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), n, grade


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {f: (b.column(f)[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(b.schema.field(f).type) else b.column(f)[i].as_py()) for f in b.schema.names}


class Words(NamedTuple):
    """The words of all blocks by place, and how many rows these and the table of difficulties have."""

    table: DataFrame
    places: int
    different: int


def _grown(blocks: DataFrame, words_: Words, difficulties: DataFrame) -> DataFrame:
    """The blocks with ``b``, the difficulties of their words in their order: joined by word, gathered by block.

    Tables of known small size are sent to the blocks; larger ones meet them in shuffles, with the same result.
    """
    small = lambda df, n: F.broadcast(df) if n <= SMALL_TABLE else df
    known = words_.table.join(small(difficulties.select("lang", "word", "b"), words_.different), ["lang", "word"])
    gathered = known.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "b"))), lambda x: x["b"]).alias("b"))
    return blocks.join(small(gathered, words_.places), "block", "left").withColumn("b", F.coalesce("b", F.expr("cast(array() as array<double>)")))


def _counts(blocks: DataFrame) -> DataFrame:
    """Per language and word: occurrences ``n``, those in graded documents ``gn`` and their grades' sum ``gs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            item, count, row, _, grade = _matrix(r)
            g, size = ~np.isnan(grade)[row], len(r["words"])
            sums = [np.bincount(item, count, size), np.bincount(item[g], count[g], size), np.bincount(item[g], count[g] * grade[row[g]], size)]
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * size, pa.string()), pa.array(r["words"], pa.string()), *[pa.array(x.astype(float)) for x in sums]], ["lang", "word", "n", "gn", "gs"])

    rows = blocks.select("lang", "words", "ends", "item", "count", "n", "grade").mapInArrow(run, "lang string, word string, n double, gn double, gs double")
    return rows.groupBy("lang", "word").agg(*[F.sum(c).alias(c) for c in ("n", "gn", "gs")])


def _level_sums(grown: DataFrame, curves: dict[str, Curves]) -> DataFrame:
    """Sums over all documents at their levels: per word the occurrences times the level, per language (``word`` null) the words at each place ``i`` of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            item, count, row, n, grade = _matrix(r)
            has = ~np.isnan(grade)
            mean_b = np.bincount(row, count * r["b"][item], len(n)) / np.maximum(n, 1.0)
            t = levels(curves.get(r["lang"], NO_WORDS), n, mean_b, np.where(has, GRADE_WEIGHT, 0.0), np.where(has, grade, 0.0))
            exact = (t - GRID[0]) / (GRID[1] - GRID[0])
            place = np.clip(exact.astype(np.int64), 0, len(GRID) - 2)
            hist = np.bincount(place, n * (place + 1 - exact), len(GRID)) + np.bincount(place + 1, n * (exact - place), len(GRID))
            size = len(r["words"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["lang"]] * (size + len(GRID)), pa.string()),
                    pa.array([*r["words"], *[None] * len(GRID)], pa.string()),
                    pa.array([-1] * size + list(range(len(GRID))), pa.int32()),
                    pa.array(np.concatenate([np.bincount(item, count * t[row], size), hist]).astype(float)),
                ],
                ["lang", "word", "i", "s"],
            )

    out = grown.select("lang", "words", "ends", "item", "count", "n", "grade", "b").mapInArrow(run, "lang string, word string, i int, s double")
    return out.groupBy("lang", "word", "i").agg(F.sum("s").alias("s"))


def _curves(difficulties: DataFrame) -> tuple[dict[str, Curves], float]:
    """Normaliser and mean difficulty of a running word along the grid, per language, and how far the words moved: sums over all words, a few numbers for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            b, p, n, moved = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "p", "n", "moved"))
            for lang in sorted(set(langs)):
                own = langs == lang
                e = np.exp(np.clip(np.outer(GRID, b[own]), -30, 30)) * p[own]
                values = np.concatenate([e.sum(1), e @ b[own], [p[own].sum(), n[own].sum(), (n * moved)[own].sum()]])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["lang", "i", "v"])

    rows = difficulties.select("lang", "b", "p", "n", "moved").mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    k = len(GRID)
    table: dict[str, np.ndarray] = {}
    for r in rows:
        table.setdefault(r["lang"], np.zeros(2 * k + 3))[r["i"]] = r["v"]
    total = sum(v[2 * k + 1] for v in table.values())
    found = {lang: Curves(np.log(v[:k] / v[2 * k]), v[k : 2 * k] / v[:k]) for lang, v in table.items()}
    return found, sum(v[2 * k + 2] for v in table.values()) / total if total else 0.0


_WORDS = "lang string, word string, n double, b double, p double, moved double"


def _first(counts: DataFrame, graded: dict[str, int]) -> DataFrame:
    """Difficulties to start from: the mean grade around a word, or its length in languages without grades."""
    sums = counts.groupBy("lang").agg(
        F.sum("n").alias("ln"), F.sum("gn").alias("lgn"), F.sum("gs").alias("lgs"), (F.sum(F.col("n") * F.char_length("word")) / F.sum("n")).alias("lm"),
        F.sum(F.col("n") * F.char_length("word") * F.char_length("word")).alias("lq"),
    )
    rows = counts.join(F.broadcast(sums), "lang")  # one row for each of the six languages
    mean = F.col("lgs") / F.greatest("lgn", F.lit(1.0))
    by_grade = (F.col("gs") - mean * F.col("gn")) / (F.col("gn") + WORD_PRIOR)
    spread = F.sqrt(F.greatest(F.col("lq") / F.col("ln") - F.col("lm") * F.col("lm"), F.lit(0.0)))
    by_length = (F.char_length("word") - F.col("lm")) / F.when(spread > 0, spread).otherwise(1.0) * 0.5
    known = [lang for lang, k in graded.items() if k >= LEAST_GRADES]
    return rows.select("lang", "word", "n", F.when(F.col("lang").isin(known), by_grade).otherwise(by_length).alias("b"), (F.col("n") / F.col("ln")).alias("p"), F.lit(0.0).alias("moved"))


def _newton(difficulties: DataFrame, sums: DataFrame, curves: dict[str, Curves]) -> DataFrame:
    """New difficulties given all levels: each word's own one-dimensional optimum."""
    table: dict[str, np.ndarray] = {}
    for r in sums.where(F.col("word").isNull()).collect():  # the grid of each language
        table.setdefault(r["lang"], np.zeros(len(GRID)))[r["i"]] = r["s"]
    scale = {}
    for lang, hist in table.items():
        if hist.sum() > 0:
            centre = (hist * GRID).sum() / hist.sum()
            scale[lang] = (centre, np.sqrt((hist * (GRID - centre) ** 2).sum() / hist.sum()) or 1.0, hist * np.exp(-curves.get(lang, NO_WORDS).norm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            n, b, s = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("n", "b", "s"))
            p, moved = np.zeros(len(n)), np.zeros(len(n))
            for lang in sorted(set(langs)):
                own = langs == lang
                centre, spread, base = scale[lang]
                grid = (GRID - centre) / spread
                bw, nw, sw = b[own] * spread, n[own], (s[own] - centre * n[own]) / spread
                for _ in range(8):  # Newton steps for all words of the batch at once
                    e = np.exp(np.clip(np.outer(bw, grid), -20, 20)) * base
                    z = e.sum(1)
                    m1 = (e @ grid) / z
                    m2 = (e @ (grid * grid)) / z - m1 * m1
                    bw = bw + np.clip((sw - nw * m1 - WORD_PRIOR * bw) / (nw * np.maximum(m2, 1e-3) + WORD_PRIOR), -1, 1)
                e = np.exp(np.clip(np.outer(bw, grid), -20, 20)) * base
                p[own] = nw / np.maximum(e.sum(1), 1e-12)
                bw = np.clip(bw, -6, 6)
                moved[own] = np.abs(bw - b[own])
                b[own] = bw
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("word"), *map(pa.array, (n, b, p, moved))], ["lang", "word", "n", "b", "p", "moved"])

    return difficulties.join(sums.where(F.col("word").isNotNull()).select("lang", "word", "s"), ["lang", "word"]).select("lang", "word", "n", "b", "s").mapInArrow(run, _WORDS)


def fit(blocks: DataFrame, graded: dict[str, int], rounds: int = ROUNDS) -> tuple[Words, DataFrame, dict[str, Curves]]:
    """Words of blocks, difficulties (``lang``, ``word``, ``b``) and curves, by alternating optimisation.

    ``blocks`` has standardised grades (null where unknown), ``graded`` their number per language. A round finds all
    levels given the difficulties, then all difficulties given the levels; both are tables that Spark joins, however
    many words there are, and the driver holds a grid for each language. It ends when a running word's difficulty
    moves by less than MOVED on average, or after ``rounds``.
    """
    table = cut(blocks.select("block", "lang", F.posexplode("words").alias("at", "word")))
    difficulties = cut(_first(_counts(blocks), graded))
    words_ = Words(table, table.count(), difficulties.count())
    curves, _ = _curves(difficulties)
    for _ in range(rounds):
        sums = cut(_level_sums(_grown(blocks, words_, difficulties), curves))
        difficulties = cut(_newton(difficulties, sums, curves))
        curves, moved = _curves(difficulties)
        if moved < MOVED:
            break
    return words_, difficulties, curves


def score(blocks: DataFrame, words_: Words, difficulties: DataFrame, curves: dict[str, Curves], *, key: str) -> DataFrame:
    """key, ``lang_used``, ``n_words``, ``theta`` and ``grade`` of all documents, by their text alone."""
    element = blocks.schema["keys"].dataType.elementType
    arrow_key, key_type = to_arrow_type(element), element.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            for i, r in enumerate(_rows([b.drop_columns(["keys"])])):
                item, count, row, n, grade = _matrix(r)
                mean_b = np.bincount(row, count * r["b"][item], len(n)) / np.maximum(n, 1.0)
                zero = np.zeros(len(n))
                t = levels(curves.get(r["lang"], NO_WORDS), n, mean_b, zero, zero)
                yield pa.RecordBatch.from_arrays(
                    [keys[i].values.cast(arrow_key), pa.array([r["lang"]] * len(n), pa.string()), pa.array(n.astype(np.int32)), pa.array(t), pa.array(grade, pa.float64(), from_pandas=True)],
                    ["k", "lang_used", "n_words", "theta", "grade"],
                )

    grown = _grown(blocks, words_, difficulties)
    out = grown.mapInArrow(run, f"k {key_type}, lang_used string, n_words int, theta double, grade double")
    return out.select(F.col("k").alias(key), "lang_used", "n_words", "theta", "grade")


def grades_of(labels: DataFrame, *, key: str) -> DataFrame:
    """One grade per document: the mean over raters of their mean grades; null grades and repeated rows do not count."""
    own = labels.where(F.col("grade").isNotNull() & F.col(key).isNotNull()).select(key, "rater", "grade").distinct()
    return own.groupBy(key, "rater").agg(F.avg("grade").alias("g")).groupBy(key).agg(F.avg("g").alias("raw_grade"))


def reading_levels(documents: DataFrame, labels: DataFrame, *, key: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """Per document: key, ``lang_used``, ``n_words``, ``theta``, ``level`` (1 easiest to 5 hardest), ``band``.

    ``theta`` is the latent level within the language (0 average, 1 one standard deviation of running text);
    ``level`` is it on the scale of the grades, by a regression per language that leans on all languages
    where a language has few grades. Null, blank and wordless texts get the average level and n_words 0.
    Repeated rows are scored each; without any labels the scale is 3 plus theta; an empty table gives no
    rows. Only the named columns are read.
    """
    grades = grades_of(labels, key=key)
    overall = grades.agg(F.avg("raw_grade").alias("m"), F.stddev_pop("raw_grade").alias("s")).first()
    mean, spread = overall["m"] if overall["m"] is not None else 3.0, overall["s"] or 1.0
    known = grades.select(F.col(key).alias("__id"), ((F.col("raw_grade") - mean) / spread).alias("grade"))
    vectors = word_vectors(documents, key=key, text=text)
    blocks = cut(word_blocks(vectors.join(known, F.col(key) == F.col("__id"), "left").drop("__id"), key=key))
    graded = {r["lang"]: r["k"] for r in blocks.groupBy("lang").agg(F.sum(F.size(F.filter("grade", F.isnotnull))).alias("k")).collect()}
    scored = cut(score(blocks, *fit(blocks, graded, rounds), key=key))
    parts = scored.where(F.col("grade").isNotNull() & (F.col("n_words") > 0)).groupBy("lang_used").agg(
        F.count("*").alias("n"), F.sum("theta").alias("x"), F.sum("grade").alias("y"), F.sum(F.col("theta") * F.col("grade")).alias("xy"), F.sum(F.col("theta") * F.col("theta")).alias("xx")
    ).collect()
    lines = _regressions(parts)
    a = F.create_map(*[F.lit(v) for lang in LANGUAGES for v in (lang, lines[lang][0])])
    c = F.create_map(*[F.lit(v) for lang in LANGUAGES for v in (lang, lines[lang][1])])
    level = F.lit(mean) + F.lit(spread) * (a[F.col("lang_used")] + c[F.col("lang_used")] * F.col("theta"))
    level = F.least(F.greatest(level, F.lit(1.0)), F.lit(5.0))
    return scored.select(key, "lang_used", "n_words", "theta", level.alias("level"), F.round(level).cast("int").alias("band"))


def _regressions(parts) -> dict[str, tuple[float, float]]:
    """Intercept and slope of the grade on theta per language, shrunk towards the line of all languages."""

    def line(n, x, y, xy, xx, prior, weight):
        a0, c0 = prior
        m = np.array([[n + weight, x], [x, xx + weight]])
        return tuple(np.linalg.solve(m, np.array([y + weight * a0, xy + weight * c0])))

    tot = [sum(r[k] for r in parts) for k in ("n", "x", "y", "xy", "xx")]
    pooled = line(*tot, (0.0, 1.0), 5.0)
    own = {r["lang_used"]: line(r["n"], r["x"], r["y"], r["xy"], r["xx"], pooled, 10.0) for r in parts}
    return {lang: tuple(map(float, own.get(lang, pooled))) for lang in LANGUAGES}

"""Language identification in two steps: the family first, then the language within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import Scratch, list_array, table, text_slices

# Families of closely related languages. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
UNKNOWN = "und"

#: Texts per language, about, from which the machines are fitted; a language with fewer gives all.
SAMPLE_TEXTS = 600
PLACES = 4096
#: Passes over the sample, cost of a violation, and the gradient at which a fit ends.
PASSES, COST, SMALL_GRADIENT = 60, 10.0, 1e-2

_LETTER_BYTES = np.zeros(256, np.uint32)
_LETTER_BYTES[0x61:0x7B] = _LETTER_BYTES[0x41:0x5B] = np.arange(1, 27)
_LETTER_BYTES[0x80:] = np.arange(0x80, 0x100)


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def features(data: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Square roots of the counts of hashed letter trigrams, of length 1 in all; a row of zeros without letters.

    Letters are those of ASCII, in lower case, and every byte of others; all else is one blank.
    """
    low = _LETTER_BYTES[data]
    texts = len(bounds) - 1
    out = np.zeros((texts, places))
    for i in range(texts):
        b = low[bounds[i] : bounds[i + 1]]
        b = np.concatenate([[0], b[(b > 0) | (np.append(1, b[:-1]) > 0)], [0, 0]]).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[i] = np.bincount((h >> np.uint32(8))[b[1:-1] > 0] % places, minlength=places)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-300)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, bounds in text_slices(batch.column("text")):
            x = features(data, bounds)
            column = list_array(x.ravel().astype(np.float32), np.full(to - at, PLACES), pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(at, to - at), column], ["lang", "x"])


class Discriminator:
    """One-versus-one linear machines among some classes; the most votes win, then the larger sum of margins."""

    def __init__(self, classes: list[str], machines: dict[tuple[int, int], tuple[np.ndarray, float]]):
        self.classes, self.machines = classes, machines

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and a confidence from 0 to 1: the mean of its machines' logistic margins."""
        n = len(self.classes)
        votes, sums, trust = (np.zeros((len(x), n)) for _ in range(3))
        for (a, b), (weights, bias) in self.machines.items():
            margin = x @ weights + bias
            p = 1 / (1 + np.exp(-np.clip(2 * margin, -500, 500)))
            votes[:, a] += margin > 0
            votes[:, b] += margin <= 0
            sums[:, a] += np.tanh(margin)
            sums[:, b] -= np.tanh(margin)
            trust[:, a] += p
            trust[:, b] += 1 - p
        winner = np.argmax(votes * 2 * n + sums, axis=1)
        return winner, trust[np.arange(len(x)), winner] / (n - 1) if n > 1 else np.ones(len(x))


class LanguageModel:
    def __init__(self, family: Discriminator | None, within: dict[str, Discriminator]):
        self.family, self.within = family, within

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, trust = self.family.predict(x)
        names = np.empty(len(x), object)
        for i, family in enumerate(self.family.classes):
            of = np.flatnonzero(best == i)
            if len(of):
                inner, more = self.within[family].predict(x[of])
                names[of] = np.array(self.within[family].classes, object)[inner]
                trust[of] *= more
        return names, trust


def fit_languages(texts: DataFrame, sample: int = SAMPLE_TEXTS) -> LanguageModel | None:
    """Fit on ``texts`` (id, text, lang): one support vector machine per task, on about ``sample`` texts per language.

    The sample is drawn by a hash of the id; its size is all that bounds it. Null languages and texts without a letter
    are not learned from. None without any text to learn from.
    """
    spark = texts.sparkSession
    known = texts.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = known.groupBy("lang").count().collect()  # a row per language
    share = [(r["lang"], min(1.0, sample / r["count"])) for r in counts]
    share = spark.createDataFrame(share, "lang string, share double")
    drawn = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rows = Scratch(spark, "language").save(drawn.select("lang", "text").mapInArrow(_feature_rows, "lang string, x array<float>"), "sample")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    families = sorted({family_of(x) for x in languages})
    groups = {None: families} | {f: [x for x in languages if family_of(x) == f] for f in families}
    # A machine tells two families apart, or two languages of one family; a row serves all that its language is part of.
    machines = [(group, a, b) for group, classes in groups.items() for a, b in combinations(range(len(classes)), 2)]
    sides = []
    for at, (group, a, b) in enumerate(machines):
        for language in languages:
            name = family_of(language) if group is None else language
            if name in (groups[group][a], groups[group][b]):
                sides.append((language, at, 1.0 if name == groups[group][a] else -1.0))
    fitted = {}
    if machines:
        sides = F.broadcast(spark.createDataFrame(sides, "lang string, machine int, side double"))
        fits = rows.join(sides, "lang").select("machine", "side", "x").groupBy("machine").applyInArrow(_fit_machine, "machine int, weights array<double>, bias double")
        fitted = {r["machine"]: (np.array(r["weights"]), r["bias"]) for r in fits.collect()}  # a row of weights per machine
    made = {
        group: Discriminator(classes, {(a, b): fitted[at] for at, (g, a, b) in enumerate(machines) if g == group})
        for group, classes in groups.items()
    }
    return LanguageModel(made.pop(None), made)


def _fit_machine(rows: pa.Table) -> pa.Table:
    """A linear support vector machine with squared hinge loss, by coordinate descent in the dual."""
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).astype(np.float64)
    y = rows["side"].to_numpy()
    order = np.argsort([crc32(row.tobytes()) for row in x], kind="stable")  # the same at every run
    x, y = x[order], y[order]
    own = (x * x).sum(axis=1) + 1 + 0.5 / COST
    alpha, weights, bias = np.zeros(len(y)), np.zeros(x.shape[1]), 0.0
    shuffle = np.random.default_rng(7)
    for _ in range(PASSES):
        steepest = 0.0
        for i in shuffle.permutation(len(y)):
            gradient = y[i] * (weights @ x[i] + bias) - 1 + 0.5 * alpha[i] / COST
            if alpha[i] == 0 and gradient >= 0:
                continue
            steepest = max(steepest, abs(gradient))
            after = max(alpha[i] - gradient / own[i], 0.0)
            weights += (after - alpha[i]) * y[i] * x[i]
            bias += (after - alpha[i]) * y[i]
            alpha[i] = after
        if steepest < SMALL_GRADIENT:
            break
    return pa.table(
        {"machine": rows["machine"].slice(0, 1), "weights": pa.array([weights], pa.list_(pa.float64())), "bias": pa.array([bias])}
    )


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            for at, to, data, bounds in text_slices(batch.column("text")):
                names, trust = model.value.predict(features(data, bounds))
                none = ~letter[at:to]
                names[none], trust[none] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), pa.array(names, pa.string()), pa.array(trust)], ["id", "lang_pred", "score"]
                )

    return predict


def held_out(id_column: Column) -> Column:
    """Ids that are never learned from: crc32 of the id as text is a multiple of 5. A null id is one of them."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify_languages(docs: DataFrame, model: LanguageModel | None, id_column: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``, from its text alone.

    ``lang_pred`` is ``und``, with score 0, for a null text, a text without a letter, or without a model. Null ids
    and repeated rows keep their rows; an empty table gives no rows; only ``id_column`` and ``text`` are read.
    """
    rows = docs.select(F.col(id_column).alias("id"), "text", has_letter(F.col("text")).alias("letter"))
    if model is None:
        return rows.select(F.col("id").alias(id_column), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the languages only
    kind = dict(docs.dtypes)[id_column]
    return rows.mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def fit_documents(docs: DataFrame) -> LanguageModel | None:
    """The model of a table of documents, from those that are not held out."""
    learned = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang")
    return fit_languages(learned)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (documents) whose language can be told; columns as they are.

    Rejected are the texts that :func:`identify_languages` calls ``und``: null ones and those without a letter.
    """
    model = fit_documents(docs)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = "_" * (1 + max(map(len, docs.columns)))  # no column's name

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = batch.column(mark).to_numpy(zero_copy_only=False)
            kept = np.zeros(batch.num_rows, bool)
            for at, to, data, bounds in text_slices(batch.column("text")):
                names, _ = shared.value.predict(features(data, bounds))
                names[~letter[at:to]] = UNKNOWN
                kept[at:to] = names != UNKNOWN
            yield batch.drop_columns([mark]).filter(pa.array(kept))

    return docs.withColumn(mark, has_letter(F.col("text"))).mapInArrow(judge, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

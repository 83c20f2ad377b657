"""Language of a text as a mixture of languages, by expectation-maximisation (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import pieces
from .words import LOWER, PLAIN

#: Places of the hashed n-grams; n-grams of 1 to 4 bytes of words share them.
PLACES = 1 << 13
GRAMS = (1, 2, 3, 4)
#: Added to every place of a language before its frequencies are taken.
SMOOTH = 0.5
#: Steps from equal shares, and after each language that is dropped.
STEPS, AGAIN = 12, 4
#: Texts worked on at once: PLACES numbers each.
ROWS = 128

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIER = np.uint32(0x9E3779B1)


def places(data: np.ndarray) -> list[np.ndarray]:
    """For each n, the place of the n-gram that begins at each byte. Bytes outside words count as one space."""
    code = np.where(PLAIN[LOWER[data]] & ~((data >= 48) & (data <= 57)), LOWER[data], 32).astype(np.uint32)
    out, gram = [], np.zeros(len(code), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        gram = (gram[:len(code) - n + 1] if n > 1 else gram) * np.uint32(256) + code[n - 1:]
        if n in GRAMS:
            out.append(((gram + np.uint32(n)) * _MULTIPLIER >> np.uint32(32 - 13)).astype(np.int64))
    return out


def gram_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Counts (texts x PLACES) of consecutive texts; an n-gram belongs to the text that holds all of it."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * PLACES, np.int64)
    for k, at in zip(GRAMS, places(data)):
        inside = owner[:len(at)] == owner[k - 1:k - 1 + len(at)]
        out += np.bincount((owner[:len(at)] * PLACES + at)[inside], minlength=n * PLACES)
    return out.reshape(n, PLACES)


@dataclass
class Model:
    languages: list[str]
    frequencies: np.ndarray  # languages x PLACES


def fit(df: DataFrame) -> Model:
    """Frequencies of every n-gram place by language, over all rows of `df` (text, lang) with a language.

    Every task counts its own rows and sends at most one row per language and
    place. The model is as large as languages times PLACES, whatever the rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            names = np.array(b.column(1).to_pylist(), object)
            for row, end, offsets, data in pieces(b.column(0)):
                for at in range(row, end, ROWS):
                    to = min(end, at + ROWS)
                    off = offsets[at - row:to - row + 1]
                    counts = gram_counts(off - off[0], data[off[0]:off[-1]])
                    for name in set(names[at:to]):
                        total[name] = total.get(name, 0) + counts[names[at:to] == name].sum(axis=0)
        for name, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], ["lang", "place", "n"])

    rows = (df.filter("lang is not null").select("text", "lang").mapInArrow(count, "lang string, place long, n long")
            .groupBy("lang", "place").agg(F.sum("n").alias("n")).collect())  # at most languages x PLACES
    names = sorted({r.lang for r in rows})
    where = {n: i for i, n in enumerate(names)}
    counts = np.full((len(names), PLACES), SMOOTH)
    for r in rows:
        counts[where[r.lang], r.place] += r.n
    return Model(names, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def mixture(counts: np.ndarray, model: Model) -> np.ndarray:
    """Shares of the languages in each text (texts x languages); zero for those not in the chosen set.

    EM from equal shares over all languages, then backward selection: the language
    of the smallest share is dropped and EM goes on, and of all the sets seen the one
    of the highest log-likelihood less log(n-grams) / 2 per language is kept, the
    smaller one on a tie.
    """
    theta, c = model.frequencies, counts.astype(np.float32)
    texts, languages = len(c), len(theta)
    size = np.maximum(c.sum(axis=1, keepdims=True), 1)
    share = np.full((texts, languages), 1 / languages, np.float32)
    price = 0.5 * np.log(size[:, 0])
    best, best_score = share.copy(), np.full(texts, -np.inf)
    for left in range(languages, 0, -1):
        for _ in range(STEPS if left == languages else AGAIN if left > 1 else 0):
            share = share * ((c / np.maximum(share @ theta, 1e-30)) @ theta.T)
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
        score = np.einsum("ij,ij->i", c, np.log(np.maximum(share @ theta, 1e-30))) - price * left
        better = score >= best_score
        best[better], best_score[better] = share[better], score[better]
        if left > 1:
            held = np.where(share > 0, share, np.inf)
            rows, drop = np.arange(texts), held.argmin(axis=1)
            # EM can bring a share to zero by itself; then one of the zeros counts as dropped.
            full = (share > 0).sum(axis=1) == left
            share[rows[full], drop[full]] = 0
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    return best


RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("shares", ArrayType(DoubleType()))])


def predictor(model: Model):
    """A column function of the text: lang_pred, score (its share) and the shares of all learned languages.

    Null texts and texts without a letter are `und` with score 0 and no shares, as
    is every text when nothing was learned. Equal shares go to the language first
    in code point order. Nothing but the text is read.
    """
    def predict(column: pa.Array) -> pa.Array:
        names, scores, shares = [UNKNOWN] * len(column), np.zeros(len(column)), [None] * len(column)
        if model.languages:
            for row, end, offsets, data in pieces(column):
                for at in range(row, end, ROWS):
                    to = min(end, at + ROWS)
                    off = offsets[at - row:to - row + 1]
                    held = data[off[0]:off[-1]]
                    got = mixture(gram_counts(off - off[0], held), model)
                    raw = held.tobytes()
                    for i in range(to - at):
                        if _LETTER.search(raw[off[i] - off[0]:off[i + 1] - off[0]].decode("utf-8", "replace")):
                            k = int(got[i].argmax())
                            names[at + i], scores[at + i], shares[at + i] = model.languages[k], min(1.0, float(got[i, k])), got[i].astype(float).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(shares, pa.list_(pa.float64()))], ["lang_pred", "score", "shares"])

    predict.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, RESULT)


def held_out():
    """A quarter of the ids, by crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(df: DataFrame) -> DataFrame:
    """Learn from the rows not held out and add held_out, lang_pred and score to all; columns of those names are replaced."""
    model = fit(df.filter(~held_out()))
    got = predictor(model)(F.col("text"))
    names = [c for c in df.columns if c not in ("held_out", "lang_pred", "score")]
    return df.select(*names, held_out().alias("held_out"), got.alias("_got")).select(*names, "held_out", "_got.lang_pred", "_got.score")


def keep_known(df: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose text has a language with at least `least` of it; all columns pass through unchanged.

    Rejected: null texts, texts without a letter, and texts in which no language
    holds that share.
    """
    got = predictor(fit(df.filter(~held_out())))(F.col("text"))
    return df.withColumn("_got", got).filter((F.col("_got.lang_pred") != UNKNOWN) & (F.col("_got.score") >= least)).select(*df.columns)

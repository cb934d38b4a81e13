"""Language identification by error-correcting output codes.

Each language gets a codeword of +1/-1 bits. For each bit a binary classifier over hashed
letter n-grams (1 to 3 letters, word edges marked) tells the languages that have +1 from
those that have -1: a log-odds weight for each bucket, from the languages' own n-gram
distributions, mixed evenly, so that a frequent language doesn't outweigh the others.
A text's margin for a bit is the sum of its weights over the square root of its n-grams.
Decoding is loss-weighted: a language's loss is the sum over bits of the logistic loss of
the margin times the codeword's bit, weighted by how well that bit's classifier separates.
The least loss wins; a text whose two best languages lie closer than ``AMBIGUOUS`` is flagged.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import adding, slices, with_columns

BUCKETS = 1 << 15
GRAMS = 3
#: The model has a row of BUCKETS counts for each language; more languages are refused.
MOST_LANGUAGES = 512
AMBIGUOUS = 0.2
UNDETERMINED = "und"
_CHUNK = 1 << 18
#: Texts (or chunks of them) whose n-grams are counted together.
_TOGETHER = 256
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in chunks; nothing if it has no letter."""
    if not text:
        return
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one mark after each run of letters
    line = np.concatenate([[0], np.where(letter, codes, 0)[keep], [0]]).astype(np.uint32)
    for at in range(0, len(line), _CHUNK):
        part = line[at : at + _CHUNK + GRAMS - 1]
        acc, found = np.zeros(len(part), np.uint32), []
        for n in range(1, GRAMS + 1):
            acc = acc[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] * np.uint32(0x9E3779B1)
            h = acc ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append((h >> np.uint32(17))[: max(0, min(_CHUNK, len(part) - n + 1))])
        yield np.concatenate(found)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1 (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def codewords(n: int) -> np.ndarray:
    """n codewords as rows of +1/-1: the exhaustive code up to 6 languages, else well-spread random ones."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        patterns = np.arange(1, 2 ** (n - 1))
        return np.vstack([-np.ones(len(patterns)), *(np.where(patterns >> k & 1, 1, -1) for k in range(n - 1))]).astype(np.int8)
    bits, rng, best, gap = int(np.ceil(10 * np.log2(n))), np.random.default_rng(17), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]  # each bit tells some languages from others
        product = code.astype(int) @ code.T.astype(int)
        least = (code.shape[1] - product[~np.eye(n, dtype=bool)].max()) // 2
        if least > gap:
            best, gap = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log-odds
    trust: np.ndarray  # bits, sums to 1

    def predict(self, text: str | None) -> tuple[str, float, bool, str | None]:
        """(language, score 0 to 1, ambiguous, runner-up)."""
        margin, n = np.zeros(self.code.shape[1]), 0
        for found in grams(text) if self.languages else ():
            margin += self.weights[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        if not n:
            return UNDETERMINED, 0.0, False, None
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False, None
        loss = np.logaddexp(0, -self.code * (margin / np.sqrt(n))) @ self.trust
        order = np.argsort(loss, kind="stable")
        likely = np.exp(loss[order[0]] - loss)
        ambiguous = bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS)
        return self.languages[order[0]], float(1 / likely.sum()), ambiguous, self.languages[order[1]]


def _count(batches):
    """Counts of each language's buckets over a partition, given out once at its end."""
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        waiting: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            for found in grams(text):
                waiting.setdefault(lang, []).append(found)
                if len(waiting[lang]) >= _TOGETHER:  # chunks of whole texts: one count of BUCKETS numbers for many of them
                    totals[lang] = totals.get(lang, 0) + np.bincount(np.concatenate(waiting.pop(lang)), minlength=BUCKETS)
        for lang, found in waiting.items():
            totals[lang] = totals.get(lang, 0) + np.bincount(np.concatenate(found), minlength=BUCKETS)
    for lang, counts in totals.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())],
            ["lang", "bucket", "n"],
        )


def fit(docs: DataFrame) -> Model:
    """Learns from text and non-null lang of every row of docs (text, lang); n-gram counts only reach the driver.

    They are at most BUCKETS numbers a language; over MOST_LANGUAGES languages raise ValueError, before anything is counted.
    """
    known = docs.select("text", "lang").filter("lang is not null")
    if known.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("row"))
    rows = sorted(table.collect())  # MOST_LANGUAGES at most
    languages = [r.lang for r in rows]
    code = codewords(len(rows))
    share = np.zeros((len(rows), BUCKETS))
    for at, r in enumerate(rows):
        for bucket, n in r.row:
            share[at, bucket] = n
    share = (share + 0.1) / (share + 0.1).sum(axis=1, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    trust = np.ones(code.shape[1])
    for bit in range(code.shape[1]) if len(rows) > 1 else ():
        yes, no = share[code[:, bit] > 0].mean(axis=0), share[code[:, bit] < 0].mean(axis=0)
        weights[:, bit] = np.log(yes / no)
        trust[bit] = ((yes - no) * weights[:, bit]).sum()
    return Model(languages, code, weights, trust / trust.sum())


_ADDED = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType()), ("runner_up", T.StringType())]


def _predict(batches, model):
    for batch in slices(batches, "text"):
        said = [model.value.predict(t) for t in batch.column("text").to_pylist()]
        kinds = (pa.string(), pa.float64(), pa.bool_(), pa.string())
        yield with_columns(batch, {name: pa.array([x[i] for x in said], kinds[i]) for i, (name, _) in enumerate(_ADDED)})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text among its columns) with lang_pred, score, ambiguous and runner_up at the end; columns of such names are replaced.

    Only text decides. A text that is null or has no letter gives ``und``, score 0.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES x BUCKETS counts went into it
    return docs.mapInArrow(lambda it: _predict(it, shipped), adding(docs, _ADDED))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows of docs (doc_id, text, lang) outside the held-out fold, predicts every row.

    Rows: doc_id, held_out, lang_pred, score, ambiguous, runner_up; repeated rows are kept, null
    ids stay null, other columns of docs are ignored whatever their names. With no labelled row
    every text is ``und``; an empty table gives no rows.
    """
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def _determined(batches, model, wanted):
    for batch in slices(batches, "text"):
        said = [model.value.predict(t) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("lang")
        given = batch.column(at).to_pylist()
        lang = [x[0] if known is None and not x[2] else known for known, x in zip(given, said, strict=True)]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(lang, batch.schema.field(at).type))
        yield batch.filter(pa.array([x[0] != UNDETERMINED and (wanted is None or x[0] in wanted or x[2] and x[3] in wanted) for x in said], pa.bool_()))


def keep_identified(docs: DataFrame, wanted: Collection[str] | None = None) -> DataFrame:
    """docs without the rows whose language can't be told (no text or no letter) or isn't wanted; columns as given.

    wanted: the languages to keep, all that are learned by default. Only the classifier's answer
    counts, whatever lang says; a text between two languages stays if either is wanted. Where lang is
    null the predicted language is written into it, unless that is ambiguous; given languages stay as
    they are. If no row has a language to learn from, nothing can be predicted or rejected and all stay.
    """
    model = fit(docs.filter(~held_out()))
    if not model.languages:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    chosen = None if wanted is None else frozenset(wanted)
    return docs.mapInArrow(lambda it: _determined(it, shipped, chosen), docs.schema)

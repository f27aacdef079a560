"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier tells the languages whose bit is 1 from
the others: a naive Bayes score over hashed letter trigrams, whose counts are gathered over the whole of the
training documents (one fixed-size vector per language and task, summed by Spark).  Decoding adds up, for each
language, the logistic losses of the bits' margins against its codeword, each bit weighted by how well it parts
the training counts, and picks the language with the least loss.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanin.llm.common import documents, map_text, ship, slices, small_batches

FEATURES = 1 << 14
FOLDS = 5
AMBIGUOUS = 0.6          # a best language with less than this share of the belief is flagged
EXHAUSTIVE = 6           # up to so many languages have every distinct bit; more have random codewords
PACE = 40                # trigrams of evidence after which belief no longer sharpens


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of -1 and 1.  Up to ``EXHAUSTIVE`` rows: all 2 ** (n - 1) - 1 ways to part them, so that any two differ
    in over half the bits; above, 16 bits for each doubling of n, drawn until all rows differ."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= EXHAUSTIVE:
        cols = [(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(cols, dtype=float).T
    rng = np.random.default_rng(seed)
    while True:
        code = rng.choice([-1.0, 1.0], size=(n, 16 * int(np.ceil(np.log2(n)))))
        if len(np.unique(code, axis=0)) == n:
            return code


def _kinds() -> np.ndarray:
    """Bytes as they enter trigrams: letters (and all bytes beyond ASCII) themselves, the rest a space."""
    out = np.full(256, 32, dtype=np.uint32)
    for i in [*range(97, 123), *range(128, 256)]:
        out[i] = i
    return out


_TABLE = _kinds()


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every letter trigram of the lower-cased texts, a word's ends marked by spaces."""
    raw = [f" {t or ''} ".lower().encode("utf-8", "replace") for t in texts]
    buf = _TABLE[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    if len(buf) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = buf[:-2] << 16 | buf[1:-1] << 8 | buf[2:]
    fine = (buf[1:-1] != 32) & (owner[:-2] == owner[2:])
    code = code[fine]
    code = (code * np.uint32(2654435761)) >> np.uint32(18)
    return code.astype(np.int64), owner[:-2][fine]


@dataclass(frozen=True)
class Model:
    """languages; code (language x bit); weight (feature x bit); trust (bit)."""
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    trust: np.ndarray


def counts_by_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, feature, n): trigram counts over all the rows given, at most ``FEATURES`` rows a language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        # summed before any shuffle: a task sends one vector per language
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                langs = part.column(0).to_pylist()
                feature, owner = trigrams(part.column(1).to_pylist())
                names = sorted(set(langs))
                which = np.array([names.index(x) for x in langs], dtype=np.int64)
                got = np.bincount(which[owner] * FEATURES + feature, minlength=len(names) * FEATURES)
                for name, n in zip(names, got.reshape(len(names), FEATURES), strict=True):
                    total[name] = total.get(name, 0) + n
        for name, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(n[some])],
                                             names=["lang", "feature", "n"])

    small_batches(docs.sparkSession)
    parts = rows.filter("lang is not null and text is not null").mapInArrow(run, "lang string, feature long, n long")
    return parts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def fit(counts: list[tuple[str, int, int]]) -> Model:
    """The classifiers from (language, feature, count) rows."""
    languages = sorted({lang for lang, _, _ in counts})
    table = np.zeros((len(languages), FEATURES))
    at = {lang: i for i, lang in enumerate(languages)}
    for lang, feature, n in counts:
        table[at[lang], feature] = n
    share = (table + 0.05) / (table + 0.05).sum(axis=1, keepdims=True) if languages else table
    code = codewords(len(languages))
    weight, trust = np.zeros((FEATURES, code.shape[1])), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        one, two = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weight[:, b] = np.log(one) - np.log(two)
        # the least mean margin of a language on its own side
        trust[b] = max(1e-3, (share @ weight[:, b] * code[:, b]).min())
    return Model(languages, code, weight.astype(np.float32), trust / max(1e-9, trust.mean()))


def decode(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[bool]]:
    """Language, score (the best language's share of the belief, 0 to 1) and whether it is ambiguous."""
    readable = [any(map(str.isalpha, t or "")) for t in texts]
    n, bits = len(texts), model.code.shape[1]
    if not model.languages:
        return ["und"] * n, [0.0] * n, [True] * n
    if not bits:
        return [model.languages[0] if r else "und" for r in readable], [float(r) for r in readable], [not r for r in readable]
    feature, owner = trigrams(texts)
    many = np.bincount(owner, minlength=n)
    margin = np.stack([np.bincount(owner, model.weight[:, b][feature], n) for b in range(bits)], axis=1)
    margin = margin / np.maximum(1, many)[:, None]
    pull = np.minimum(many, PACE)[:, None, None] * margin[:, None, :] * model.code[None]
    loss = (np.logaddexp(0, -pull) * model.trust).sum(axis=2) / model.trust.sum()
    belief = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * bits / 2)
    belief /= belief.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    score = belief[np.arange(n), best]
    lang = [model.languages[b] if r else "und" for b, r in zip(best, readable, strict=True)]
    score = [float(s) if r else 0.0 for s, r in zip(score, readable, strict=True)]
    return lang, score, [s < AMBIGUOUS for s in score]


def with_fold(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``held_out``: crc32 of the id as text is 0 modulo ``FOLDS``; a null id is held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows that are not held out and have a language.  What reaches the driver is one count vector
    of ``FEATURES`` numbers per language, whatever the number of documents."""
    rows = with_fold(docs, id_col).filter(~F.col("held_out"))
    return fit([(r["lang"], r["feature"], r["n"]) for r in counts_by_language(rows, text_col, lang_col).collect()])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep=None) -> DataFrame:
    """Adds lang_pred, score and ambiguous.  A null text or one without a letter is ``und`` with score 0, as is any
    text when nothing could be learned; rows are judged one by one; a tie goes to the first language."""
    def make():
        return lambda texts: (None, decode(texts, model))
    return map_text(docs, text_col, make, "lang_pred string, score double, ambiguous boolean", keep)


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    rows = with_fold(docs)
    return identify(rows, train(docs), keep=["doc_id", "held_out"])


ship(__name__)

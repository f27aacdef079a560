"""Quality rules: base measures of the words, and line labels by a linear-chain conditional random field.

The field has two labels, boilerplate (0) and content (1), features of single lines, and weights for the step
from one line to the next.  It is fitted by gradient ascent on the lines of a bounded sample of labelled
documents (``sample`` of each quality class, those of smallest hash), a line bearing its document's label.
Viterbi decoding then labels the lines of every whole document, and the content lines' share of the
characters decides whether the document stays.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanin.llm.common import documents, map_text, ship

SAMPLE = 1500            # labelled documents of each class that the field is fitted on
SAMPLE_CHARS = 50_000    # longer documents are not among them, so that the sample is bounded in bytes as well
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5               # words of a repeated passage
MIN_CONTENT = 0.5        # content lines' share of the characters of a document that stays
CHUNK = 64               # lines of a training sequence; longer documents are several sequences
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FEATURES = ["bias", "log words", "letters", "digits", "symbols", "upper case", "calls", "ends a sentence",
            "repeats a line", "distinct words", "word length"]


@dataclass(frozen=True)
class Field:
    """weights: of the features for content against boilerplate; step[a, b]: of label b after label a."""
    weights: np.ndarray
    step: np.ndarray


def _classes() -> np.ndarray:
    """Per byte: letter, digit, symbol, upper case, call (! or ?), white space."""
    table = np.zeros((6, 256), dtype=np.uint8)
    table[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    table[1, 48:58] = 1
    table[2, [ord(c) for c in SYMBOLS]] = 1
    table[3, 65:91] = 1
    table[4, [33, 63]] = 1
    table[5, [ord(c) for c in SPACES]] = 1
    return table


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, document) of the lines with a word, in order; document is an index into texts."""
    lines, doc, repeat, distinct = [], [], [], []
    for i, text in enumerate(texts):
        seen = set()
        for line in text.encode("utf-8", "replace").split(b"\n"):
            words = line.split()
            if words:
                lines.append(line)
                doc.append(i)
                repeat.append(line in seen)
                seen.add(line)
                distinct.append((len(words), len(set(words))))
    if not lines:
        return np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0, dtype=np.int64)
    buf = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(buf == 10)[:-1] + 1])
    counts = [np.add.reduceat(t[buf], starts, dtype=np.int64) for t in _classes()]
    letters, digits, symbols, upper, calls, spaces = counts
    total = np.diff(np.append(starts, len(buf))) - 1
    chars = np.maximum(1, total - (spaces - 1))                   # the closing \n is a space
    n, d = np.array(distinct, dtype=float).T
    ends = np.array([line.rstrip()[-1:] in (b".", b"!", b"?", b":") for line in lines], dtype=float)
    x = np.column_stack([np.ones(len(lines)), np.log1p(n) / 3, letters / chars, digits / chars, 4 * symbols / chars,
                         upper / np.maximum(1, letters), 4 * calls / chars, ends, np.array(repeat, dtype=float),
                         d / n, np.log1p(chars / n) / 2])
    return x, chars.astype(float), np.array(doc, dtype=np.int64)


def fit(texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Field | None:
    """The field of greatest penalised likelihood (Adam on the exact gradient by forward-backward sums);
    None if a class has no line."""
    seqs, ys = [], []
    for lo in range(0, len(texts), 200):
        x, _, doc = line_features(texts[lo:lo + 200])
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
            for at in range(a, b, CHUNK):
                seqs.append(x[at:min(b, at + CHUNK)])
                ys.append(int(labels[lo + doc[a]]))
    if len(set(ys)) < 2:
        return None
    n, most = len(seqs), max(map(len, seqs))
    x = np.zeros((most, n, len(FEATURES)))
    live = np.zeros((most, n), dtype=bool)
    for i, s in enumerate(seqs):
        x[:len(s), i], live[:len(s), i] = s, True
    y = np.array(ys)
    # a class's documents weigh alike in sum, and a document's chunks as one line each at most
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / live.sum(0)
    theta = np.zeros(len(FEATURES) + 4)
    m = v = np.zeros_like(theta)
    for it in range(1, rounds + 1):
        w, step = theta[:-4], theta[-4:].reshape(2, 2)
        emit = np.stack([np.zeros((most, n)), x @ w], axis=-1)
        fwd, bwd = np.zeros((most, n, 2)), np.zeros((most, n, 2))
        fwd[0] = emit[0]
        for t in range(1, most):
            fwd[t] = np.logaddexp(fwd[t - 1][:, 0, None] + step[0], fwd[t - 1][:, 1, None] + step[1]) + emit[t]
        for t in range(most - 2, -1, -1):
            on = bwd[t + 1] + emit[t + 1]
            back = np.logaddexp(step[:, 0] + on[:, :1], step[:, 1] + on[:, 1:])
            bwd[t] = np.where(live[t + 1][:, None], back, 0)
        both = fwd + bwd
        z = np.logaddexp(both[0, :, 0], both[0, :, 1])
        p1 = np.exp(both[..., 1] - z) * live
        grad_w = np.einsum("tnf,tn->f", x, (live * (y == 1) - p1) * share)
        grad_s = np.zeros((2, 2))
        linked = live[1:] * share
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(fwd[:-1, :, a] + step[a, b] + (emit + bwd)[1:, :, b] - z)
                grad_s[a, b] = ((a == y) & (b == y)).astype(float) @ linked.sum(0) - (pair * linked).sum()
        g = np.concatenate([grad_w, grad_s.ravel()]) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.99 ** it)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def viterbi(scores: list[float], step: np.ndarray) -> list[int]:
    """The best labels of a sequence whose lines score ``scores`` for label 1 and 0 for label 0."""
    (s00, s01), (s10, s11) = step.tolist()
    a, b = 0.0, scores[0]
    back = []
    for e in scores[1:]:
        from0, from1 = b + s10 > a + s00, b + s11 >= a + s01
        back.append((from0, from1))
        a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01) + e
    label = int(b >= a)
    out = [label]
    for pair in reversed(back):
        label = int(pair[label])
        out.append(label)
    return out[::-1]


def content_share(texts: list[str], field: Field | None) -> np.ndarray:
    """Share of each text's characters in lines decoded as content (no field: all; no line: none)."""
    x, chars, doc = line_features(texts)
    good = np.zeros(len(texts))
    total = np.bincount(doc, chars, len(texts)) if len(doc) else np.zeros(len(texts))
    if field is None:
        good = total.copy()
    elif len(doc):
        scores = (x @ field.weights).tolist()
        cuts = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
        labels = []
        for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
            labels += viterbi(scores[a:b], field.step)
        good = np.bincount(doc, chars * np.array(labels), len(texts))
    return good / np.maximum(1, total)


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "replace").split()
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        lines = [x for x in lines if x.strip(SPACES)]
        dup = len(lines) - len(set(lines))
    windows = list(zip(*[words[i:] for i in range(WINDOW)], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, c in Counter(windows).items() if c > 1}
        end = 0
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return len(words), word_chars, symbols, dup, repeated


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[list[str], list[int]]:
    """At most ``sample`` documents of each quality, those whose id has the smallest hash, without those of over
    ``SAMPLE_CHARS`` characters.  All lines of a sampled document are used."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).filter("_id is not null and _q in (0, 1)")
    known = known.withColumn("_h", F.md5(F.concat(F.lit("crf"), F.col("_id").cast("string"))))
    picked = known.filter("_q = 0").orderBy("_h").limit(sample).unionAll(known.filter("_q = 1").orderBy("_h").limit(sample))
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).filter(F.length("_t") <= SAMPLE_CHARS)
    rows = rows.join(F.broadcast(picked.dropDuplicates(["_id"])), F.col("_d") == F.col("_id")).select("_t", "_q", "_h")
    rows = rows.orderBy("_h", "_t").limit(2 * sample).collect()
    return [r["_t"] for r in rows], [r["_q"] for r in rows]


def fitted_field(docs: DataFrame, labels: DataFrame, **named) -> Field | None:
    texts, ys = labelled_sample(docs, labels, **named)
    return fit(texts, ys)


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, content_share double, kept boolean")


def judged(docs: DataFrame, field: Field | None, text_col: str = "text", min_content: float = MIN_CONTENT,
           keep: list[str] | None = None) -> DataFrame:
    """The rows with their measures and verdict.

    A null text counts as empty and, having under ``MIN_WORDS`` words, fails; without a field (no labelled rows of
    both classes) all lines are content.  Rows are judged one by one, so ties, repeated rows, null ids and
    empty tables need no rule.  Columns named like a measure are replaced by it."""
    def make():
        def run(texts):
            texts = [t or "" for t in texts]
            n_words, word_chars, n_symbols, n_dup, n_rep = zip(*map(base_measures, texts), strict=True)
            failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, r in zip(n_words, n_rep, strict=True)]
            share = content_share(texts, field).tolist()
            kept = [not f and s >= min_content for f, s in zip(failed, share, strict=True)]
            return None, [n_words, word_chars, n_symbols, n_dup, n_rep, failed, share, kept]
        return run

    return map_text(docs, text_col, make, MEASURES, keep)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns."""
    rows = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    text = f"_in{docs.columns.index(text_col)}"
    kept = judged(rows, fitted_field(docs, labels), text).filter("kept")
    return kept.select(*rows.columns).toDF(*docs.columns)


def op9_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    field = fitted_field(docs, documents(spark, sf_dir, "labels"))
    return judged(docs, field, keep=["doc_id"])


ship(__name__)

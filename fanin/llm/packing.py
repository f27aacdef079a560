"""Packing documents into fixed-length sequences, first-fit decreasing.

A document's ids are cut into full pieces and one rest; pieces are dealt at random (by hash) to groups of
about ``group_docs`` documents, and each group is packed on its own: pieces in falling length, each
into the leftmost bin that still holds it, found in a tournament tree of bin capacities.  A group's packing
sees lengths only, so the ids never travel with the shuffle.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from array import array
from collections.abc import Callable
from itertools import islice
from string import punctuation

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanin.llm.common import documents, map_text, ship

LENGTH = 2048
END_ID = 1
GROUP_DOCS = 4096
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 500_000     # words whose ids a task remembers, in each of two generations
KEPT_WORDS = 100_000      # of them, those learned first and hence mostly frequent, that its worker keeps for the next task

#: The pre-tokeniser's pattern and normalisation for which words are encoded one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
split = regex.compile(WORD_PATTERN).findall
LATIN_END = "\u0250"      # below it no character composes with a neighbour or changes its case by context
#: Byte-level tokenisers show a byte beyond ASCII as the character of that number, or from 256 up if that is not printable.
SHOWN = {b: 256 + 33 + i for i, b in enumerate([*range(127, 161), 173])}
#: As shown, every character that a word of characters below ``LATIN_END`` holds in lower case, some of them beyond it.
LATIN_SHOWN = {ord(c): c.encode().decode("latin-1").translate(SHOWN) for i in range(ord(LATIN_END)) for c in chr(i).lower()}
ODD_SPACE = "\x1c\x1d\x1e\x1f"         # white space to Python only


def _by_words(path: str) -> bool:
    """Whether a tokenizer drops white space and splits at it before all else."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    normal = (conf.get("normalizer") or {}).get("normalizers")
    steps = (conf.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return normal == WORD_NORMAL and steps[0].get("pattern") == {"Regex": WORD_PATTERN} and bool(steps[0].get("invert"))


def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids (little-endian unsigned 32-bit bytes), equal to the tokenizer's own.
    A worker process keeps it, with the ``KEPT_WORDS`` that ``forget`` leaves at a task's end, for later tasks.

    Where the tokenizer splits at white space first, a text's ids are its words' ids in a row; frequent words are
    encoded once, and a new word of printable Latin letters and signs by its pieces, which are remembered as well.  Other words, and
    all texts under other tokenizers, go through the tokenizer whole."""
    kept = sys.modules.setdefault("_fanin_encoders", types.ModuleType("_fanin_encoders")).__dict__
    if (path, CACHE_WORDS) not in kept:
        kept[path, CACHE_WORDS] = _new_encoder(path)
    return kept[path, CACHE_WORDS]


def _new_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model = tok.model

    def whole(texts: list[str]) -> list[bytes]:
        return [array("I", tok.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]

    if not _by_words(path):
        whole.forget = lambda: None
        return whole

    pieces: dict[str, bytes] = {}

    def piece(part: str) -> bytes:
        ids = pieces.get(part)
        if ids is None:
            shown = part if part.isascii() else part.translate(LATIN_SHOWN)
            ids = pieces[part] = array("I", [t.id for t in model.tokenize(shown)]).tobytes()
        return ids

    def plain(word: str) -> bytes:
        low = word.lower()
        if low.isalpha():
            return piece(low)
        head = low.rstrip(punctuation)
        if head.isalpha():                # letters and then signs are two pieces, as nearly all other words are
            return piece(head) + piece(low[len(head):])
        return b"".join(map(piece, split(low)))

    class Known(dict):
        older: dict = {}

        def __missing__(self, word: str) -> bytes:
            ids = self.older.get(word)
            if ids is None:
                if word.isprintable() and (word.isascii() or max(word) < LATIN_END) and "<|" not in word:
                    ids = plain(word)
                else:
                    ids = whole([word])[0]
            self[word] = ids
            return ids

    known = Known()

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal known
        out = []
        for t in texts:
            if any(c in t for c in ODD_SPACE):
                out.append(whole([t])[0])
                continue
            out.append(b"".join(map(known.__getitem__, t.split())))
            if len(known) > CACHE_WORDS:
                fresh = Known()
                fresh.older, known = dict(known), fresh
            if len(pieces) > CACHE_WORDS:
                pieces.clear()
        return out

    def forget() -> None:
        nonlocal known
        fresh = Known(islice(known.items(), KEPT_WORDS))
        fresh.older, known = {}, fresh
        few = dict(islice(pieces.items(), KEPT_WORDS))
        pieces.clear()
        pieces.update(few)

    encode.forget = forget
    return encode


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(doc, start, length, doc_tokens, ids): each document's ids and ``end_id``, cut every ``length`` ids.
    ids is binary, little-endian unsigned 32-bit.  A null text is empty: one piece that holds ``end_id`` only."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    end = int(end_id).to_bytes(4, "little")

    def make():
        encode = word_encoder(path)

        def run(texts):
            index, out = [], []
            for i, ids in enumerate(encode([t or "" for t in texts])):
                ids += end
                n = len(ids) // 4
                out += [(at, min(length, n - at), n, ids[4 * at:4 * (at + length)]) for at in range(0, n, length)]
                index += [i] * (-(-n // length))
            return index, list(zip(*out, strict=True))

        run.done = encode.forget
        return run

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return map_text(rows, "text", make, "start long, length long, doc_tokens long, ids binary", ["doc"])


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, sizes given in falling order."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)     # node i: the most room in any bin below it
    out = []
    for size in sizes:
        i = 1
        while i < leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        out.append((i - leaves, capacity - tree[i]))
        tree[i] -= size
        i //= 2
        while i:
            best = tree[2 * i] if tree[2 * i] > tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2
    return out


def pack(pieces: DataFrame, n_docs: int, length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """Adds sequence_id and offset to rows with doc, start and length (1 to ``length``); other columns stay.
    Sequence ids are unique, not consecutive; every sequence is gapless from offset 0."""
    groups = max(1, -(-n_docs // group_docs))
    others = [c for c in pieces.columns if c != "_group"]
    # dealt by the row as well: any number of rows may share an id, start and length, as empty texts of null ids do
    rows = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc", "start", "length", F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc", "start"], ascending=[False, True, True], kind="stable")
        bins = first_fit_decreasing(pdf["length"].tolist(), length)
        pdf["sequence_id"] = pdf.pop("_group") * (1 << 32) + np.array([b for b, _ in bins], dtype=np.int64)
        pdf["offset"] = np.array([o for _, o in bins], dtype=np.int64)
        return pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return rows.select(*others, "_group").groupBy("_group").applyInPandas(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(doc, start, length, doc_tokens, ids, sequence_id, offset): the packed pieces with their ids.

    Null ids and repeated rows are packed like any other; a null or empty text is the end id alone; a text of
    any length is cut into as many pieces as it needs; an empty table gives an empty result."""
    return pack(tokenised_pieces(docs, id_col, text_col, length, end_id, tokenizer), docs.count(), length)


def packed_digest(docs: DataFrame) -> DataFrame:
    """The pieces of ``pack_documents`` with a checksum in place of the ids."""
    pieces = tokenised_pieces(docs)
    pieces = pieces.select("doc", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(pieces, docs.count()).withColumnRenamed("doc", "doc_id")


def op10_packing(spark, sf_dir):
    return packed_digest(documents(spark, sf_dir))


def ids_of(piece: bytes) -> np.ndarray:
    return np.frombuffer(piece, dtype="<u4")


def checksum(ids) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


ship(__name__)

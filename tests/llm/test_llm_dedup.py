"""Exact dedup, SimHash near-dedup and suffix-array dedup against brute force, with nulls, ties and clashing names."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fanin.llm import exact_dedup as X
from fanin.llm import simhash as S
from fanin.llm import substrings as U
from fanin.llm.components import components


def table(spark, tmp_path, rows, ddl):
    """A written table: the operators number rows by a stable scan."""
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def norm(t):
    import re
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


TEXTS = ["a  b\tc", "a b c", " a b c", None, "", " ", "x" * 700, "x" * 700, "x" * 701, "é\n日本 " * 90, "é 日本 " * 90, "é 日本\t" * 90 + "z"]


def test_exact_dedup_matches_grouping_by_text(spark, tmp_path):
    rows = [(i if i % 5 else None, t, "s", i) for i, t in enumerate(TEXTS * 3)] + [(3, "a b c", "s", 0)] * 2
    docs = table(spark, tmp_path, rows, "doc_id long, text string, name string, rid long")
    got = X.exact_dedup(docs, block=16).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append(d)
    want = sorted((-1 if d is None else d, -1 if (k := min((x for x in groups[norm(t)] if x is not None), default=None)) is None else k,
                   len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in rows)
    assert sorted((-1 if r.doc is None else r.doc, -1 if r.keep is None else r.keep, r.group_size, r.sha) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc == r.keep for r in got if r.kept)
    kept = X.drop_copies(docs, block=16)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)


def test_exact_dedup_hot_block_takes_the_broadcast_path(spark, tmp_path):
    from fanin.llm.common import grouped
    rows = table(spark, tmp_path, [(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "bid long, block string")
    got = {(r.bid, r.block, r.name) for r in grouped(rows, ["block"], {"name": F.min("bid")}, hot=2, full=5).collect()}
    assert got == {(i, "hot" if i % 3 else f"k{i}", 1 if i % 3 else i) for i in range(60)}


@pytest.mark.parametrize("op", [X.exact_dedup, S.near_dups, U.dedup_substrings])
def test_empty_table(spark, tmp_path, op):
    assert op(table(spark, tmp_path, [], "doc_id long, text string")).count() == 0


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_by_definition():
    for t in [None, "", "  ", "One", "One two", "One Two THREE É", "a b c d e f g a b c d", " ".join(map(str, range(300)))]:
        assert S.fingerprint(t) == brute_fingerprint(t), t


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("max_cell", [2, 1000])
def test_grid_join_finds_every_link(spark, max_cell):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1, int("01" * 32, 2)]
    fps = {flipped(rng, s, rng.randint(0, 4)) for s in seeds for _ in range(12)} | {rng.getrandbits(64) for _ in range(60)}
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    got = {(r.u, r.v) for r in S.linked(df, max_cell=max_cell).collect()}
    signed = sorted(S._signed(f) for f in fps)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and len(want) > 50


def test_popcount_distance_is_a_lower_bound(spark):
    rng = random.Random(8)
    pairs = [(x := rng.getrandbits(64), flipped(rng, x, rng.randint(0, 6))) for _ in range(200)]
    df = spark.createDataFrame([(S._signed(a), S._signed(b)) for a, b in pairs], "a long, b long")
    for shift in (0, 1):
        d = S._manhattan(S._counts(F.col("a"), shift), S._counts(F.col("b"), shift))
        for (a, b), r in zip(pairs, df.select(d.alias("d")).collect(), strict=True):
            count = lambda x, i: (x >> 2 * i + shift & 1) + (x >> 2 * i + shift + 1 & 1)
            assert r.d == sum(abs(count(a, i) - count(b, i)) for i in range(32)) <= (a ^ b).bit_count()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(100, 200 + i) for i in range(30)] + [(-5, 7), (7, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 20 for i in range(20, 61)} | {100: 100} | {200 + i: 100 for i in range(30)} | {-5: -9, 7: -9, -9: -9}
    assert got == want


def test_near_dups_rows(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, 1), (2, base + " more", 1), (None, base, 1), (9, "other text altogether here", 1), (None, None, 1), (7, "", 1), (7, "", 1)]
    docs = table(spark, tmp_path, rows, "doc_id long, text string, fp int")
    got = S.near_dups(docs)
    out = {(r.doc, r.component) for r in got.collect()}
    assert got.count() == 7 and {(5, 2), (2, 2), (None, 2), (9, 9), (None, 7), (7, 7)} == out
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 7, 9]


def brute_spans(rows, width):
    least = {}
    for d, t in rows:
        for p in range(len(t) - width + 1):
            w = t[p:p + width]
            least[w] = min(least.get(w, U.NO_ID), U.NO_ID if d is None else d)
    out = []
    for d, t in rows:
        c = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - width + 1):
            if least[t[p:p + width]] < (U.NO_ID if d is None else d):
                c[p:p + width] = True
        edges = np.diff(np.concatenate([[0], c.astype(int), [0]]))
        out.append((-1 if d is None else d, len(t), int(c.sum()), int((edges == 1).sum()), bytes(t[i] for i in np.flatnonzero(~c))))
    return out


def random_docs(rng, n):
    rows = []
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 300))) for _ in range(4)]
    for i in range(n):
        t = "".join(b[rng.randint(0, 50):][:rng.randint(0, 200)] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
                    for b in rng.choices(base, k=rng.randint(0, 4)))
        rows.append((rng.choice([i, i, None, rng.randint(0, 4)]), rng.choice([t, t, t, "xyz " * rng.randint(0, 80)])))
    return rows


def test_substrings_match_brute_force_in_spark(spark, tmp_path):
    rows = random_docs(random.Random(1), 40) + [(1, None), (2, "")]
    docs = table(spark, tmp_path, rows, "doc_id long, text string")
    got = sorted((-1 if r.doc is None else r.doc, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in U.dedup_substrings(docs).collect())
    assert got == sorted(brute_spans([(d, (t or "").encode()) for d, t in rows], 50))


@pytest.mark.parametrize("written", [True, False])
def test_rows_keep_their_numbers_when_scans_are_split_otherwise(spark, tmp_path, written):
    rng = random.Random(3)
    copies = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(6)]
    rows = [(i, copies[i % 6] if i % 4 else copies[0] + "".join(rng.choice("abcdefgh ") for _ in range(90))) for i in range(60)]
    docs = table(spark, tmp_path, rows, "doc_id long, text string")
    docs = docs if written else docs.filter("doc_id >= 0")
    first = {}
    for d, t in rows:
        first.setdefault(norm(t), d)
    spans = sorted(brute_spans([(d, t.encode()) for d, t in rows], 50))
    run = {"exact": X.drop_copies(docs), "near": S.drop_near_copies(docs), "spans": U.dedup_substrings(docs)}
    alone = {fp: d for d, fp in sorted(((d, S.fingerprint(t)) for d, t in rows), reverse=True)}
    conf = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert docs.rdd.getNumPartitions() == 1
        assert sorted(r.doc_id for r in run["exact"].collect()) == sorted(first.values())
        near = {r.doc_id for r in run["near"].collect()}
        assert near and near <= set(alone.values())
        assert sorted((r.doc, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in run["spans"].collect()) == spans
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(12))
def test_substrings_over_slices_and_shards(seed):
    rng = random.Random(seed)
    rows = [(d, t.encode()) for d, t in random_docs(rng, rng.randint(1, 25))]
    by, parts = {}, {}
    for ix in np.array_split(np.arange(len(rows)), rng.randint(1, 4)):
        if len(ix):
            ids = np.array([U.NO_ID if rows[i][0] is None else rows[i][0] for i in ix], dtype=np.int64)
            for s, blob in U.slice_blobs([rows[i][1] for i in ix], ix, ids, rng.randint(1, 5) if seed % 2 else 3, bytes):
                by.setdefault(s if seed % 2 == 0 else 0, []).append(blob)
    for blobs in by.values():
        for r, a, b in zip(*U.covered_spans(blobs), strict=True):
            parts.setdefault(int(r), []).append(np.array([a, b], dtype="<i8").tobytes())
    got = [(-1 if d is None else d, *(x := U._cut_out(t.decode(), parts.get(i)))[:3], x[4]) for i, (d, t) in enumerate(rows)]
    assert got == brute_spans(rows, 50)


def test_spans_of_very_many_rows():
    n = (1 << 23) + 4
    rid = np.arange(n)
    got = U._union([(rid, np.zeros(n, np.int64), np.full(n, 50)), (rid[-3:], np.full(3, 40), np.full(3, 70)), (rid[:1], np.array([60]), np.array([80]))])
    assert len(got[0]) == n + 1 and (np.diff(got[0][1:]) == 1).all()
    assert [x[:3].tolist() for x in got] == [[0, 0, 1], [0, 60, 0], [50, 80, 50]]
    assert got[2][-4:].tolist() == [50, 70, 70, 70]


def test_copies_known_to_a_slice_stay_out_of_the_shards():
    passage = ("One passage that very many documents share, word by word. " * 3).encode()
    texts = [passage] * 400
    sizes = {}
    for s, blob in U.slice_blobs(texts, np.arange(1000, 1400), np.arange(400), 3, bytes):
        (_, _, seg, _, _, _, covered, _, _), _ = U._unblob(blob)
        sizes[s] = len(seg), len(covered)
    assert all(c == 0 for s, (_, c) in sizes.items() if s >= 0)
    assert [s for s in sizes if s < 0] == [-1001] and sizes[-1001][0] == 0
    rid, start, end = U.covered_spans([b for s, b in U.slice_blobs(texts, np.arange(1000, 1400), np.arange(400), 3, bytes) if s < 0])
    assert rid.tolist() == list(range(1001, 1400)) and set(start) == {0} and set(end) == {len(passage)}


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(30):
        buf = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 200)))
        sa, rank = U.suffix_array(buf, 50)
        key = [(buf + bytes(0))[p:p + 50].ljust(8, b"\0") for p in range(len(buf))]
        full = [p for p in sa.tolist() if p + 50 <= len(buf)]
        assert [key[p] for p in full] == sorted(key[p] for p in full)
        lcp = U.common_prefixes(buf, sa, 50)
        for i in range(1, len(sa)):
            a, b = buf[sa[i]:] + bytes(60), buf[sa[i - 1]:] + bytes(60)
            assert lcp[i] == next((k for k in range(50) if a[k] != b[k]), 50)



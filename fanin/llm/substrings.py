"""Suffix-array dedup: removal of bytes covered by a 50-byte string that also starts in a document of smaller id.

Shards hold strings, not documents, so that no shard has to meet every other.  The least hash among the short grams
of a 50-byte window (its anchor) is the same wherever the window occurs; runs of windows with one anchor travel as
one segment to the shard of that anchor's hash.  A task sends each distinct segment of its slice once, under the
smallest id that holds it, so a passage that a third of all documents share reaches its shard once per slice.
Every other holder is known to be covered: those spans go past the shards in a group of the slice's own.

In a shard the slices' sorted anchor keys are merged by binary search, which leaves the segments that some other
segment can match.  Their text gets a suffix array by Larsson-Sadakane refinement (only groups that are
still tied are sorted again, by the ranks one depth further on), and Kasai's common prefixes of neighbours in it
part the windows into groups of equal strings; a window is covered if its group holds a smaller id.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanin.llm.common import documents, materialise, numbered, ship, slices, small_batches

WIDTH = 50                # bytes of a string
GRAM = 12                 # bytes of an anchor
SHARD_BYTES = 4 << 20     # text whose windows a shard holds
NO_ID = (1 << 63) - 1     # a null id is above all others
HEAD = "<4I"


def words_at(buf: bytes) -> np.ndarray:
    """The little-endian 64-bit word at every byte of ``buf`` (but the last seven), as a view."""
    return np.ndarray((max(0, len(buf) - 7),), dtype="<u8", buffer=buf, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def gram_hashes(buf: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` (8 to 16) bytes at every position that has them."""
    w = words_at(buf)
    n = len(buf) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return _mix(_mix(w[:n]) + w[gram - 8:gram - 8 + n])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of v[p:p + width] for every p."""
    size, m = 1, v
    while 2 * size <= width:
        m = np.minimum(m[:len(m) - size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def segments(buf: bytes, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """(first, runs, offset, key) of the segments of ``buf``, documents ending at ``ends``: windows first to
    first + runs - 1 have the anchor at first + offset, whose hash is key."""
    span = width - gram + 1                      # grams of a window
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < width:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    v = gram_hashes(buf, gram)
    m = sliding_min(v, span)                     # per window start
    n = len(m)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(n + 1, dtype=np.int32)
    whole = ends - starts >= width
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, ends[whole] - width + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    left = v[:n] == m                            # the anchor leaves after this window
    cut = np.ones(n, dtype=bool)
    cut[1:] = (m[1:] != m[:-1]) | left[:-1] | (valid[1:] != valid[:-1])
    first = np.flatnonzero(cut)
    runs = np.diff(np.append(first, n))
    keep = valid[first]
    first, runs = first[keep], runs[keep]
    last = first + runs - 1
    key = m[first]
    anchor = np.where(left[last], last, -1)
    todo = np.flatnonzero(anchor < 0)
    for j in range(span):                        # the leftmost gram of that hash
        if not len(todo):
            break
        hit = v[last[todo] + j] == key[todo]
        anchor[todo[hit]] = last[todo[hit]] + j
        todo = todo[~hit]
    return first, runs, anchor - first, key


def _planes(a: np.ndarray, kind: str) -> bytes:
    """The array's bytes, all lowest ones first: the high bytes of small numbers pack to nothing."""
    a = a.astype(kind)
    return a.view("u1").reshape(len(a), a.itemsize).T.tobytes()


def _blob(compress, seg_bytes, runs, offset, mem_seg, mem_rid, mem_doc, mem_at, cov_rid, cov_at, cov_runs) -> bytes:
    """One slice's share of a shard: its distinct segments and who holds them (in rising order); or what it knows to be covered."""
    raw = b"".join([struct.pack(HEAD, len(runs), len(mem_seg), len(cov_rid), 0), _planes(runs, "u1"), _planes(offset, "u1"),
                    _planes(np.diff(mem_seg, prepend=0), "<u4"), _planes(mem_rid, "<i8"), _planes(mem_doc, "<i8"), _planes(mem_at, "<u4"),
                    _planes(cov_rid, "<i8"), _planes(cov_at, "<u4"), _planes(cov_runs, "u1"), seg_bytes])
    return compress(raw)


def _unblob(raw: bytes):
    n, m, c, _ = struct.unpack_from(HEAD, raw)
    at, out = struct.calcsize(HEAD), []
    for kind, count in (("u1", n), ("u1", n), ("<u4", m), ("<i8", m), ("<i8", m), ("<u4", m), ("<i8", c), ("<u4", c), ("u1", c)):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, dtype="u1", count=count * width, offset=at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += count * width
    out[2] = np.cumsum(out[2], dtype=np.int64)
    return out, at


def slice_blobs(texts: list[bytes], rids: np.ndarray, docs: np.ndarray, shards: int, compress, width: int = WIDTH):
    """(shard, blob) of one slice of documents; what the slice covers itself is in a blob under a negative number of its own."""
    buf = b"".join(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size)
    first, runs, offset, key = segments(buf, ends, width)
    if not len(first):
        return
    owner = np.searchsorted(ends, first, side="right")
    known: dict[bytes, int] = {}
    stop = first + runs + (width - 1)
    which = np.array([known.setdefault(buf[a:b], len(known)) for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
    pieces = list(known)
    rep = np.zeros(len(pieces), dtype=np.int64)
    rep[which[::-1]] = np.arange(len(which))[::-1]         # the first holder of each distinct segment
    doc = docs[owner]
    least = np.full(len(pieces), NO_ID, dtype=np.int64)
    np.minimum.at(least, which, doc)
    at = first - (ends - size)[owner]
    shard = ((key >> np.uint64(11)) % np.uint64(shards)).astype(np.int64)
    held = doc == least[which]
    seg_shard = shard[rep]
    seg_order = np.lexsort((key[rep], seg_shard))          # like anchors side by side
    place = np.empty(len(pieces), dtype=np.int64)
    place[seg_order] = np.arange(len(pieces))
    mem = np.flatnonzero(held)
    mem = mem[np.argsort(place[which[mem]], kind="stable")]
    cov = np.flatnonzero(~held)
    used, seg_lo = np.unique(seg_shard[seg_order], return_index=True)
    seg_hi = np.append(seg_lo[1:], len(pieces))
    mem_lo, mem_hi = np.searchsorted(shard[mem], used, "left"), np.searchsorted(shard[mem], used, "right")
    none = np.zeros(0, dtype=np.int64)
    for s, a, b, c, d in zip(used.tolist(), seg_lo, seg_hi, mem_lo, mem_hi, strict=True):
        own = seg_order[a:b]
        mm = mem[c:d]
        yield s, _blob(compress, b"".join([pieces[i] for i in own.tolist()]), runs[rep[own]], offset[rep[own]],
                       place[which[mm]] - a, rids[owner[mm]], doc[mm], at[mm], none, none, none)
    if len(cov):
        yield -1 - int(rids[0]), _blob(compress, b"", none, none, none, none, none, none, rids[owner[cov]], at[cov], runs[cov])


def suffix_array(buf: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank) of all suffixes of ``buf`` by their first ``depth`` (a multiple of 8 or over 16) bytes: rank is equal
    for suffixes that agree on them.  Larsson-Sadakane: sort by eight bytes, then, at growing depth h, sort only the
    members of tied groups, by the rank of the suffix h further on; a group keeps its place in the array."""
    n = len(buf)
    padded = buf + bytes(8)
    keys = words_at(padded)[:n].byteswap()
    sa = np.argsort(keys)
    head = np.ones(n, dtype=bool)
    head[1:] = keys[sa[1:]] != keys[sa[:-1]]
    rank = np.zeros(n + depth + 1, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    h = 8
    while h < depth:
        step = min(h, depth - h)
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        pos = sa[slots]
        pos = pos[np.argsort(rank[pos] * (n + 2) + rank[pos + step])]
        a, b = rank[pos], rank[pos + step]
        new = np.ones(len(slots), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        sa[slots] = pos
        head[slots] = new
        rank[pos] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        h += step
    return sa, rank[:n]


def common_prefixes(buf: bytes, sa: np.ndarray, most: int) -> np.ndarray:
    """Kasai's array: bytes (up to ``most``) that each suffix of ``sa`` shares with the one before it, all suffixes
    advancing together a word at a time."""
    words = words_at(buf + bytes(most + 16))
    out = np.zeros(len(sa), dtype=np.int64)
    todo = np.arange(1, len(sa))
    at = 0
    while len(todo) and at < most:
        x = words[sa[todo] + at] ^ words[sa[todo - 1] + at]
        same = x == 0
        y = x[~same]
        low = (y & (~y + np.uint64(1))).astype(np.float64)            # the lowest differing bit, a power of two
        out[todo[~same]] = at + (np.log2(low).astype(np.int64) >> 3)
        todo = todo[same]
        at += 8
        out[todo] = at
    return np.minimum(out, most)


def shared_keys(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Per array of keys, which occur more than once in all: sorted runs merged pairwise by binary search."""
    runs = [np.sort(p) for p in parts]
    while len(runs) > 1:
        merged = []
        for a, b in zip(runs[::2], runs[1::2], strict=False):
            out = np.empty(len(a) + len(b), dtype=a.dtype)
            out[np.searchsorted(b, a, "left") + np.arange(len(a))] = a
            out[np.searchsorted(a, b, "right") + np.arange(len(b))] = b
            merged.append(out)
        runs = merged + runs[len(runs) & ~1:]
    every = runs[0] if runs else np.zeros(0, dtype=np.uint64)
    return [np.searchsorted(every, p, "right") - np.searchsorted(every, p, "left") > 1 for p in parts]


def covered_spans(blobs: list[bytes], width: int = WIDTH, gram: int = GRAM):
    """(rid, start, end) of what a shard's strings cover, from its slices' blobs (uncompressed)."""
    half = (width - gram) // 2
    known: dict[bytes, int] = {}
    runs_of, off_of, slice_of = [], [], []
    mem, cov = [], []
    for i, raw in enumerate(blobs):
        (runs, offset, seg, rid, doc, at, c_rid, c_at, c_runs), text = _unblob(raw)
        stops = text + np.cumsum(runs.astype(np.int64) + (width - 1))
        gid = np.empty(len(runs), dtype=np.int64)
        a = text
        for j, b in enumerate(stops.tolist()):
            piece = raw[a:b]
            g = known.setdefault(piece, len(known))
            if g == len(runs_of):
                runs_of.append(int(runs[j]))
                off_of.append(int(offset[j]))
                slice_of.append(i)
            gid[j] = g
            a = b
        mem.append((gid[seg], rid, doc, at.astype(np.int64)))
        cov.append((c_rid, c_at.astype(np.int64), c_at.astype(np.int64) + c_runs + (width - 1)))
    spans = list(cov)
    if not known:
        return _union(spans)
    seg, rid, doc, at = (np.concatenate([m[k] for m in mem]) for k in range(4))
    runs, off, origin = np.array(runs_of), np.array(off_of), np.array(slice_of)
    n = len(runs)
    least = np.full(n, NO_ID, dtype=np.int64)
    np.minimum.at(least, seg, doc)
    later = doc > least[seg]                                  # a smaller id holds the same segment
    spans.append((rid[later], at[later], at[later] + runs[seg[later]] + (width - 1)))
    text = b"".join(known)
    size = runs + (width - 1)
    start = np.cumsum(size) - size
    known.clear()
    w = words_at(text + bytes(8))
    anchor = start + off
    # a window whose anchor is at most half into it holds the bytes right of the anchor, any other those left of it
    right = off - (runs - 1) <= half
    to_left = off > half
    keys = [np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)]
    for k, (sel, begin, reach) in enumerate(((right, anchor, width - half), (to_left, anchor - half - 1, half + 1 + gram))):
        x = np.zeros(int(sel.sum()), dtype=np.uint64)
        for j in [*range(0, reach - 8, 8), reach - 8]:
            x = _mix(x + w[begin[sel] + j])
        keys[k][sel] = x
    match = []
    for k, sel in enumerate((right, to_left)):
        got = np.zeros(n, dtype=bool)
        here = np.flatnonzero(sel)
        by_slice = np.split(here, np.flatnonzero(np.diff(origin[here])) + 1)
        for where, shared in zip(by_slice, shared_keys([keys[k][x] for x in by_slice]), strict=True):
            got[where] = shared
        match.append(got)
    lo = np.where(match[1], 0, np.maximum(0, off - half))
    hi = np.where(match[0], runs, np.minimum(runs, off - half))        # windows lo to hi - 1 can match
    some = np.flatnonzero((match[0] | match[1]) & (hi > lo))
    if len(some):
        parts = [text[a:b + width - 1] for a, b in zip((start + lo)[some].tolist(), (start + hi)[some].tolist(), strict=True)]
        small = b"".join(parts)
        length = (hi - lo)[some]
        begin = np.cumsum(length + (width - 1)) - (length + (width - 1))
        index = np.repeat(np.arange(len(some)), length)
        t = np.arange(len(index)) - np.repeat(np.cumsum(length) - length, length)
        window = np.zeros(len(small), dtype=bool)
        window[begin[index] + t] = True
        sa, _ = suffix_array(small, width)
        sa = sa[window[sa]]
        group = np.flatnonzero(common_prefixes(small, sa, width) < width)
        holder = np.zeros(len(small), dtype=np.int64)
        holder[begin[index] + t] = least[some][index]
        first = np.minimum.reduceat(holder[sa], group)
        hit = np.zeros(len(small), dtype=bool)
        hit[sa] = np.repeat(first, np.diff(np.append(group, len(sa)))) < holder[sa]
        hit = hit[begin[index] + t]
        # runs of covered windows, per segment
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1
        edge |= hit & (t == 0)
        a = np.flatnonzero(edge)
        last = hit & np.append(~hit[1:] | (t[1:] == 0), True)
        b = np.flatnonzero(last)
        seg_of, t0, t1 = some[index[a]], lo[some[index[a]]] + t[a], lo[some[index[a]]] + t[b]
        # the holders of smallest id, each at its own place
        held = np.flatnonzero(~later)
        held = held[np.argsort(seg[held], kind="stable")]
        f = np.searchsorted(seg[held], seg_of, "left")
        many = np.searchsorted(seg[held], seg_of, "right") - f
        r = np.repeat(np.arange(len(seg_of)), many)
        who = held[np.repeat(f, many) + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)]
        spans.append((rid[who], at[who] + t0[r], at[who] + t1[r] + width))
    return _union(spans)


def _union(spans):
    """The spans with touching ones of a row joined, in order."""
    rid, start, end = (np.concatenate([s[k] for s in spans]).astype(np.int64) if spans else np.zeros(0, np.int64) for k in range(3))
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    if not len(rid):
        return rid, start, end
    border = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
    most = np.maximum.reduceat(end, border)
    base = np.repeat(np.cumsum(most) - most, np.diff(np.append(border, len(rid))))     # rows laid end to end
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(rid), dtype=bool)
    new[1:] = (start + base)[1:] > reach[:-1]
    new[border] = True
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(rid)) - 1
    return rid[at], start[at], (reach - base)[last]


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
               shard_bytes: int = SHARD_BYTES, row: str = "row") -> DataFrame:
    """(rid, spans): covered byte ranges of the rows numbered in the column ``row``, as little-endian 64-bit pairs, in one or more parts a row."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_bytes))

    def cut(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, batch.column(2), shard_bytes):
                rids = part.column(0).to_numpy(zero_copy_only=False)
                ids = part.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                texts = [(x or "").encode("utf-8", "replace") for x in part.column(2).to_pylist()]
                for s, blob in slice_blobs(texts, rids, ids, shards, compress, width):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        rid, start, end = covered_spans([expand(b) for b in table.column("blob").to_pylist()], width)
        at = np.flatnonzero(np.diff(rid, prepend=-1))
        pairs = np.stack([start, end], axis=1).astype("<i8")
        parts = [p.tobytes() for p in np.split(pairs, at[1:])] if len(at) else []
        return pa.table({"rid": pa.array(rid[at], pa.int64()), "spans": pa.array(parts, pa.binary())})

    rows = docs.select(F.col(row).alias("rid"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    blobs = rows.mapInArrow(cut, "shard long, blob binary")
    return materialise(blobs.groupBy("shard").applyInArrow(merge, "rid long, spans binary"), "spans")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc, n_bytes, n_removed, n_spans, spans (array of start and end bytes) and kept, the
    remaining bytes (binary: a cut may fall inside a character).

    A null text is empty; a text shorter than ``width`` keeps all; a null id is above all others, and rows of one id
    cover nothing of each other; an empty table gives an empty result."""
    docs = numbered(docs, "_row", [id_col, text_col])
    spans = find_spans(docs, id_col, text_col, width, row="_row").groupBy("rid").agg(F.collect_list("spans").alias("parts"))
    rows = docs.select(F.col("_row").alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = rows.join(spans, F.col("row") == F.col("rid"), "left").select("doc", "parts", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.column(2)):
                out = [_cut_out(text, parts) for parts, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                made = [pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
    kind = docs.select(F.col(id_col).alias("doc")).schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")


def _cut_out(text: str | None, parts: list[bytes] | None):
    """n_bytes, n_removed, n_spans, spans and kept of one text and its spans, which may touch and overlap."""
    raw = (text or "").encode("utf-8", "replace")
    pairs = np.frombuffer(b"".join(parts or []), dtype="<i8").reshape(-1, 2)
    _, start, end = _union([(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])])
    edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
    kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return len(raw), len(raw) - len(kept), len(start), np.stack([start, end], axis=1).tolist(), kept


def op1_suffix_dedup(spark, sf_dir):
    out = dedup_substrings(documents(spark, sf_dir))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ship(__name__)

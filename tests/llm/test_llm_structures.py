"""Merkle manifest, conversation repair and embedding near-dedup against brute force on small inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanin.llm import descent as D
from fanin.llm import manifest as M
from fanin.llm import repair as R

SF = "/root/testdata/sf0.001"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest --------------------------------------------------------------------------------------------

def brute_manifest(rows, seen):
    """rows: (id, source, text), seen: the later texts; per row leaf, subroot, root, proof, folded root."""
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, s, t: sha([enc(i), enc(s), enc(t)])
    groups = {}
    for k, (i, s, t) in enumerate(rows):
        groups.setdefault(s, []).append((i is not None, i, leaf(i, s, t), k))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(at):
                run = nodes[p // 3 * 3:p // 3 * 3 + 3]
                paths[k].append((run[:p % 3], run[p % 3 + 1:]))
            nodes, at = [sha(nodes[a:a + 3]) for a in range(0, len(nodes), 3)], [p // 3 for p in at]
        return nodes[0], paths

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in order}
    root, up = climb([subs[s][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for (_, i, own, k), path in zip(sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2])), subs[s][1], strict=True):
            full, node = path + up[n], leaf(i, s, seen[k])
            for left, right in full:
                node = sha([*left, node, *right])
            out.append((i, own, subs[s][0], root, sha([d for a, b in full for d in a + b]), node, node == root))
    return out


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 3, 4], [40, 1, 9, 28], [2000, 30, 1, 1, 729, 730]])
def test_manifest_is_the_tree(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(None if rng.random() < .01 else len(sizes) * k + n, None if n == 0 else "s" * n + "é", None if rng.random() < .05 else f"text {k}\n" * rng.randint(0, 3))
            for n, size in enumerate(sizes) for k in range(size)]
    rng.shuffle(rows)
    seen = [t.replace("\n", "") if t and i is not None and i % 3 == 0 else t for i, _, t in rows]
    df = spark.createDataFrame(rows, "id long, src string, body string").repartition(5).withColumn("g", F.lit("x")).withColumn("pos", F.lit(0))
    new = F.when(F.col("id") % 3 == 0, F.replace("body", F.lit("\n"), F.lit(""))).otherwise(F.col("body"))
    out = M.merkle_manifest(df, ("id", "src", "body"), "id", "src", {"body": new}).collect()
    got = sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in out), key=repr)
    assert got == sorted(brute_manifest(rows, seen), key=repr)


def test_manifest_of_repeated_rows_and_of_none(spark):
    rows = [(1, "a", "x")] * 7 + [(None, None, None)] * 4
    df = spark.createDataFrame(rows, "id long, src string, body string")
    out = M.merkle_manifest(df, ("id", "src", "body"), "id", "src").collect()
    assert len(out) == 11 and all(r["verified"] for r in out) and len({r["root"] for r in out}) == 1
    assert sorted(r["proof_sha256"] for r in out) == sorted(x[4] for x in brute_manifest(rows, [r[2] for r in rows]))
    assert M.merkle_manifest(df.limit(0), ("id", "src", "body"), "id", "src").count() == 0


def test_a_fold_reads_no_left_sibling():
    leaves = [sha([str(k)]).encode() for k in range(100)]
    other = list(leaves)
    other[50] = b"y" * 64
    tree = M.Tree(leaves, M.levels_of(100))
    for level in tree.levels:
        level[:] = [b"x" * 64] * len(level)               # only the states know what was on the left
    assert tree.fold(50, b"y" * 64) == M.Tree(other, M.levels_of(100)).levels[-1][0]


# --- repair ----------------------------------------------------------------------------------------------

def brute_repair(rows):
    """The least (cost, audit) by trying all edits, with at most three inserts."""
    best = [None]

    def go(i, q, cost, audit, inserts):
        if best[0] is not None and cost > best[0][0]:
            return
        if i == len(rows) and q in "0a" and (best[0] is None or (cost, audit) < best[0]):
            best[0] = (cost, audit)
        due = "a" if q == "u" else "u"
        if inserts < 3:
            go(i, due, cost + 5, audit + "I", inserts + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, q, cost + 2, audit + "D", inserts)
            if fault != R.MUST_GO:
                more = 5 * (fault == R.TRUNCATED)
                if initial == due or initial == "s" and q == "0":
                    go(i + 1, initial, cost + more, audit + "K", inserts)
                go(i + 1, due, cost + more + 1, audit + "R", inserts)

    go(0, "0", 0, "", 0)
    return best[0]


def test_search_finds_the_least_audit():
    rng = random.Random(3)
    for _ in range(1500):
        rows = [(rng.choice("suauaua?"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 6))]
        cost, audit = brute_repair(rows)
        assert R.search(rows) == audit and R.apply(rows, audit)[0] == cost
        assert R.lower_bounds(rows)[0] <= cost
        for size in (1, 2, 3):
            assert not rows or R.whole(rows, size) == audit, (rows, size)


def test_long_conversations_take_a_bounded_search():
    import time
    rng = random.Random(5)
    rows = [(rng.choice("suax"), rng.choice([0, 0, 1, 2])) for _ in range(4_000)]
    began = time.time()
    audit = R.whole(rows)
    assert time.time() - began < 60
    assert R.apply(rows, audit)[0] == forward(rows)[0] and audit == forward(rows)[1]


def forward(rows):
    """The least (cost, audit) row by row; audits are kept as parent links."""
    best = {"0": (0, "")}
    for initial, fault in rows:
        now = {}
        for q, (cost, audit) in best.items():
            for puts in range(3):
                state, c, a = q, cost + 5 * puts, audit + "I" * puts
                for _ in range(puts):
                    state = "a" if state == "u" else "u"
                due, more = ("a" if state == "u" else "u"), 5 * (fault == 2)
                ways = [(state, c + 2, a + "D")]
                if fault != 1:
                    ways.append((due, c + 1 + more, a + "R"))
                    if initial == due or initial == "s" and state == "0":
                        ways.append((initial, c + more, a + "K"))
                for s, x, y in ways:
                    if s not in now or (x, y) < now[s]:
                        now[s] = (x, y)
        best = now
    ends = {"0": 0, "a": 0, "u": 1, "s": 2}
    return min((c + 5 * ends[q], a + "I" * ends[q]) for q, (c, a) in best.items())


def brute_conversation(rows):
    """rows: (turn, role, text) in order."""
    seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        name = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if name:
            counts[name] += 1
        kinds.append((role[:1] or " ", {"": 0, "truncated": 2}.get(name, 1)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
    cost, audit = forward(kinds)
    out, q, i = [], "0", 0
    for op in audit:
        due = "a" if q == "u" else "u"
        full = {"a": "assistant", "u": "user"}[due]
        if op == "I":
            out.append(f"{full}:")
            q = due
            continue
        if op in "KR":
            out.append((rows[i][1] if op == "K" else full) + ":" + rows[i][2])
            q = due if op == "R" else kinds[i][0]
        i += 1
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha(["\n".join(out)]))


@pytest.mark.parametrize("segment", [3, R.SEGMENT])
def test_repair_is_the_same_in_any_ranges(spark, segment):
    rng = random.Random(segment)
    rows, want = [], {}
    for conv in [None, *range(30)]:
        n = 400 if conv == 3 else rng.randint(1, 9)
        for turn in range(n):
            turn = None if rng.random() < .03 else turn * rng.choice([1, 1, 1, 2])
            text = rng.choice(["", " \n", "é.", "x", "Wie geht's? ", "a\nb!"]) + rng.choice(["", str(turn) + "."])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([text] * 9 + [None]), rng.choice([1] * 8 + [0, 2])))
    rows += [(99, 1, "user", "gone", 0), (98, 1 - (1 << 63), "user", "far.", 1), (98, (1 << 63) - 1, "assistant", "away.", 1)]
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, n in rows if c == conv for _ in range(n)]
        digest = lambda r: sha([f"{len(r[1])}:", r[1], r[2]])
        want[conv] = brute_conversation(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))))
    want[98] = ((1 << 63) - 1, *want[98][1:])
    df = spark.createDataFrame(rows, "c long, t long, who string, said string, times int").repartition(7).withColumn("key", F.lit("_")).withColumn("rid", F.lit(1))
    out = R.repair(df, "c", "t", "who", "said", "times", segment).collect()
    assert len(out) == len(want)
    assert {r["conv"]: tuple(r)[1:] for r in out} == want


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(df).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"Yes. No! {c}?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in R.damaged(df).collect():
        n = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        text = " " if r.conv_id is None else f"Yes. No! {r.conv_id}?"
        role = " " if r.conv_id is None else "assistant"
        assert r.copies == {0: 0, 3: 2}.get(n, 1)
        assert r.role == ("user" if n == 4 else role)
        assert r.text == ("" if n == 1 else text.replace(".", "").replace("!", "").replace("?", "") if n == 2 else text)


# --- embeddings ------------------------------------------------------------------------------------------

def brute_links(rows, cosine=D.COSINE):
    """Per row n_links, component."""
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=np.float64) / max(abs(x) for x in v)
        return v / np.sqrt(v @ v)

    u, n = [unit(v) for _, v in rows], len(rows)
    link = [[b for b in range(n) if b != a and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= cosine] for a in range(n)]
    out, done = [None] * n, [False] * n
    for a in range(n):
        if not done[a]:
            todo, comp = [a], []
            done[a] = True
            while todo:
                x = todo.pop()
                comp.append(x)
                for y in link[x]:
                    if not done[y]:
                        done[y] = True
                        todo.append(y)
            ids = [rows[x][0] for x in comp if rows[x][0] is not None]
            for x in comp:
                out[x] = (len(link[x]), min(ids) if ids else None)
    return out


def vectors(seed, dim=24):
    """Singles, pairs around the threshold, chains, a large group of near copies, exact copies, odd ones."""
    rng = np.random.default_rng(seed)
    one = lambda: (v := rng.standard_normal(dim)) / np.linalg.norm(v)
    at = lambda v, deg: np.cos(np.radians(deg)) * v + np.sin(np.radians(deg)) * (lambda w: w / np.linalg.norm(w))((w := rng.standard_normal(dim)) - (w @ v) * v)
    out = [one() for _ in range(300)]
    out += [x for _ in range(60) for v in [one()] for x in (v, at(v, rng.uniform(2, 40)))]
    for _ in range(5):
        v = one()
        for _ in range(12):
            out.append(v)
            v = at(v, 22)
    for size, deg in ((400, 3), (150, 9), (120, 17), (40, 24)):
        v = one()
        out += [at(v, deg) for _ in range(size)]
    copy = one()
    out += [copy] * 30 + [copy * 2.5] * 3 + [copy * 1e200, copy * 1e-200]
    out = [x.tolist() for x in out] + [None, [], [0.0] * dim, [float("nan")] * dim, [None] * dim, [1.0, float("inf")], [1.0], [2.0], [-1.0], [1.0, 0.0], [1.0, 0.01]]
    order = rng.permutation(len(out))
    return [(int(k), out[j]) for k, j in enumerate(order)]


def test_links_and_components_of_all_vectors(spark):
    rows = vectors(1)
    rows += [(rows[5][0], rows[5][1]), (None, rows[6][1]), (None, None)]
    df = spark.createDataFrame(rows, "v long, e array<double>").repartition(6).withColumn("ball", F.lit(1)).withColumn("unit", F.lit(2))
    log = []
    out = D.embedding_dedup(df, "v", "e", log=log).collect()
    want = sorted([(r[0], *w) for r, w in zip(rows, brute_links(rows), strict=True)], key=repr)
    got = sorted([(r["id"], r["n_links"], r["component"]) for r in out], key=repr)
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.98 * links and log[-1][2] >= D.RECALL
    assert all(r["kept"] == (r["id"] == r["component"]) for r in out)
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 0.03 * len(want)
    assert D.embedding_dedup(df.limit(0), "v", "e").count() == 0


def test_balls_hold_only_linked_vectors(spark):
    rows = [(k, v) for k, v in vectors(2) if v is not None and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)]
    x = {k: np.frombuffer(u, np.float64) for (k, _), u in zip(rows, D.units(__import__("pyarrow").array([v for _, v in rows])), strict=True)}
    df = spark.createDataFrame([(k, u.tobytes(), 1) for k, u in x.items()], "node long, unit binary, size long")
    balls, of = D.balls_of(df, float(np.arccos(D.COSINE)))
    balls, of = {b["ball"]: b for b in balls.collect()}, {r["node"]: r["ball"] for r in of.collect()}
    assert set(of) == set(x) and set(of.values()) == set(balls) and len(balls) < len(x) - 400
    members = {}
    for k, b in of.items():
        members.setdefault(b, []).append(x[k])
        assert np.arccos(np.clip(np.frombuffer(balls[b]["center"], np.float64) @ x[k], -1, 1)) <= balls[b]["r"] + 1e-7
    for b, m in members.items():
        assert (np.stack(m) @ np.stack(m).T).min() >= D.COSINE and balls[b]["size"] == len(m)


def test_full_lists_are_doubled(spark):
    found = spark.createDataFrame([(1, v, 0.1 * v) for v in range(2, 40)] + [(2, v, 1.0) for v in range(3, 20)], "u long, v long, d double")
    out = D.merged(None, found, 0.9, 4).collect()
    assert {(r.u, r.v) for r in out} == {(1, v) for v in range(2, 6)} | {(2, v) for v in range(3, 7)}
    assert {r.u: r.k for r in out} == {1: 8, 2: 4}


# --- hot groups and small samples of earlier operators ------------------------------------------------------

def test_packing_spreads_rows_of_one_id(spark):
    from fanin.llm import packing as P
    rows = spark.range(20_000, numPartitions=8).select(F.lit(None).cast("long").alias("doc"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"))
    out = P.pack(rows, 20_000, 64, 1_000).select(F.shiftright("sequence_id", 32).alias("g"), "sequence_id", "offset")
    sizes = [r["count"] for r in out.groupBy("g").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1_300 and sum(sizes) == 20_000
    assert out.select("sequence_id", "offset").distinct().count() == 20_000


def test_few_labels_mine_no_rule(spark):
    from fanin.llm import urlrules as U
    pages = [(k, f"https://{h}.org/spam/{k}") for k, h in enumerate("abc")] + [(9, "https://d.org/clean")]
    labels = [(k, 0, 0) for k in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in U.filter_urls(df, known).collect()} == {"allow"}
    baskets = spark.createDataFrame([(["x", f"y{k}"], True) for k in range(19)], "tokens array<string>, blocked boolean")
    assert U.mine_rules(baskets).count() == 0
    more = baskets.unionAll(spark.createDataFrame([(["x"], True), (["z"], False)], "tokens array<string>, blocked boolean"))
    assert [(r["items"], r["support"]) for r in U.mine_rules(more).collect()] == [(["x"], 20)]

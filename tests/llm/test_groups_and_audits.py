"""Filter audit, conversation repair and n-gram join against brute force, and on odd inputs."""

import hashlib
import heapq
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshquill.llm import conversations, filter_audit, ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- filter audit ------------------------------------------------------------------------------------
def test_audit_of_odd_rows_equals_sql(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    docs = [
        (1, "en", None), (2, "en", ""), (3, None, "word " * 300), (4, "fr", long), (5, "fr", long), (5, "fr", long), (6, "", "A B # C"), (None, "en", long), (None, None, ""),
        (7, "de", "Ärger \x0b tab\there % " * 90), (8, "de", " ".join(f"Wort{i % 150}" for i in range(260))), (9, "de", "x"),
    ]
    labels = [(1, 1, 0), (4, 1, 1), (5, 0, 1), (5, 1, None), (77, 1, 1), (None, 1, 1), (9, None, None)]
    d = pd.DataFrame(docs, columns=["doc_id", "lang", "text"]).astype({"doc_id": "Int64"})
    la = pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64")
    frame = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, lang string, text string, part string, failed int")  # columns with clashing names
    known = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, text string")
    db = duckdb.connect()
    db.register("documents", d)
    db.register("labels", la)
    want = sorted(db.sql(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({filter_audit.ORACLE_SQL})").fetchall())
    got = sorted(map(tuple, filter_audit.filter_audit(frame, known).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))
    assert got == want and len(got) == 4 * 600
    assert filter_audit.filter_audit(frame.where("false"), known).count() == 0
    assert filter_audit.filter_audit(frame, known.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_each_state_is_visited_once_and_edges_add_up(spark):
    rng = np.random.default_rng(1)
    rows = [("en" if i % 3 else "", int(rng.integers(0, 8)), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(400)]
    frame = spark.createDataFrame(rows, "part string, failed int, good int, toxic int")
    counts = filter_audit.state_counts(frame, "XYZ")
    assert counts.groupBy("part", "state").count().where("count > 1").count() == 0 and counts.select("state").distinct().count() == 8
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.interactions(frame, "XYZ").collect()}
    shapley = Counter()
    for part in ("en", ""):
        for order in permutations("XYZ"):
            alive = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                hit = [r for r in alive if r[1] >> "XYZ".index(f) & 1]
                alive = [r for r in alive if r not in hit or not r[1] >> "XYZ".index(f) & 1]
                r = got[part, "".join(order), step]
                assert (r["kept"], r["removed"], r["good_lost"], r["toxic_lost"]) == (len(alive), len(hit), sum(x[2] for x in hit), sum(x[3] for x in hit))
                shapley[part, f] += len(hit)
    assert all(r["shapley"] == shapley[part, order[step - 1]] for (part, order, step), r in got.items())


# --- conversation repair -----------------------------------------------------------------------------
def brute_repair(rows):
    """Cheapest edits by Dijkstra over (row, state), then all cheapest strings by depth-first search."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    due = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {2: "user", 3: "assistant"}

    def moves(i, q):
        yield "I", 2, i, due[q], f"{name[due[q]]}:"
        if i < len(rows):
            yield "D", 3, i + 1, q, None
            if faults[i] not in ("b", "d"):
                late = faults[i] == "t"
                if to := kept.get((q, rows[i][1][:1])):
                    yield "K", late, i + 1, to, f"{rows[i][1]}:{rows[i][2]}"
                yield "R", 2 + late, i + 1, due[q], f"{name[due[q]]}:{rows[i][2]}"

    best = (float("inf"),)
    queue = [(0, "", 0, 0, ())]
    while queue:  # states in order of cost, then of the edits so far
        cost, audit, i, q, lines = heapq.heappop(queue)
        if cost > best[0]:
            break
        if i == len(rows) and q in (0, 3):
            best = min(best, (cost, audit, lines))
            continue
        for letter, c, j, to, line in moves(i, q):
            if cost + c <= 3 * len(rows):
                heapq.heappush(queue, (cost + c, audit + letter, j, to, lines if line is None else (*lines, line)))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]  # noqa: B905
    return {
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": int(best[0]), "audit": best[1], "repaired_sha256": hashlib.sha256("\n".join(best[2]).encode()).hexdigest(),
    }


@pytest.mark.parametrize("leaf_bits", [16, 1])
def test_repair_equals_brute_force(spark, leaf_bits):
    """Also with leaves of two rows, so that conversations are cut."""
    rng = np.random.default_rng(leaf_bits)
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 7))):
            rows.append((conv, turn, str(rng.choice(["user", "assistant", "system", "tool", ""], p=[0.4, 0.3, 0.15, 0.1, 0.05])), str(rng.choice(["Yes.", "no", " ", "What?", f"t{turn}!"]))))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    summary, turns = conversations.repair(frame, leaf_bits)
    sums = {r["conv_id"]: r["repaired_sha256"] for r in conversations.digests(turns).collect()}
    for r in summary.collect():
        mine = sorted((t, role, hashlib.md5(text.encode()).hexdigest(), text) for c, t, role, text in rows if c == r["conv_id"])
        want = brute_repair([(t, role, text) for t, role, _, text in mine])
        got = {k: r[k] for k in want if k != "repaired_sha256"} | {"repaired_sha256": sums.get(r["conv_id"], hashlib.sha256().hexdigest())}
        assert got == want, mine


def test_repair_of_odd_rows_equals_sql(spark):
    rows = [
        (None, 0, "user", "Hi."), (None, None, None, None), (1, None, "user", "A."), (1, 3, "assistant", "B"), (1, 3, "assistant", "B"), (1, 9, "User", "C!"), (2, 0, "", " "),
        (3, 0, "user", "x " * 100_000 + "."), (3, 1, "assistant", "y."), (4, 0, "user", None), (5, 7, None, "late?\n\t"), *((6, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(200)),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, leaf string, id int")
    db = duckdb.connect()
    db.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({conversations.ORACLE_SQL})").fetchall(), key=str)
    for bits in (16, 2):
        assert sorted(map(tuple, conversations.audit(frame, conversations.damage(frame), bits).select(columns).collect()), key=str) == want
    empty = frame.where("false")
    assert conversations.audit(empty, conversations.damage(empty)).count() == 0


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "Done. Really!") for c in range(30) for t in range(8)]
    got = defaultdict(list)
    for r in conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"]))
    for c, t, role, text in rows:
        h = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = [] if h == 0 else [("user" if h == 4 else role, "" if h == 1 else "Done Really" if h == 2 else text)] * (1 + (h == 3))
        assert got[c, t] == want


# --- n-gram join -------------------------------------------------------------------------------------
def brute_components(rows, percent):
    sets, parent = {}, {}
    for i, text in rows:
        words = (text or "").translate(LOWER).encode().split()
        grams = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
        sets.setdefault(i, []).append(grams)
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, g) for i, every in sets.items() for g in every if g]
    for a, (i, x) in enumerate(flat):
        for j, y in flat[:a]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i in sets}


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    """Groups around the threshold, passages that many share, chains, copies; small blocks, so that n-grams meet across them."""
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 500)
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(int(rng.integers(20, 120)))]
        for _ in range(25):
            text = list(base)
            for at in rng.integers(0, len(text), int(rng.integers(0, 6))):
                text[at] = word()
            rows.append(" ".join(text))
    rows += [" ".join([*passage, *(word() for _ in range(int(rng.integers(0, 25))))]) for _ in range(60)]
    chain = [word() for _ in range(80)]
    for k in range(0, 60, 2):  # each is similar to the next, the ends are not
        chain[k] = word()
        rows.append(" ".join(chain))
    rows += [rows[0], rows[0].upper(), "a b c", "A B  c", "", " \n", "a b c d e"]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]
    for percent in (80, 60):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()}
        assert got == brute_components(docs, percent)


def test_ngram_join_of_odd_rows(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(f"word{i % 7919}x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, base), (4, base), (5, base.upper()), (None, base), (6, long), (7, long + " end"), (8, "word"), (8, "other"), (9, "other")]
    frame = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, rep string, n int, component_id double")
    got = Counter(tuple(r) for r in ngram_join.ngram_join(frame).collect())
    n = len({tuple(long.split()[k : k + 5]) for k in range(60_000 - 4)})
    assert got == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 8, 4): 2, (5, 8, 4): 1, (None, 8, None): 1, (6, n, 6): 1, (7, n + 1, 6): 1, (8, 1, 8): 2, (9, 1, 8): 1})
    assert ngram_join.ngram_join(frame.where("false")).count() == 0
    assert {tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame([(1, "")], "doc_id long, text string")).collect()} == {(1, 0, 1)}


def test_filters_never_lose_a_link():
    """Length, position and suffix filters pass all pairs that reach the similarity."""
    rng = np.random.default_rng(3)
    order = rng.permutation(4000)
    for _ in range(300):
        pool = rng.choice(4000, int(rng.integers(10, 200)), replace=False)
        x, y = (rng.choice(pool, int(len(pool) * rng.uniform(0.7, 1.0)), replace=False) for _ in range(2))
        records = []
        for s in (x, y):
            tokens = (np.sort(order[s]).astype(np.int64) << 20) & 0xFFFFFFFF  # in one order, with parts
            lead = ngram_join.prefix_length(len(s), 80)
            parts = np.bincount(ngram_join.part_of(tokens[lead:]), minlength=ngram_join.PARTS)
            records.append(np.concatenate([[len(s), 0], parts, tokens[:lead]]).astype(np.int64))
        both = len(set(x) & set(y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert ngram_join.first_shared(*records, 80) is not None

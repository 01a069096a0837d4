import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from gatelake.llm import prefix_trie
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """Turns of each conversation, as the docstring orders them."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


def grafted(convs):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[: h[c]] + x[h[c] :] for c, x in convs.items()}


def brute(convs):
    """Nodes by chained digests of their turns."""
    members, words, parents, ends = defaultdict(list), {}, {}, defaultdict(list)
    for c, turns in sorted(convs.items()):
        key = ""
        members[0, key].append(c)
        for d, turn in enumerate(turns, 1):
            up, key = key, hashlib.sha256(repr((key, turn)).encode()).hexdigest()
            members[d, key].append(c)
            words[d, key], parents[d, key] = len(re.findall(r"[^\x20\x09-\x0D]+", turn[1])), (d - 1, up)
        ends[len(turns), key].append(c)
    children = defaultdict(list)
    for k, up in parents.items():
        children[up].append(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(members, key=lambda k: -k[0]):
        saved[k] += (len(members[k]) - 1) * words.get(k, 0)
        leaves[k] += not children[k]
        if k in parents:
            saved[parents[k]] += saved[k]
            leaves[parents[k]] += leaves[k]
    return {(m[0], k[0], members[parents[k]][0] if k in parents else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items() if m}


def nodes(spark, rows, graft=True, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "'x' AS print", "2 AS part", "'y' AS block", "3 AS depth", "4 AS n_convs")
    turns = prefix_trie.numbered(df.repartition(3))
    got = prefix_trie.trie(prefix_trie.grafted(turns) if graft else turns, turns.select("conv_id").distinct(), **how)
    out = [tuple(r) for r in got.nodes.select(COLUMNS).collect()]
    assert len(out) == len(set(out))
    return set(out), got


def some(seed, n=90, texts=("a", "b b", "", "c  c\tc", None)):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-5, 200), n):
        rows += [(c, i if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)) for i in range(rng.randint(1, 7))]
    rows += [(c + 300, i, "user", "the same") for c in range(60) for i in range(5)]  # exact copies
    return rows + [(None, 0, "user", "nobody's"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = some(seed)
    convs = ordered(rows)
    assert nodes(spark, rows)[0] == brute(grafted(convs))
    got, trie = nodes(spark, rows, graft=False)
    assert got == brute(convs)
    firsts = defaultdict(list)
    for c in sorted(convs):
        for d in range(1, len(convs[c]) + 1):
            firsts[d, tuple(convs[c][:d])].append(c)
    want = {(c, d, m[0]) for (d, _), m in firsts.items() for c in m}
    assert {tuple(r) for r in trie.members.collect()} == want


@pytest.mark.parametrize("bits", [1, 3])
def test_collisions_are_split(spark, bits):
    rows = some(3, 60)
    assert nodes(spark, rows, graft=False, bits=bits)[0] == brute(ordered(rows))


def test_long_conversations(spark):
    """Over several blocks and partitions, with a common beginning, under a gap that the head leaves."""
    rows = [(c, i, "user", f"{i} said" if i < 9000 else f"{c} {i}") for c in (41, 47, 99) for i in range(9100 + c)]
    rows += [(40, 0, "system", "short head"), (80, 0, "user", "0 said")]
    convs = ordered(rows)
    got = nodes(spark, rows)[0]
    assert got == brute(grafted(convs)) and max(r[1] for r in got) > 2 * prefix_trie.BLOCK


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "only") for c in range(101, 120)]  # their head is missing: what is shorter than h is left without turns
    got = nodes(spark, rows)[0]
    assert got == brute(grafted(ordered(rows))) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)
    assert nodes(spark, [])[0] == set() and nodes(spark, [(None, 1, "a", "b")])[0] == set()
    long = [(7, 0, "user", "x" * 3_000_000), (8, 0, "user", "x" * 3_000_000 + " y")]
    assert nodes(spark, long, graft=False)[0] == brute(ordered(long))


def test_query_equals_brute_force(spark):
    from gatelake.llm import catalog

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in catalog.op11_conversation_trie(spark, sf).select(COLUMNS).collect()} == brute(grafted(ordered(rows)))

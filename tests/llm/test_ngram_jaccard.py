import random
import re

import numpy as np
import pyarrow as pa

from cropscan.llm import ngram_jaccard as nj
from cropscan.llm.components import components
from helpers import EDGES, by_id, make

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


def brute(rows):
    sets = {d: plain_set(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = f"new{rng.randint(0, 10**6)}"
    return out


def corpus(seed):
    """Chains and groups of near copies around the threshold, a passage that many share, and short texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    texts = []
    for size in (4, 9, 12, 20, 45, 120, 400, 1500):
        base = fresh(size)
        texts += [base, base, [*base, "tail"], base[1:]]
        for share in (0.005, 0.01, 0.02, 0.03, 0.04):
            texts += [edited(rng, base, share) for _ in range(3)]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, 0.015)
            texts.append(chain)
    passage = fresh(60)
    texts += [fresh(rng.randint(1, 30)) + passage + fresh(rng.randint(1, 30)) for _ in range(60)]
    texts += [fresh(rng.randint(1, 5)) for _ in range(20)]
    rng.shuffle(texts)
    return [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = corpus(1)
    found = by_id(nj.jaccard_components(make(spark, rows)), "n_shingles", "component_id")
    expected = brute(rows)
    assert found == expected
    assert len({c for _, c in expected.values()}) < len(rows) - 40


def test_every_linked_pair_shares_a_key():
    rng, rule = random.Random(2), nj.Similarity()
    for _ in range(400):
        n = rng.choice([9, 10, 11, 17, 18, 27, 40, 90, 200, 700])
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        swaps = rng.randint(0, rule.difference(n) // 2)
        b = np.unique(np.concatenate([a[swaps:], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, swaps))], np.uint64)]))
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if len(a) != len(b) or both != len(a):
            if rule.of * both >= rule.at_least * union:
                assert set(nj.block_keys(a, rule).tolist()) & set(nj.block_keys(b, rule).tolist()), (n, swaps)


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for n in (1, 5, 50, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 3:], rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)])
        distance = int(np.bitwise_count(nj.short_sketch(a).view(np.uint64) ^ nj.short_sketch(b).view(np.uint64)).sum())
        assert distance <= len(np.setxor1d(a, b))


def test_sets_are_those_of_the_contract():
    texts = ["", " \t\n", "One", "one two", "A b C d", "x\x0by\x0cz é É", "a a a a", "a\x1cb c d"]
    made = nj.shingle_sets(pa.array(texts), 3)
    assert [len(s) for s in made] == [len(plain_set(t)) for t in texts]
    same = nj.shingle_sets(pa.array(["A B", "a b", "b a", "a", "A"]), 3)
    assert same[0].tolist() == same[1].tolist() != same[2].tolist() and same[3].tolist() == same[4].tolist()


def test_edges(spark):
    found = by_id(nj.jaccard_components(make(spark, EDGES)), "n_shingles", "component_id")
    expected = brute([r for r in EDGES if r[0] is not None])
    assert found.pop(None) == (5, None)
    assert found == expected
    assert found[8][1] == 7
    assert nj.jaccard_components(make(spark, [])).collect() == []


def test_one_of_each_keeps_columns(spark):
    docs = make(spark, [(3, "a b c d"), (1, "a b c d"), (2, "x"), (None, "a b c d"), (4, None), (5, "")])
    left = nj.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 4, 5]


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 3), (3, 1), (9, 8)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, 1: 1, 2: 1, 3: 1, 8: 8, 9: 8}

import random
import re

import pytest
import xxhash

from tessera.llm import simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "Ünï ÇÖDÉ İ ſ x", "a a a a a a", "x y z\x1cw", " ".join(WORDS * 5000)])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_groups_against_all_pairs(spark):
    r = random.Random(3)
    texts = [None, "", " ", "two words", "Two WORDS"]
    for _ in range(40):
        words = r.choices(WORDS, k=r.randint(3, 300))
        texts.append(" ".join(words))
        for _ in range(r.randint(0, 3)):
            words = words[:]
            words[r.randrange(len(words))] = r.choice(WORDS)
            texts.append(" ".join(words))
    got = {x.doc_id: x for x in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    fps = [plain(x) for x in texts]
    for i, root in enumerate(groups(fps)):
        assert (got[i].fp % (1 << 64), got[i].component_id) == (fps[i], root)


def test_hot_segments_lose_no_link(spark):
    """Hundreds of fingerprints with one half in common, at all distances from each other, and others a bit away from that half."""
    r = random.Random(5)
    base, fps = r.getrandbits(64), set()
    for _ in range(120):
        x = base ^ (r.getrandbits(32) << 32)
        fps |= {x, x ^ 1 << r.randrange(64), x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), x ^ 1 << r.randrange(32) ^ 1 << r.randrange(32, 64)}
    fps = sorted(fps)
    want = groups(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {x.node % (1 << 64): x.root for x in simhash.components(simhash.near_links(df, bucket=4)).collect()}
    seen = {}
    for x, root in zip(fps, want, strict=True):
        if want.count(root) > 1:
            assert seen.setdefault(root, roots[x]) == roots[x]
        else:
            assert x not in roots
    assert len(set(seen.values())) == len(seen)


def test_edges_of_tables(spark):
    kind = "doc_id long, text string, fp string, component_id string"
    assert simhash.near_groups(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "a b c d", "x", "y"), (1, "a b c d", "x", "y"), (None, "a b c d", "x", "y"), (None, None, None, None), (7, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    assert sorted((x.doc_id or 0, x.component_id) for x in simhash.near_groups(df).collect()) == [(0, 1), (0, 7), (1, 1), (1, 1), (7, 7)]
    kept = simhash.keep_one(spark.createDataFrame([*rows, (2, "A b c d", "x", "y")], kind))
    assert kept.columns == df.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 0, 1, 1, 7]

import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from casewise.llm import simhash as S


def slow_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius=2):
    name = {i: i for i in range(len(ids))}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                name[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(ids))]


def texts(seed=5):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["Ab", "c", "dÉf", "g\u00a0h", "ij", "K"]) + str(rng.randint(0, 40)) for _ in range(n))
    out = [None, "", " \t\n", "one", "One two", "a b c", "A  b\x0bc\x0c"]
    for _ in range(40):
        base = prose(rng.choice([3, 30, 300])).split()
        out += [" ".join(base), "\n".join(base)]
        for _ in range(4):
            base[rng.randrange(len(base))] = "edit"
            out.append(" ".join(base))
    return out + [prose(40_000)]


def test_equals_brute_force(spark):
    found = texts()
    ids = [None if i % 11 == 0 else i * 3 for i in range(len(found))]
    fps = [slow_fingerprint(t) for t in found]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in zip(ids, found)], "doc_id long, text string, _fp int, component_id string")
    got = S.near_duplicates(df.repartition(5)).collect()
    want = [(d, f"{f:016x}", c) for d, f, c in zip(ids, fps, slow_components(ids, fps))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    kept = S.keep_one(df.union(df)).collect()
    assert len(kept) == len({c for c in S_classes(fps)})
    assert len({r["doc_id"] for r in kept if r["doc_id"] is not None} - set(slow_components(ids, fps))) == 0


def S_classes(fps):
    return slow_components(list(range(len(fps))), fps)


def test_tiles_find_every_link(spark):
    """Clustered fingerprints in many small tiles: the links span exactly the brute-force components."""
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = set(seeds.tolist())
    for s in seeds.tolist():
        x = s
        for _ in range(12):
            x ^= 1 << int(rng.integers(0, 64))
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "_fp long")
    for tile in (2048, 3):
        comp = {r["node"]: r["root"] for r in S.components(S.links(df, tile_rows=tile)).collect()}
        groups = defaultdict(set)
        for v in values:
            signed = int(np.uint64(v).view(np.int64))
            groups[comp.get(signed, signed)].add(v)
        want = defaultdict(set)
        for v, c in zip(values, slow_components(list(range(len(values))), values)):
            want[c].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(900, 901), (901, 900), (7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: 100 for x in range(101, 161)} | {x: 500 for x in range(501, 560)} | {901: 900}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0 and S.keep_one(df).count() == 0

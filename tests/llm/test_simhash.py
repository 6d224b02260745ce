import random
from collections import defaultdict

import xxhash
from cases import DOCUMENTS, clashing, documents, prose

from sievestone.llm import simhash as X


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints):
    """prints: list of (doc_id, fingerprint) -> smallest id reachable within two bits, by index."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(prints))]


def test_odd_rows_match_brute_force(spark):
    got = sorted(map(tuple, X.near_duplicates(clashing(documents(spark))).collect()), key=repr)
    prints = [(r[0], plain_fingerprint(r[1])) for r in DOCUMENTS]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints), strict=True)), key=repr)
    assert got == want
    assert X.near_duplicates(documents(spark, [])).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = X.covering_masks(list(range(64)))
    assert len(masks) == 7
    pairs = [1 << i | 1 << j for i in range(64) for j in range(i + 1)]
    assert all(any(not (m & (1 << 64) - 1) & d for m in masks) for d in pairs)
    for level in X.mask_tree():
        for group in level:
            free = 64 - max((m & (1 << 64) - 1).bit_count() for m in group)
    assert free <= 6


def test_dense_buckets_are_dealt_again_and_lose_no_link(spark):
    """Thousands of fingerprints around two centres: every level of masks is used."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64), rng.getrandbits(64)]
    prints = {centres[0], centres[1]}
    while len(prints) < 1500:
        f = rng.choice(centres)
        for _ in range(rng.randint(1, 6)):
            f ^= 1 << rng.randrange(40)
        prints.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(prints)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {frozenset((r.src, r.dst)) for r in X.links(df, small=16).distinct().collect()}
    mask = (1 << 64) - 1
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & mask).bit_count() <= 2}
    assert got == want
    by_id = {r.doc_id: r.component_id for r in X.with_components(df).collect()}
    plain = plain_components([(i, f & mask) for i, f in enumerate(signed)])
    assert [by_id[i] for i in range(len(signed))] == plain


def test_one_document_of_each_group_stays(spark):
    rows = [(5, prose(1), "en", "a", 1), (2, prose(1), "en", "a", 1), (2, prose(1), "en", "a", 1), (7, prose(2), "en", "a", 1), (None, prose(3), "en", "a", 1), (None, prose(4), "en", "a", 1), (9, prose(3), "en", "a", 1)]
    kept = X.drop_near_duplicates(clashing(documents(spark, rows)))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 7, 9, None]
    assert kept.columns == clashing(documents(spark, rows)).columns
    assert X.drop_near_duplicates(documents(spark, [])).count() == 0

import random
import re

import numpy as np
import xxhash
from odd_rows import ODD
from hypothesis import given, settings, strategies as st

from hubwright.llm import simhash


def plain_fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, links):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def cluster(seed, n):
    """Fingerprints of which many are near each other, with a third in one dense group."""
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    out = set()
    while len(out) < n:
        x = centre if rng.random() < 0.4 else rng.getrandbits(64)
        for _ in range(4):
            out.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    return np.sort(np.array(sorted(out), np.uint64))


def near(a):
    return [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2).tolist() if i < j]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉé \n\t\x0b\x1c\u00a0", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_walk_finds_every_pair_once():
    a = cluster(1, 900)
    for size in (simhash.WALK, 64):
        simhash.WALK, before = size, simhash.WALK
        got = [(i, j) for x, y in simhash.walk(a, a, True, 0, 0, 2) for i, j in zip(x.tolist(), y.tolist())]
        simhash.WALK = before
        assert len(got) == len(set(got)) and set(got) == set(near(a))


def test_links_across_cells(spark):
    a = cluster(2, 500)
    values = spark.createDataFrame([(int(v),) for v in a.view(np.int64)], "fingerprint long")
    cells = simhash.plan_cells(values, len(a), cell_rows=20, most_cells=1 << 11)
    assert len(cells) > 8 and len({d for d, _ in cells}) > 1
    roots = dict(simhash.components(simhash.cell_links(values, cells)).collect())
    want = plain_components(range(len(a)), near(a))
    got = [roots.get(int(v), int(v)) for v in a.view(np.int64)]
    assert len(set(zip(got, want.values()))) == len(set(got)) == len(set(want.values()))


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    rng.shuffle(links)
    got = dict(simhash.components(spark.createDataFrame(links, "src long, dst long")).collect())
    want = plain_components({v for p in links for v in p}, [p for p in links if p[0] != p[1]])
    assert got == want
    assert simhash.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_odd_texts(odd, no_docs):
    got = sorted(simhash.near_duplicates(odd).collect(), key=str)
    assert len(got) == len(ODD)
    fp = [plain_fingerprint(t or "") for _, t, *_ in ODD]
    rows = [(d, f) for (d, *_), f in zip(ODD, fp)]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    part = plain_components(range(len(fp)), links)
    least = {}
    for i, root in part.items():
        known = [d for d in (rows[i][0], least.get(root)) if d is not None]
        least[root] = min(known) if known else None
    assert got == sorted([(d, f"{f:016x}", least[part[i]]) for i, (d, f) in enumerate(rows)], key=lambda r: f"Row(doc_id={r[0]}, fingerprint='{r[1]}', component_id={r[2]})")
    assert simhash.near_duplicates(no_docs).collect() == []


def test_one_row_of_each_component_stays(spark, odd, no_docs):
    rows = simhash.one_of_each(odd)
    assert rows.columns == odd.columns and simhash.one_of_each(no_docs).collect() == []
    fp = [plain_fingerprint(t or "") for _, t, *_ in ODD]
    part = plain_components(range(len(fp)), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {}
    for i, root in part.items():
        d = ODD[i][0]
        least[root] = min(least.get(root, (True, 0)), (d is None, d or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows.collect()) == sorted(least.values())


def test_a_third_of_all_rows_are_near_copies(spark):
    """Near copies and copies of one id: of each group one row stays, ids and texts of others are left alone."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    hot = rng.choices(words, k=600)
    docs = []
    for i in range(900):
        text = list(hot) if i % 3 == 0 else rng.choices(words, k=40)
        if i % 3 == 0 and i % 2:
            text[rng.randrange(600)] = "changed"
        docs.append((i if i % 5 else 0, " ".join(text)))
    docs += [(None, docs[1][1]), (None, "no id"), (None, "no id")]
    fp = [plain_fingerprint(t) for _, t in docs]
    groups = plain_components(sorted(set(fp)), [(a, b) for a in set(fp) for b in set(fp) if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for (d, _), f in zip(docs, fp):
        least[groups[f]] = min(least.get(groups[f], (True, 0)), (d is None, d or 0))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = simhash.one_of_each(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(least.values()) and len(least) < 620

"""The registered queries themselves, on the small given tables, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from hubwright.llm import packing, quality, secret_scan, sharding, simhash
from test_rest import BASE
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_judges_every_document_alike(spark, docs):
    """The whole result again from the votes and the fitted model, text by text."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(frame, ["doc_id"])
    rows = {r.doc_id: r for r in quality.op1_quality_classifier(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for d, text in docs.items():
        votes, posterior, score, kept = model.judge(text)
        assert (rows[d].votes, rows[d].kept) == (votes, kept) and abs(rows[d].posterior - posterior) < 1e-9 and abs(rows[d].score - score) < 1e-9
    counts = Counter(quality.votes(t) for t in docs.values())
    assert model.posterior.keys() == counts.keys() and quality.fit_label_model(counts) == pytest.approx(model.posterior)


def test_op4_holds_every_id_once(spark, docs):
    rows = packing.op4_pack_best_fit(spark, SF).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == docs.keys()
    for of in pieces.values():
        at = 0
        for start, length, total in sorted(of):
            assert start == at and length > 0
            at += length
        assert at == total
    for of in windows.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at <= 2048
    # no two windows could be one, but for the last few of a group
    assert sum(sum(n for _, n in of) <= 1024 for of in windows.values()) <= 1


def test_op5_components(spark, docs):
    prints = {d: plain_fingerprint(t) for d, t in docs.items()}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = plain_components(ids, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash_components(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in ids}


def test_op9_shards(spark, docs):
    rows = sharding.op9_external_shuffle(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in docs.items()}
    shards = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and 0 <= r.shard < 40 and r.grown_shard is None
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[i]) for i in range(40)]
    assert sum(sizes) == len(docs) and max(sizes) - min(sizes) <= 1


def test_op10_spans(spark, docs):
    rows = {r.doc_id: r for r in secret_scan.op10_secret_scan(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for d, text in docs.items():
        found = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}", k) for i, (k, p, g, n) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= n)
        r = rows[d]
        kinds = Counter(k for *_, k in found)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        listed = [x for *_, x, _ in found]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random:")] == listed
        # what the method adds are runs of letters, digits and signs that overlap no base span
        for s in spans:
            kind, a, b = s.split(":")
            if kind == "random":
                assert re.fullmatch(r"[A-Za-z0-9+/_=-]+", text[int(a) : int(b)])

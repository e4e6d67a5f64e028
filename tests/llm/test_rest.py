"""Quality classifier, nearest neighbours, sharding, secret scan and the pipeline."""

import base64
import random
import re
import string
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from odd_rows import ODD

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as contract  # noqa: E402
import corpus_pipeline  # noqa: E402
from check import TABLES, rows_of  # noqa: E402
from hubwright.llm import ann, quality, registry, secret_scan, sharding, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"
fit_scorer = quality.fit_scorer


@pytest.mark.parametrize("name", sorted(registry.TWINS))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    result = con.execute(registry.TWINS[name])
    columns = [d[0] for d in result.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_all_are_registered():
    names = contract.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))


# quality


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in quality.op1_quality_classifier(spark, sf).collect()}
    seen = Counter((r.quality, kept[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect())
    assert seen[1, False] == 0 and seen[0, False] >= 0.9 * (seen[0, False] + seen[0, True])


def test_label_model_finds_overlapping_labellers():
    """Two kinds of bad documents, each seen by two of four labellers; one labeller has false alarms."""
    rng, counts, truth = random.Random(5), Counter(), defaultdict(Counter)
    for _ in range(5000):
        kind = rng.choices(["good", "x", "y"], [0.8, 0.1, 0.1])[0]
        cast = [
            "b" if (kind == k and rng.random() < 0.9) or rng.random() < (0.005 if n else 0.01) else "-" if rng.random() < 0.1 else "g"
            for n, k in enumerate("xxyy")
        ]
        pattern = "".join(cast)
        counts[pattern] += 1
        truth[pattern][kind == "good"] += 1
    posterior = quality.fit_label_model(counts)
    right = sum(truth[p][posterior[p] >= 0.5] for p in counts)
    assert right / 5000 > 0.97
    assert quality.fit_label_model({}) == {}


def test_the_sample_holds_rare_patterns_and_is_bounded(spark, monkeypatch):
    """A third of all rows are one row, and one kind of bad document in 3000: the fit reads few rows, and the rare kind goes."""
    seen = []
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, *more: seen.append(len(rows)) or fit_scorer(rows, *more))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs.union(docs.where("doc_id = 3").selectExpr("doc_id", "explode(array_repeat(text, 500))")), ["doc_id"], fit_docs=200)
    assert seen[0] <= 200 + quality.LEAST_DOCS * len(model.posterior)
    alone = quality.fit(docs, ["doc_id"], fit_docs=200)
    assert alone.posterior.keys() == model.posterior.keys()


def test_classifier_on_odd_texts(spark, odd, no_docs):
    out = quality.classify(odd, ["doc_id"]).collect()
    assert len(out) == len(ODD) and all(r.kept for r in out if r.doc_id in (4, 5, 6))
    assert quality.classify(no_docs, ["doc_id"]).collect() == []


# nearest neighbours


def plain_nearest(ids, vectors, queries, k=5):
    ok = [i for i, v in enumerate(vectors) if ids[i] is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q in queries:
        if q not in ok:
            continue
        a = np.array(vectors[q], float)
        best = {}
        for i in ok:
            if ids[i] != ids[q]:
                b = np.array(vectors[i], float)
                best[ids[i]] = max(best.get(ids[i], -2), a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))
        out[ids[q]] = sorted(((-round(s, 9), i) for i, s in best.items()))[:k]
    return out


def test_neighbours_of_hot_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    vectors[1000:2000] = vectors[0]  # a third of all rows
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [None] * 16), (3200, []), (None, [1.0] * 16), (3, rows[3][1]), (3250, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, list int").repartition(4)
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, df.where("vec_id % 50 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((-round(r.score, 9), r.vec_id))
    want = plain_nearest(list(range(3000)), vectors, range(0, 3000, 50))
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    for q in (0, 1000, 1950):  # copies first, smaller ids first
        assert [i for _, i in got[q]] == [i for _, i in want[q]]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [2.0, 0.2]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r["rank"]) for r in ann.nearest(df, df.where("vec_id = 0")).collect()]
    assert sorted(got)[2] == (3, 3) and {v for v, _ in got} == {1, 2, 3}
    assert ann.nearest(df.where("false"), df).collect() == []


# sharding


def test_shards_of_odd_texts(spark, odd, no_docs, tmp_path):
    for seed in (1, 2):
        out = sharding.external_shuffle(odd, f"file://{tmp_path}/{seed}", shards=4, seed=seed, bucket_bytes=100_000)
        again = sharding.external_shuffle(odd.repartition(5), f"file://{tmp_path}/{seed}-again", shards=4, seed=seed, bucket_bytes=100_000)
        assert out.columns[-2:] == ["_slot", "_shard"]
        rows = out.collect()
        places = lambda rows: sorted((r._shard, r._slot, r.doc_id or 0) for r in rows)
        assert places(rows) == places(again.collect())
        assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((d or 0, t or "") for d, t, *_ in ODD)
        slots = defaultdict(list)
        for r in rows:
            slots[r._shard].append(r._slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.external_shuffle(no_docs, f"file://{tmp_path}/none").collect() == []


def test_a_third_of_all_rows_in_one_place(spark, tmp_path, monkeypatch):
    """Rows of one id and size are dealt to several buckets, so no task holds them all."""
    monkeypatch.setattr(sharding, "LEAST_HOT", 10)
    docs = spark.createDataFrame([(7, "x" * 50, i) for i in range(4000)] + [(i, f"text {i}", 0) for i in range(8000)], "doc_id long, text string, other long").repartition(8)
    rows = sharding.external_shuffle(docs, f"file://{tmp_path}/hot", shards=5, bucket_bytes=40_000).collect()
    assert len(rows) == 12000 == len({(r.doc_id, r.text, r.other) for r in rows})
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    # the hot rows lie in all shards: their buckets are spread over the whole order
    assert set(Counter(r.shard for r in rows if r.doc_id == 7 and len(r.text) == 50)) == set(range(5))


# secrets

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def test_secrets_in_odd_texts(odd, no_docs):
    scanned = secret_scan.scan(odd).cache()
    rejected = secret_scan.thresholds(scanned)
    out = scanned.select("doc_id", secret_scan.listed(secret_scan.spans(scanned, rejected)).alias("spans"), secret_scan.listed(scanned["base"]).alias("base")).collect()
    assert len(out) == len(ODD)
    for d, t, *_ in ODD:
        found = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, n) in enumerate(BASE) for m in p.finditer(t or "") if len(m[g]) >= n)
        assert {r.base for r in out if r.doc_id == d} == {",".join(f for *_, f in found)}
    assert {r.spans for r in out if r.doc_id == 12} == {"random:4:24"}
    masked = {r.doc_id: r.text for r in secret_scan.redact(odd).collect()}
    assert masked[12] == "key [SECRET] done" and masked[1] == ODD[0][1] and masked[4] is None
    assert masked[11] == '[SECRET]" and [SECRET] [SECRET]"'
    assert secret_scan.scan(no_docs).collect() == [] and secret_scan.redact(no_docs).collect() == []


def test_battery_tells_random_from_made():
    rng = random.Random(7)
    drawn = [rng.randbytes(20).hex() for _ in range(200)] + [base64.b64encode(rng.randbytes(30)).decode() for _ in range(200)]
    p = [secret_scan.randomness(w, e) for w in drawn if (e := secret_scan.encoding_of(w))]
    assert len(p) > 380 and 0.01 < np.mean(np.array(p) < 0.1) < 0.2
    for made in ("abcdef0123456789" * 2, "get_user_by_id_and_name_2_Then_Return", "aaaaaaaaaaaaaaaaaaaaaaaa1B", "A1" * 16):
        e = secret_scan.encoding_of(made)
        assert e is None or secret_scan.randomness(made, e) < 1e-3
    assert secret_scan.encoding_of(string.ascii_lowercase) is None


# pipeline


def test_pipeline_stages_against_plain_ones(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = {r.doc_id: r for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.01")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        rows = docs.collect()
        if name == "quality_classifier":
            assert 0.7 * len(plain) < len(rows) < len(plain)
        if name == "exact_dedup":
            first = {}
            for d in sorted(plain):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", plain[d].text), d)
            assert {r.doc_id for r in rows} == set(first.values())
        if name == "simhash_near_dedup":
            fp = {d: simhash.fingerprint(r.text) for d, r in plain.items()}
            root = {d: d for d in fp}
            for d in fp:
                for e in fp:
                    if root[d] != root[e] and (fp[d] ^ fp[e]).bit_count() <= 2:
                        low, high = sorted((root[d], root[e]))
                        root = {k: low if v == high else v for k, v in root.items()}
            assert {r.doc_id for r in rows} == set(root.values())
        if name == "secret_scan":
            assert len(rows) == len(plain) and not any(re.search(r"AKIA[A-Z0-9]{14}", r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
            assert [r for r in rows if "[SECRET]" not in r.text] == [plain[r.doc_id] for r in rows if "[SECRET]" not in r.text]
        if name == "packing":
            assert {r.doc_id for r in rows} == set(plain) and sum(r.length for r in rows if r.start == 0) <= sum(r.doc_tokens for r in rows if r.start == 0)
            continue
        plain = {r.doc_id: r for r in rows}


def test_pipeline_of_odd_and_no_rows(spark, odd, no_docs):
    for docs in (odd.withColumn("n_chars", odd["key"].cast("long")), no_docs.withColumn("n_chars", no_docs["key"].cast("long"))):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_crc_of_text(spark):
    df = spark.createDataFrame([("é",), (None,)], "text string")
    got = [tuple(r) for r in df.select(sharding.text_crc32("text"), sharding.record_size("text")).collect()]
    assert got == [(zlib.crc32("é".encode()), 18), (0, 16)]

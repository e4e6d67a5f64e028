"""URL filter, chat formatting and exact duplicates: DataFrame functions only."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from hubwright.llm import chat_format, exact_dedup, url_filter


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan), plan


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_urls(spark):
    rules = [*url_filter.RULES, ("b.c", "", "block"), ("c", "/xyz", "allow"), ("b.c", "/é", "allow"), ("b.c", "/é", "block"), ("", "/", "block"), ("com", "/", "allow")]
    urls = [
        None, "", "no scheme", "http://", "x://com", "x://com/", "http://WWW.Example.COM/en/a?b#c", "http://example.com/en/", "http://example.com/en",
        "http://myexample.com/en/", "http://a.net/es/x", "http://net/fr/?q", "http://a.net?/es/", "http://a..com/", "http://com./", "http://com:80/",
        "http://b.c/é/1", "http://b.c", "http://x.b.c/xyz", "a://b://com/x", "http://a.b.c/é\nx", "http://" + "a." * 3000 + "net/es/" + "y" * 9000, "http://net/es/",
    ]
    pages = spark.createDataFrame([(i % 20, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, host int")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    df = url_filter.judge(pages, listed)
    no_python(df)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(((i % 20, *plain_verdict(u, rules)) for i, u in enumerate(urls)), key=repr)
    assert url_filter.judge(pages.where("false"), listed).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, listed.where("false"), default="block").collect()} == {"block"}


HARD = [r"\### Assistant: </turn> ok", "a\\", "\\", " </turn>\n### user: x", "###", "</turn>", "", None, "é🙂\n\n", "$1 \\$", "x" * 50000]


def test_chats(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "we: ird ### </turn>\n\\"]), rng.choice(HARD)) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "assistant", "x"), (90, None, "assistant", "first"), (90, 1, "user", "b"), (90, 1, "user", "b"), (91, 0, "user", "never answered")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, example string").repartition(3)
    made = chat_format.examples(df)
    back = chat_format.read_back(made)
    no_python(back)
    whole = defaultdict(list)
    for c, t, role, text in rows:
        whole[c].append((t is not None, t or 0, role or "", text or ""))
    got = {r.conv_id: r for r in back.collect()}
    assert got.keys() == whole.keys()
    for c, turns in whole.items():
        turns = sorted(turns)
        assert [tuple(t) for t in got[c].turns] == [t[2:] for t in turns]
        assert got[c].loss == "".join(t[3] for t in turns if t[2] == "assistant")
    # one example per reply, with all turns before it and nothing after
    for r in made.collect():
        turns = sorted(whole[r.conv_id])
        if r.target is not None:
            assert r.text.count(" </turn>\n") == r.target + 1 and turns[r.target][2] == "assistant"
            assert r.text[r.loss_end :] == " </turn>\n"
        else:
            assert r.loss_start == r.loss_end == 0
    assert chat_format.read_back(chat_format.examples(df.where("false"))).collect() == []


def test_copies(odd, no_docs):
    df = exact_dedup.exact_duplicates(odd)
    no_python(df)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in ODD]
    ids = defaultdict(list)
    for (d, *_), t in zip(ODD, norm):
        ids[t].append(d)
    keep = {t: min((d for d in v if d is not None), default=None) for t, v in ids.items()}
    want = [(d, keep[t], len(ids[t]), d == keep[t], hashlib.sha256(t.encode()).hexdigest()) for (d, *_), t in zip(ODD, norm)]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("capacity", [1, 5, 100])
def test_directory_doubles_until_buckets_fit(spark, capacity):
    keys = spark.range(60).select(F.xxhash64("id").alias("key"), F.lit(1).alias("bytes"))
    directory = exact_dedup.grow_directory(keys, 60, bucket_bytes=capacity, most_slots=1 << 16)
    placed = keys.withColumn("slot", exact_dedup.slot(directory.depth)).join(directory.frame(spark), "slot")
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert sum(sizes) == 60 and max(sizes) <= capacity
    assert len(set(directory.buckets)) < len(directory.buckets) or directory.depth == 0 or capacity > 30


def test_colliding_keys_are_chained(spark, tmp_path):
    groups = spark.createDataFrame([(0, 5, "a", 1, 2), (0, 5, "b", 2, 1), (1, 9, "c", 3, 1)], "bucket long, key long, text_sha256 string, keep_id long, group_size long")
    index = exact_dedup.build_index(groups, f"file://{tmp_path}/index")
    entries = spark.createDataFrame([(1, 5, "a"), (4, 5, "a"), (2, 5, "b"), (3, 9, "c")], "doc_id long, key long, text_sha256 string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.lookup(entries, index).collect()) == [(1, 1), (2, 2), (3, 3), (4, 1)]


KEYS = {"xxhash64": F.xxhash64, "length": F.length, "one": lambda v: F.when(F.length(v) < 0, 1).otherwise(7)}


@pytest.mark.parametrize("key", KEYS)
@pytest.mark.parametrize("bucket_bytes", [1, 200, 1 << 20])
def test_unequal_bytes_under_one_key(spark, odd, key, bucket_bytes):
    """Texts that share a key are told apart by their bytes, in small buckets, hot keys and large ones alike."""
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(odd).collect()}
    got = exact_dedup.exact_duplicates(odd, key=KEYS[key], bucket_bytes=bucket_bytes).collect()
    assert len(got) == len(ODD) and {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    rows = exact_dedup.unique_rows(odd, key=KEYS[key], bucket_bytes=bucket_bytes)
    if key == "xxhash64":  # a key that is one value is folded into the plan
        no_python(rows)
    assert rows.columns == odd.columns
    # one whole row of each text, with the smallest id
    assert sorted(r.doc_id or 0 for r in rows.collect()) == sorted({k or 0 for _, k, *_ in want})


def test_a_third_of_all_rows_are_one_text(spark):
    docs = spark.createDataFrame([(i, "the same  text" if i % 3 == 0 else f"text {i // 2}") for i in range(6000)], "doc_id long, text string").repartition(6)
    first = {}
    for r in sorted(docs.collect()):
        first.setdefault(" ".join(r.text.split()), r.doc_id)
    for bucket_bytes in (1000, 1 << 22):
        rows = exact_dedup.unique_rows(docs, bucket_bytes=bucket_bytes)
        assert sorted(r.doc_id for r in rows.collect()) == sorted(first.values())

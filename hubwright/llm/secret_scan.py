"""Secrets in texts: patterns, and a battery of randomness tests under false-discovery control.

Patterns find assigned passwords and tokens, access keys and long hex strings. Other
runs of key-like characters are candidates, whole, in the parts between their separators / + - _
and in what base spans leave of them: their encoding is inferred from the characters
they use, and three tests ask whether they look like uniform draws from that alphabet:
chi-squared for the letters' frequencies, runs above and below the middle, and serial correlation;
for letters alone also the balance of cases. Fisher's method makes one p-value of them.

A small p-value speaks against randomness. Which are small enough is decided over all
texts at once, by Benjamini-Hochberg within each encoding and length band. The level falls
with length: short strings give the tests little power, so they have to look more random to stay.
Candidates that are not rejected are reported with kind ``random``.

P-values reach the driver as counts per band and bin, a fixed number. Texts are never
shuffled: ``redact`` scans anew with the thresholds.

Defined results: a null text counts as empty and stays null when redacted; rows that repeat
are candidates of their own; an empty table gives an empty result; positions are code points.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hubwright.llm.common import hex_digest, or_empty, table, values
from hubwright.session import stage_table

# The patterns of the base kinds, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: Each match of ASSIGN holds one of these, lower-cased.
KEYWORDS = (b"passw", b"secret", b"token", b"api")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings, narrow ones first, with the alphabet in the order of its values.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base52": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ENCODINGS.items()}

#: Parts of a run: without any separator, and without those of one of the two alphabets that have some.
SPLITTERS = (re.compile(r"[^/+]+"), re.compile(r"[^_-]+"))

LEAST_CHARS = 20
#: Level for strings of LEAST_CHARS; it falls in proportion to the length.
LEVEL = 0.1
BANDS = 8
#: Bins per factor of ten of p-values, and their number.
BINS_PER_TEN, BINS = 20, 400

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in _DIGITS + _LOWER + _UPPER + "+/-_"]] = True


def base_spans(text: str, lowered: bytes, long_run: bool) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds. ``long_run``: the text has a run that could be an access key or hex."""
    found = []
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if long_run:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
    return sorted(found)


def long_runs(data: bytes, least: int) -> list[tuple[int, int]]:
    """Byte ranges of runs of key-like characters."""
    if len(data) < least:
        return []
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _RUN[np.frombuffer(data, np.uint8)]
    bounds = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    return [tuple(b) for b in bounds[bounds[:, 1] - bounds[:, 0] >= least].tolist()]


def encoding_of(word: str) -> str | None:
    """The narrowest encoding that has all characters; None for words of digits or letters of one case alone, and for those without an encoding."""
    letters = set(word)
    lower, upper, digits = letters & set(_LOWER), letters & set(_UPPER), letters & set(_DIGITS)
    if bool(digits) + bool(lower) + bool(upper) < 2:
        return None
    fits = [name for name, places in _PLACES.items() if letters <= places.keys()]
    if not fits or fits[0] in ("base64", "base64url") and not (lower and upper):
        return None
    return fits[0]


def _upper_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def randomness(word: str, encoding: str) -> float:
    """p-value of the battery: small if the word does not look like uniform draws from the encoding's alphabet."""
    x = np.fromiter(map(_PLACES[encoding].__getitem__, word), np.float64, len(word))
    n, k = len(x), len(ENCODINGS[encoding])
    # as many cells as leave five draws to each
    cells = max(2, min(k, n // 5))
    share = np.bincount(np.arange(k) * cells // k, minlength=cells) / k
    seen = np.bincount((x * cells // k).astype(int), minlength=cells)
    chi, df = float(((seen - n * share) ** 2 / (n * share)).sum()), cells - 1
    p_cells = _upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))

    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        p_runs = 2 * _upper_tail(abs(runs - mean) / math.sqrt(max(variance, 1e-9)))
    else:
        p_runs = 2.0 ** (1 - n)

    centred = x - (k - 1) / 2
    spread = float((centred**2).sum())
    correlation = float((centred[1:] * centred[:-1]).sum()) / spread if spread else 1.0
    p_serial = 2 * _upper_tail(abs(correlation) * math.sqrt(n))

    tests = [p_cells, min(1.0, p_runs), min(1.0, p_serial)]
    if encoding == "base52":  # letters alone: names in camel case have far more small letters than drawn ones
        tests.append(2 * _upper_tail(abs(a - b) / math.sqrt(n)))
    half = -sum(math.log(max(p, 1e-300)) for p in tests)
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(tests)))


def band_of(chars: int) -> int:
    return min(BANDS - 1, int(2 * math.log2(chars / LEAST_CHARS)))


def bin_of(p: float) -> int:
    return min(BINS - 1, int(-math.log10(max(p, 1e-300)) * BINS_PER_TEN))


def parts(word: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of a run to test: whole, between separators, and the rest beside the base spans ``covered``; none lies within one of those."""
    rests, at = [], 0
    for s, e in sorted(covered):
        rests.append((at, s))
        at = max(at, e)
    pieces = {(0, len(word)), *rests, (at, len(word))}
    for splitter in SPLITTERS:
        pieces |= {(a + m.start(), a + m.end()) for a, b in list(pieces) for m in splitter.finditer(word[a:b])}
    return sorted((a, b) for a, b in pieces if b - a >= LEAST_CHARS and not any(s <= a and b <= e for s, e in covered))


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, int]]]:
    """Base spans, and candidates (start, end, stratum, bin of p) that lie within none of them."""
    data = text.encode()
    runs = long_runs(data, min(HEX_CHARS, ACCESS_CHARS, LEAST_CHARS))
    base = base_spans(text, data.lower(), bool(runs))
    candidates = []
    for a, b in runs:
        if b - a < LEAST_CHARS:
            continue
        run = data[a:b].decode("ascii")
        first = len(data[:a].decode())
        touching = [(max(s - first, 0), min(e - first, len(run))) for s, _, e in base if s < first + len(run) and first < e]
        for start, end in parts(run, touching):
            word = run[start:end]
            encoding = encoding_of(word)
            if encoding is not None:
                candidates.append((first + start, first + end, f"{encoding}/{band_of(len(word))}", bin_of(randomness(word, encoding))))
    return base, candidates


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and candidates, one narrow row per row of ``docs``."""
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("bin", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [scan_text(t) for t in values(batch.column(1))]
            base = [[dict(zip(("start", "kind", "end"), s)) for s in b] for b, _ in both]
            found = [[dict(zip(("start", "end", "stratum", "bin"), c)) for c in f] for _, f in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(found, found_type)], [doc_id, "base", "candidates"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, base array<struct<start: long, kind: int, end: long>>, candidates array<struct<start: long, end: long, stratum: string, bin: int>>"
    return docs.select(doc_id, or_empty(text).alias("text")).mapInArrow(run, schema)


def thresholds(scanned: DataFrame, level: float = LEVEL) -> dict[str, int]:
    """Per stratum the lowest rejected bin of p-values: Benjamini-Hochberg over all candidates of the corpus."""
    each = scanned.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").count().collect()
    strata: dict[str, np.ndarray] = {}
    for stratum, number, n in each:
        strata.setdefault(stratum, np.zeros(BINS, np.int64))[number] = n
    edges = 10.0 ** (-np.arange(BINS) / BINS_PER_TEN)  # the largest p-value of each bin
    rejected = {}
    for stratum, counts in strata.items():
        at_most = np.cumsum(counts[::-1])[::-1]  # candidates with a p-value no larger than the bin's edge
        q = level / 2 ** (int(stratum.rpartition("/")[2]) / 2)
        passing = np.flatnonzero(edges * counts.sum() <= q * at_most)
        rejected[stratum] = int(passing[0]) if len(passing) else BINS
    return rejected


def spans(scanned: DataFrame, rejected: dict[str, int]) -> Column:
    """array of (start, kind, end), sorted: the base spans and the candidates that look random."""
    limit = F.create_map(*[F.lit(x) for pair in sorted(rejected.items()) for x in pair]) if rejected else None
    random = F.filter("candidates", lambda c: c["bin"] < limit[c["stratum"]] if limit is not None else F.lit(False))
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return F.sort_array(F.concat("base", added))


def listed(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans become one."""
    rejected = thresholds(stage_table(scan(docs, doc_id, text).select("candidates")))

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redact_text(t, rejected, mark) for t in values(texts)], pa.string())

    return docs.withColumn(text, run(text))


def redact_text(text: str, rejected: dict[str, int], mark: str) -> str:
    base, candidates = scan_text(text)
    found = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, stratum, number in candidates if number < rejected.get(stratum, BINS)])
    if not found:
        return text
    out, at = [], 0
    for start, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    scanned = stage_table(scan(table(spark, sf_dir, "documents")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        hex_digest(listed(F.col("base"))).alias("base_sha256"),
        listed(spans(scanned, thresholds(scanned))).alias("spans"),
    )

import random
import string

from hubwright.llm import secret_scan

LETTERS = string.ascii_letters + string.digits


def spans(text):
    """Candidates that no level could reject."""
    return {(a, b) for a, b, _, number in secret_scan.scan_text(text)[1] if number < secret_scan.BINS_PER_TEN}


def test_tokens_inside_urls_and_paths():
    rng = random.Random(4)
    found = mixed = 0
    for _ in range(100):
        token = "".join(rng.choices(LETTERS, k=32))
        for head, tail in (("com/my-app/", ""), ("my_app/a-b/", "/c-d"), ("a/b+", "-tail")):
            text = f"see {head}{token}{tail} end"
            start = 4 + len(head)
            found += (start, start + 32) in spans(text)
            mixed += 1
        url = "".join(rng.choices(LETTERS, k=15)) + "-" + "".join(rng.choices(LETTERS, k=15)) + "_"
        assert (6, 38) in {(a, b) for a, b, *_ in secret_scan.scan_text("a b-c/" + url)[1]}
    assert found > 0.8 * mixed


def test_mixed_case_without_digits():
    rng = random.Random(5)
    words = ["".join(rng.choices(string.ascii_letters, k=24)) for _ in range(200)]
    assert all(secret_scan.encoding_of(w) == "base52" for w in words)
    assert sum((0, 24) in spans(w) for w in words) > 100
    for made in ("getUserByIdAndNameThenReturnAll", "InternationalizationOfStrings", "ThisIsAVeryLongIdentifierName"):
        assert (0, len(made)) not in spans(made)


def test_rest_of_a_run_beside_a_base_span():
    rng = random.Random(6)
    hit = 0
    for _ in range(100):
        left, right = ("".join(rng.choices(LETTERS, k=30)) + "Z" for _ in range(2))
        text = f"Z{left}{'0123456789abcdef'}{right}"
        base, candidates = secret_scan.scan_text(text)
        assert [(k, e - s >= 16) for s, k, e in base] == [(2, True)]
        (s, _, e), ranges = base[0], {c[:2] for c in candidates}
        assert {(0, s), (e, len(text)), (0, len(text))} <= ranges
        hit += bool(spans(text) & {(0, s), (e, len(text))})
    assert hit > 80

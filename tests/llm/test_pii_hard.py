"""Personal data in hard surroundings: words after identifiers, long runs, and base spans against the fixed forms."""

from __future__ import annotations

import random
import re
import time

import pytest

from plumbline.llm import pii

FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    valid = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in form.finditer(text) if valid[k](m[0])] for k, form in FORMS.items()}


def found(text, kind):
    return [text[a:b] for a, b in pii.find_spans(text)[kind]]


def test_base_spans_equal_the_fixed_forms():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("11250.. @+-(a_") for _ in range(rng.randint(0, 40)))
        got = pii.find_spans(text)
        assert {k: got[k] for k in FORMS} == base(text), text
    for text in ("4111111111111111", "4111 1111 1111 1111 1", "1.2.3.4.5.6.7.8.9", "1.2.3.999.1.2.3.4", "a@b@c.d"):
        assert {k: pii.find_spans(text)[k] for k in FORMS} == base(text)


def test_account_numbers_end_where_their_country_says():
    plain, spaced, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    for own in (plain, spaced, other, plain.lower()):
        for after in ("", " is mine", ".", ", thanks", " 12 more words"):
            assert found(f"my IBAN: {own}{after}", "account") == [own]
    assert found(f"IBAN {plain} {other}", "account") == [plain, other]
    assert found(f"IBAN {plain} IBAN {other} x", "account") == [plain, other]
    assert found(f"IBAN {plain}7", "account") == found("IBAN DE89370400440532013001", "account") == []
    assert found("account number 12345678 of mine", "account") == ["12345678"]


def test_addresses_with_long_words():
    street = "12 " + "A" + "b" * 300 + " Main Street, New York, NY 10001"
    assert found(f"at {street}.", "address") == [street]
    assert found("No Street, 7 street, x12 Main Street", "address") == []
    assert found("#12 Main St. now", "address") == ["12 Main St."]


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 400_000, "account" + " " * 1_000_000, "12 Main Street, A" + " " * 400_000 + "B", "+1" + "(" * 1_000_000, "a@" * 400_000, "token = \"" + "a" * 1_000_000, "a" * 1_000_000 + "@b.co"])
def test_long_runs_cost_their_length_only(text):
    start = time.time()
    pii.find_spans(text)
    assert time.time() - start < 4


@pytest.mark.parametrize("text", ["-Road" * 200_000, "token=" * 170_000, "Road " * 200_000, "Main-Road " * 100_000, "x token=-" * 120_000, "token=\"" * 140_000, "bearer: " * 120_000, "iban " * 200_000])
def test_cues_without_end_cost_their_length_only(text):
    start = time.time()
    pii.find_spans(text)
    assert time.time() - start < 2


def test_secrets_after_values_without_digits():
    assert found("token=long-long-token: \"abcdefgh\"", "secret") == ["abcdefgh"]
    assert found("token=xxxxxxxx-token=>abc12345", "secret") == ["abc12345"]
    assert found("token=xxxxxxxx-token= abc12345", "secret") == ["abc12345"]
    assert found("token=xxxxxxxx-token=abcdefgh token=abc12345", "secret") == ["abc12345"]


def test_time_follows_length_on_random_mixtures():
    cues = [*pii.ACCOUNT_CUES, *pii.SECRET_CUES, *pii.STREETS, "@", "://", "+", "+1", "12", "DE89", "A", "b.co", "(", "Main", "4111"]
    between = ["", " ", "-", "=", ":", ".", "\"", "\n", "  ", "_", ", ", "/"]
    for seed in range(120):
        rng = random.Random(seed)
        few, gaps = rng.sample(cues, rng.randrange(1, 4)), rng.sample(between, rng.randrange(1, 3))
        unit = "".join(rng.choice([c, c.title(), c.upper()]) + rng.choice(gaps) for c in few * 3)
        text = unit * (150_000 // len(unit))
        start = time.process_time()
        pii.find_spans(text)
        assert time.process_time() - start < 1.5, unit

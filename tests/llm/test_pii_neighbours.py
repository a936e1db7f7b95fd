"""Personal data beside other numbers and words."""

import re

import pytest

from tallyloom.llm import pii


def rewrite(text):
    out, counts = pii.Pseudonyms(pii.EXAMPLE_KEY).rewrite(text)
    return out, {k: n for k, n in counts.items() if n}


def alone(value):
    return rewrite(value)[0]


CARD, SPACED, ACCOUNT = "4111111111111111", "4111 1111 1111 1111", "DE89370400440532013000"


@pytest.mark.parametrize("before,value,after,kind", [
    ("", CARD, " 123", "card"), ("", SPACED, " 123", "card"), ("", SPACED, " 12/27", "card"), ("7 ", CARD, "", "card"), ("7 ", SPACED, " 7 8", "card"), ("1234 ", SPACED, "", "card"),
    ("", "4111-1111-1111-1111", "-12", "card"), ("", "3782 822463 10005", " 1234", "card"), ("2024-01 ", CARD, " 99abc", "card"),
    ("", ACCOUNT, " EUR 500", "account"), ("", "DE89 3704 0044 0532 0130 00", " EUR 500", "account"), ("AB12 ", ACCOUNT, " BIC", "account"), ("", "GB82WEST12345698765432", " GBP", "account"),
    ("", "2024-01-05", "T10:00", "date"), ("at ", "2024-01-05", "T10:00:00Z", "date"),
    ("", "+1 415 555 2671", " 12", "phone"), ("7 ", "(415) 555-2671", " 12", "phone"), ("", "415-555-2671", " 12", "phone"), ("", "+33 1 23 45 67 89", " 10", "phone"), ("", "01 23 45 67 89", " 10", "phone"),
    ("", "+44 20 7946 0958", " 123", "phone"), ("123456789 ", "415-555-2671", "", "phone"), ("", "030-1234-5678", " 44", "phone"),
])
def test_values_beside_others(before, value, after, kind):
    new = alone(value)
    assert new != value
    assert rewrite(before + value + after) == (before + new + after, {kind: 1})


def test_neighbours_are_both_found():
    other = "5500 0000 0000 0004"
    assert rewrite(f"{SPACED} {other}") == (f"{alone(SPACED)} {alone(other)}", {"card": 2})
    assert rewrite(f"{ACCOUNT} {ACCOUNT}") == (f"{alone(ACCOUNT)} {alone(ACCOUNT)}", {"account": 2})
    assert rewrite(f"2024-01-05 {SPACED} 415-555-2671")[1] == {"date": 1, "card": 1, "phone": 1}


@pytest.mark.parametrize("text", ["2024-02-30T10:00", "2024-01-05Tuesday", "DE00370400440532013000 EUR 500", "4111111111111112 123", "x4111111111111111", "4111111111111111x", "1 2 3", "123456789"])
def test_what_is_no_value_stays(text):
    assert rewrite(text) == (text, {})


def test_long_runs_take_linear_time():
    import time

    def took(n):
        t = time.perf_counter()
        for text in ("1 " * n, "12" * n, "AB12 " * n, "4111 " * n, "123456789 " * n):
            pii.Pseudonyms(pii.EXAMPLE_KEY).rewrite(text)
        return time.perf_counter() - t

    took(100)
    assert took(8_000) < 25 * max(took(800), 0.02)


def test_odd_groups_are_still_cards():
    out, counts = rewrite("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1")
    assert counts == {"card": 1} and pii.luhn_sum(re.sub(r"\D", "", out)) % 10 == 0

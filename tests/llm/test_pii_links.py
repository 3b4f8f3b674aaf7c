"""Equal values get equal pseudonyms however they are written; a finder by hand on a labelled text."""

import datetime
import ipaddress
import re

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from tessella.llm import pii

KEY = b"key"


def changed(text):
    new, spans = pii.pseudonymize(f"x {text} y", KEY)
    return new[2:-2], [k for k, _, _ in spans]


def digits(text):
    return "".join(c for c in text if c.isdigit())


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["1", "7", "44", "49", "33", "34", "351", "353", "971"]), st.integers(10**8, 10**9 - 1), st.lists(st.sampled_from(["", " ", "-", "."]), min_size=4, max_size=4))
def test_a_number_is_linked_however_it_is_punctuated(code, national, seps):
    n = str(national) + ("0" if code == "1" else "")
    plain, kinds = changed(f"+{code}{n}")
    assert kinds == ["phone"] and digits(plain).startswith(code) and len(digits(plain)) == len(code + n)
    cut = [n[:3], n[3:6], n[6:]]
    other, kinds = changed(f"+{code}{seps[0] or ' '}{cut[0]}{seps[1]}{cut[1]}{seps[2]}{cut[2]}")
    assert kinds == ["phone"] and digits(other) == digits(plain)
    assert [c for c in other if not c.isdigit()] == [c for c in f"+{seps[0] or ' '}{seps[1]}{seps[2]}"]


def test_forms_of_one_number():
    forms = ["+1 704 555 7114", "+17045557114", "+1 (704) 555-7114", "(704) 555-7114", "704-555-7114"]
    assert len({digits(changed(f)[0])[-10:] for f in forms}) == 1
    assert digits(changed("+49 (0)30 1234567")[0]).replace("0", "", 1)[:2] == "49"
    a, b = changed("+49 (0)30 1234567")[0], changed("+49301234567")[0]
    assert digits(a.replace("(0)", "")) == digits(b) and "(0)" in a


@settings(max_examples=200, deadline=None)
@given(st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)))
def test_a_date_is_linked_however_it_is_written(d):
    month = pii._MONTHS[0][d.month - 1].capitalize()
    iso, kinds = changed(d.isoformat())
    assert kinds == ["date"]
    want = datetime.date.fromisoformat(iso)
    assert changed(f"{d:%d.%m.%Y}") == (f"{want:%d.%m.%Y}", ["date"])
    name = pii._MONTHS[0][want.month - 1].capitalize()
    assert changed(f"{d.day} {month} {d.year}") == (f"{want.day} {name} {want.year}", ["date"])
    assert changed(f"{month} {d.day}, {d.year}") == (f"{name} {want.day}, {want.year}", ["date"])
    german = pii._MONTHS[2]
    assert changed(f"{d.day}. {german[d.month - 1].capitalize()} {d.year}") == (f"{want.day}. {german[want.month - 1].capitalize()} {want.year}", ["date"])
    assume(d.day > 12)
    assert changed(f"{d:%m/%d/%Y}") == (f"{want:%m/%d/%Y}", ["date"])


@settings(max_examples=200, deadline=None)
@given(st.integers(1 << 112, (1 << 128) - 1))
def test_an_ipv6_address_is_linked_in_both_forms(value):
    at = ipaddress.IPv6Address(value)
    assume(any(c.isdigit() for c in str(at)) and not re.fullmatch(r"[^:]+::", str(at)))
    short, kinds = changed(str(at))
    assert kinds == ["ip"] and str(ipaddress.IPv6Address(short)) == short
    assert changed(at.exploded) == (short, ["ip"])


@pytest.mark.parametrize("text", ["12:30:45", "std::vector", "dead::beef", "31/02/1999", "13/13/2001", "31 February 1999", "May I 2020", "1:2", "::1", "aa:bb:cc:dd:ee:ff", "version 1.2.3.4.5", "+12", "40 March 1999"])
def test_what_is_no_value_stays(text):
    assert changed(text) == (text, [])


def test_a_labelled_text():
    values = {"email": "ann@example.org", "date": "05/31/1999", "ip": "2001:db8::8a2e:370:7334", "phone": "+44 20 7946 0958", "ssn": "123-45-6789", "card": "4111 1111 1111 1111", "iban": "DE89 3704 0044 0532 0130 00"}
    text = ". ".join(f"Here is {v}, told on 12 March 1980" for v in values.values())
    new, spans = pii.pseudonymize(text, KEY)
    want = sorted([(k, text.index(v), text.index(v) + len(v)) for k, v in values.items()] + [("date", m.start(), m.end()) for m in re.finditer("12 March 1980", text)], key=lambda x: x[1])
    assert spans == want and not any(v in new for v in values.values()) and len(set(re.findall(r"told on (\d+ \w+ \d{4})", new))) == 1

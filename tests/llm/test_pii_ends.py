"""Numbers with more digits or capitals behind them: every end that a pattern allows, against plain programs."""

import random

import regex

from tessera.llm import pii

CARD, IBAN = "4539 5787 6362 1486", "DE89 3704 0044 0532 0130 00"
BODIES = {
    "card": (r"[0-9](?:[ -]?[0-9]){12,18}", lambda before: regex.match(r"[\w.-]", before), r"[\w-]|\.[0-9]", pii.card),
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", lambda before: regex.match("[A-Za-z0-9]", before), "[A-Za-z0-9]", pii.iban),
}


def found(text, kind=None):
    return {(k, text[a:b]) for a, b, k, _ in pii.Finder()(text) if kind in (None, k)}


def every_end(kind, text):
    """From left to right, at each start the longest valid one of all ends."""
    body, no_start, no_end, valid = BODIES[kind]
    out, a = [], 0
    while a < len(text):
        if not (a and no_start(text[a - 1])):
            ends = [e for e in range(a + 1, min(len(text), a + 80) + 1) if regex.fullmatch(body, text[a:e]) and not regex.match(no_end, text[e:]) and valid(text[a:e])]
            if ends:
                out.append((a, max(ends)))
                a = max(ends)
                continue
        a += 1
    return out


def test_the_next_number_is_not_swallowed():
    for ip in ("190.137.223.204", "170.106.47.218"):
        for word in ("", "phone "):
            assert found(f"un. {word}+1 (843) 555-7672 {ip} Et") == {("phone", "+1 (843) 555-7672"), ("ipv4", ip)}
    assert found("+49 30 5550 1234 190.137.223.204 x") == {("phone", "+49 30 5550 1234"), ("ipv4", "190.137.223.204")}
    assert found("+1 (826) 555-4081 555 1234 99 x") == {("phone", "+1 (826) 555-4081")}


def test_cards_and_ibans_before_other_words():
    assert found(f"card {CARD} 12/27") == {("card", CARD)}
    assert found(f"{CARD} 124 and more") == {("card", CARD)}
    assert found(f"{IBAN} EUR 100") == found(f"{IBAN} BIC") == {("iban", IBAN)}
    assert found(f"XX12 {IBAN} X") == {("iban", IBAN)}
    assert found(f"77 {CARD} x") == {("card", CARD)}


def test_all_ends_against_brute_force():
    rng = random.Random(5)
    parts = [CARD, IBAN, CARD.replace(" ", ""), IBAN.replace(" ", ""), "GB82 WEST 1234 5698 7654 32", "4111-1111-1111-1111", "378282246310005", "12", "7", "EUR", "X", "AB12", "a", ".", "-", "5", "2027"]
    shortened = 0
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", " ", "", "-", ", "]) for _ in range(rng.randrange(1, 7)))
        find = pii.Finder()
        for rank, (kind, *_) in enumerate(find.kinds):
            if kind.name in BODIES:
                want = every_end(kind.name, text)
                assert list(find.spans(rank, text, [])) == want, text
                longest = {m.span() for m in regex.finditer(kind.pattern, text) if kind.valid(m[0])}
                shortened += len(set(want) - longest)
    assert shortened > 300


def test_secrets_behind_refused_ones():
    assert ("secret", "token=Zx81kq0PmVt3LsW9eRb7") in found("secret=aaaaaaaaaaaaaaaaaaaaaaaa-token=Zx81kq0PmVt3LsW9eRb7")


def test_tables_of_numbers_take_no_time():
    import time

    began = time.time()
    for s in ("1 ", "12 ", "A1 ", "AB12 ", "+1 22 ", "1234 ", "secret=aaaaaaaaaaaaaaaaaaaaaaaaa "):
        pii.Finder()(s * 20_000)
    assert time.time() - began < 60

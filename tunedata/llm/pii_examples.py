"""A small labelled table for the personal-data field: sentences with marked spans.

Patterns below are the labelled part: ``{kind:form}`` is a span of that kind, ``{form}`` the same or a similar
form where it is none. Digits and names are filled in by a fixed rule, so the table is always the same."""

from __future__ import annotations

import random
import re

#: Forms of the four kinds; 9 stands for a digit, a for a letter, L for a number with a right check digit,
#: O for a number up to 255.
FORMS = {
    "plain": "a.99@a9.a.com", "short": "a@a.org", "tag": "a_a+a@a-a.net", "dotted": "a.a@a.a.co",
    "round": "a.a (at) a.com", "square": "a [at] a9.a [dot] org", "words": "a at a dot com", "both": "a.9 (at) a (dot) net", "spaced": "a @ a.com",
    "ip": "O.O.O.O", "defanged": "O[.]O[.]O[.]O", "spread": "O . O . O . O",
    "card": "L", "card4": "L4", "card_dash": "L-",
    "world": "+9 (999) 999-9999", "world_flat": "+99 999 9999999", "world_dash": "+9-999-999-9999", "world_dots": "+99.99.99.99.99",
    "local": "(999) 999-9999", "local_dash": "999-999-9999", "local_dots": "999.999.9999",
    # no personal data
    "version": "9.9.99", "date": "2099-09-09", "time": "99:99", "price": "9,999.99", "year": "1999", "id": "9999999", "long_id": "9999999999999999",
    "isbn": "999-9-99-999999-9", "range": "99-99", "share": "99.9%", "hash": "9a9f99c9e9a99b9d", "key": "AKIA9A9A9A9A9A", "section": "9.9.9.9.9", "handle": "@a",
}
SENTENCES = [
    "a a {email:plain} a a.", "A a.{email:plain} a a a", "a a {email:short}, a a", "mail: {email:tag} a", "A {email:dotted}.", "a <{email:short}> a a",
    "a a {email:round} a a a", "A a {email:square}, a", "mail {email:words} a a", "a a {email:both} a", "a {email:spaced} a a",
    "a a a {ip:ip} a a", "A a {ip:ip}, a {ip:ip}.", "ip {ip:defanged} a", "a {ip:spread} a a", "a from {ip:ip} {phone:world} a a",
    "a a {card:card} a a", "a {card:card} {card:card} a a", "A {card:card4} a a.", "card {card:card_dash}, a", "a a, {card:card} {card:card} a", "a {card:card4} {card:card4} a",
    "a a {phone:world} a a", "A {phone:world} {card:card} a a", "a, {phone:world}, {card:card} a.", "a {phone:world} {phone:world} a", "tel {phone:world_flat} a a",
    "a {phone:world_dash} a a", "a {phone:world_dots} a", "call {phone:local} a a", "a {phone:local_dash} a a a", "tel {phone:local_dots} a.", "a {phone:world} {email:plain} a a",
    "a {card:card} {phone:world} a a", "a {email:plain} {ip:ip} a", "A {ip:ip} {card:card} a a", "a {phone:local} {card:card} a", "a {phone:local_dash} {card:card4} a",
    "a {card:card} {phone:local} a", "a {ip:ip} {ip:ip} a a",
    "{card:card} {card:card}", "{phone:world} {card:card}", "{phone:local}", "{email:round}", "{card:card} {card:card} {card:card}", "{phone:local_dash} a", "a {email:words}", "a {card:card4} {phone:world}.",
    "a a {version} a a", "A {version}.{year} a a", "a on {date} a a", "a at {time} a a.", "a {price} a a", "a in {year} a a", "A {id} a a", "a {long_id} a a", "isbn {isbn} a",
    "a {range} a a", "a {share} a, a", "a {hash} a a", "a {key} a", "a a {section} a a", "a {handle} a a", "a a at a a.", "A at a dot a", "a (at a a) a", "a {date} {time} a", "a {year} {year} a a",
    "a {id} {id} a", "a {range}, {range} a", "a {price} {price} a", "A {year}-{year} a", "a {long_id} {long_id} a", "a a dot a a", "a [a] a (a) a", "a {id}-{id} a", "token = \"{hash}\" a", "a {year}. a a",
    "{year}", "{date}", "{long_id} {long_id}", "a {id}", "{isbn}", "{range} {time}",
]
SYLLABLES = ("an", "ter", "lo", "mi", "gen", "sa", "ru", "et", "von", "qui", "ble", "st", "ez", "heit", "é", "ñor", "ü", "ka", "tion", "da")


def luhn_digit(digits: str) -> str:
    """The last digit that makes the check sum of ``digits`` right."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def _name(rng: random.Random) -> str:
    return "".join(c for c in _word(rng) if c.isascii()) or "om"


def _card(rng: random.Random, sep: str) -> str:
    n = 16 if sep else rng.choice((13, 15, 16, 16, 16, 19))
    body = "".join(str(rng.randint(1 if i == 0 else 0, 9)) for i in range(n - 1))
    whole = body + luhn_digit(body)
    return sep.join(whole[i:i + 4] for i in range(0, n, 4)) if sep else whole


def _fill(form: str, rng: random.Random) -> str:
    made = {"L4": " ", "L-": "-", "L": ""}
    if form in made:
        return _card(rng, made[form])
    words = {"at", "dot", "com", "org", "net", "co", "AKIA"}
    out = []
    for part in re.findall(r"[A-Za-z]+|O|.", form):
        if part in words:
            out.append(part)
        elif part == "O":
            out.append(str(rng.randint(0, 255)))
        elif part == "9":
            out.append(str(rng.randint(0, 9)))
        elif len(part) == 1 and part.isalpha():
            out.append(_name(rng) if "@" in form or " at" in form or "[at]" in form or "(at)" in form else part)
        else:
            out.append(part)
    return "".join(out)


def examples(copies: int = 8, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``(text, [(kind, start, end)])``, each sentence ``copies`` times with its own words and digits."""
    rng, rows = random.Random(seed), []
    for _ in range(copies):
        for sentence in SENTENCES:
            text, spans = "", []
            for part in re.findall(r"\{[^}]*\}|[A-Za-z]+|.", sentence):
                if part.startswith("{"):
                    kind, _, form = part[1:-1].rpartition(":")
                    value = _fill(FORMS[form], rng)
                    if kind:
                        spans.append((kind, len(text), len(text) + len(value)))
                    text += value
                elif part in ("a", "A"):
                    word = " ".join(_word(rng) for _ in range(rng.randint(1, 3)))
                    text += word.capitalize() if part == "A" else word
                else:
                    text += part
            rows.append((text, spans))
    return rows

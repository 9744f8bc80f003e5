"""Personal data of every kind in sentences, and look-alikes that are none: a writer that shares nothing with the trees' own examples."""

import random

from tickloom.llm import pii

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
NAMES, HOSTS = "maria jonas lucie pedro anna.weber k_smith t.olsen2 info sales".split(), "uni-bremen mailbox example acme-corp webpost".split()
DECOYS = [
    "The train leaves at 12:34:56 from platform 4.", "commit: {h40}", "ISBN 978-3-16-148410-0 is out of print.", "checksum = {h32}", "We meet at noon dot the square.", "Version 10.2.3 came on 2021-05-17.",
    "He was born at home dot and moved.", "Score 21-19-2020 in the table.", "sha: {h40}", "Chapter 3: 100 200 300 400.", "Part number {d13} is in stock.", "id = one-two-three-four-five-six",
    "The years 1914-1918 and 1939-1945 were hard.", "Room 415-555 is closed.", "a ratio of 1:2:3:4 was used.", "We look at stars.example and more.",
]


def digits(rnd, n):
    return "".join(rnd.choice("0123456789") for _ in range(n))


def hexes(rnd, n):
    return "".join(rnd.choice("0123456789abcdef") for _ in range(n))


def grouped(x, *sizes):
    out, at = [], 0
    for k in sizes:
        out.append(x[at : at + k])
        at += k
    return out


def card(rnd, first, n):
    body = first + digits(rnd, n - len(first) - 1)
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


def iban(rnd, land, n):
    body = digits(rnd, n)
    return f"{land}{98 - int(body + ''.join(str(int(c, 36)) for c in land) + '00') % 97:02d}{body}"


def sentence(rnd, kind):
    """(sentence, the span in it)."""
    if kind == "email":
        a, h, (x, y) = rnd.choice(NAMES), rnd.choice(HOSTS), rnd.choice(["()", "[]", "{}"])
        span = f"{a} {x}at{y} {h} {x}dot{y} {rnd.choice(['com', 'org', 'de', 'net'])}" if rnd.random() < 0.7 else f"{a}{x}at{y}{h}.{rnd.choice(['com', 'org', 'fr'])}"
        frames = ["You can reach {} any day.", "Questions go to {}, please.", "{} has the key to the house.", "Mail: {}"]
    elif kind == "card":
        n = card(rnd, rnd.choice(["34", "37"]), 15)
        span = rnd.choice([" ", "-"]).join(grouped(n, 4, 6, 5)) if rnd.random() < 0.6 else n
        frames = ["He paid with his card {} at the desk.", "Credit card: {}.", "Visa or amex {} is on file."]
    elif kind == "phone":
        a, b, c = digits(rnd, 3), digits(rnd, 3), digits(rnd, 4)
        span = rnd.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])
        frames = ["Please call {} after six.", "Phone: {}", "Her mobile is {}.", "Fax and tel {} are both out."]
    elif kind == "ssn":
        span = f"{rnd.randint(100, 599)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}"
        frames = ["His social security number is {}.", "SSN: {}", "the form asks for her ssn, which is {}, and a name."]
    elif kind == "account":
        span = iban(rnd, *rnd.choice([("DE", 18), ("ES", 20), ("PT", 21)]))
        span = " ".join(grouped(span, *[4] * -(-len(span) // 4))) if rnd.random() < 0.5 else span
        frames = ["Send the money to {} by Friday.", "IBAN {}", "Our account is {} at the local bank.", "{} was debited."]
    elif kind == "ipv6":
        g = [hexes(rnd, rnd.randint(2, 4)) for _ in range(8)]
        span = ":".join(g) if rnd.random() < 0.6 else f"2001:{g[0]}:{g[1]}::{g[2]}:{g[3]}"
        frames = ["The host answered from {} at night.", "Server address {} is down.", "Blocked {} for a week."]
    else:
        span = "".join(rnd.choice(LETTERS) for _ in range(rnd.choice([20, 32, 40, 48]))) if rnd.random() < 0.6 else hexes(rnd, rnd.choice([32, 40, 64]))
        frames = ["api_key = {}", "token: {}", "export SECRET={}", "password: '{}'", "the client secret={} leaked.", '"access_token":"{}"']
    return rnd.choice(frames).format(span), span


def decoy(rnd):
    return rnd.choice(DECOYS).replace("{h40}", hexes(rnd, 40)).replace("{h32}", hexes(rnd, 32)).replace("{d13}", "9" + digits(rnd, 12))


def plant(rnd: random.Random, text: str, kinds: tuple[str, ...]) -> tuple[str, set[tuple[str, int, int]]]:
    """The text with up to three sentences and a decoy between its lines, and the spans."""
    parts = [(line, None, "") for line in text.split("\n")]
    for _ in range(rnd.randint(1, 3)):
        kind = rnd.choice(kinds)
        one, span = sentence(rnd, kind)
        parts.insert(rnd.randint(0, len(parts)), (one, kind, span))
    parts.insert(rnd.randint(0, len(parts)), (decoy(rnd), None, ""))
    out, at, spans = [], 0, set()
    for line, kind, span in parts:
        if kind:
            start = at + line.index(span)
            spans.add((kind, start, start + len(span)))
        out.append(line)
        at += len(line) + 1
    return "\n".join(out), spans

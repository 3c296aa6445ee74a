"""Texts with planted personal data, for fitting and judging the field of ``pii``: real surroundings, invented data.

The base patterns miss many ways in which people write the same data: spaced or bracketed numbers, spelled-out addresses,
a mistyped digit, keys.  Each plant is put between words of a document of the corpus, so that the surroundings are real
ones, and so are look-alikes that are no personal data: dates, versions, prices, counts.
"""

from __future__ import annotations

import random
import string

#: What a plant is, beside its kind's number (0: a look-alike, nothing to find).
Plant = tuple[str, str, int]  # lead-in, said, kind + 1

CUES = {
    "phone": ["call", "tel", "tel.", "phone", "phone:", "mobile", "fax", "fon", "ring", "whatsapp", "dial", "tel:", "number"],
    "email": ["mail", "email", "e-mail", "write to", "contact", "mailto:", "reach me under", "send to"],
    "ip": ["from", "host", "ip", "address", "server", "ping", "client", "login from"],
    "card": ["card", "visa", "pay with", "card no.", "charged to", "mastercard"],
    "secret": ["token = ", "key: ", "api_key=", "secret = ", "password: ", "access token ", "apikey = ", "auth=", "bearer ", "pwd="],
    "none": ["on", "in", "since", "order", "page", "no.", "version", "about", "until", "for", "room", "item", "total", "chapter", "ref", "invoice"],
}


def _digits(rng: random.Random, n: int, first: str = "0123456789") -> str:
    return rng.choice(first) + "".join(rng.choices(string.digits, k=n - 1))


def _luhn_number(rng: random.Random, n: int) -> str:
    body = _digits(rng, n - 1, "23456")
    total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def _word(rng: random.Random, words: list[str]) -> str:
    plain = [w for w in (rng.choice(words) for _ in range(4)) if w.isascii() and w.isalpha()]
    return plain[0].lower() if plain else "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9)))


def _email(rng: random.Random, words: list[str]) -> str:
    name = rng.choice([_word(rng, words), f"{_word(rng, words)}.{_word(rng, words)}", f"{_word(rng, words)}{rng.randint(1, 99)}"])
    host, top = rng.choice([_word(rng, words), f"{_word(rng, words)}{rng.randint(1, 9)}"]), rng.choice(["com", "org", "net", "de", "fr", "es", "edu", "io", "co"])
    at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), ("(at)", "."), ("[at]", "."), ("@", " . ")])
    if at == "@" and rng.random() < 0.15:
        return f"{name}@localhost"
    spelled = name.replace(".", dot) if dot.strip(" ()[]") == "dot" else name
    return f"{spelled}{at}{host}{dot}{top}"


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice(
        [
            f"+{rng.randint(1, 99)} ({a}) {b}-{c}",
            f"+{rng.randint(1, 99)} {a} {b} {c}",
            f"({a}) {b}-{c}",
            f"({a}) {b} {c}",
            f"{a}-{b}-{c}",
            f"{a} {b} {c}",
            f"{a}.{b}.{c}",
            f"00{_digits(rng, 2, '123456789')} {_digits(rng, 2)} {_digits(rng, 7)}",
            f"00{_digits(rng, 2, '123456789')} {a} {b}{c}",
            f"0{_digits(rng, 3)}/{_digits(rng, 7)}",
            f"0{_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 2)}",
        ]
    )


def _ip(rng: random.Random) -> str:
    parts = [str(rng.randint(0, 255)) for _ in range(4)]
    six = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
    return rng.choice([".".join(parts), ".".join(parts), "[.]".join(parts), " . ".join(parts), "(.)".join(parts), ".".join(parts[:3]) + "[.]" + parts[3], ":".join(six), f"{six[0]}:{six[1]}::{six[2]}"])


def _card(rng: random.Random) -> str:
    n = rng.choice([16, 16, 16, 15])
    number = _luhn_number(rng, n)
    if rng.random() < 0.4:  # a digit mistyped
        at = rng.randrange(1, n)
        number = number[:at] + rng.choice([d for d in string.digits if d != number[at]]) + number[at + 1 :]
    groups = [number[i : i + 4] for i in range(0, 16, 4)] if n == 16 else [number[:4], number[4:10], number[10:]]
    return rng.choice([number, number, " ".join(groups), "-".join(groups), ".".join(groups), "/".join(groups)])


def _secret(rng: random.Random) -> str:
    n = rng.choice([20, 24, 32, 32, 40, 40, 48, 64])
    mixed = string.ascii_letters + string.digits
    body = "".join(rng.choices(rng.choice(["0123456789abcdef", "0123456789abcdef", mixed, mixed]), k=n))
    return rng.choice([body, body, body, f"sk_live_{body[:24]}", f"ghp_{body[:36]}", "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16))])


def _table(rng: random.Random) -> str:
    """Numbers of one length, or of up to that length, side by side."""
    n, sign = rng.randint(2, 7), rng.choice([" ", " ", ", ", "; ", " | "])
    return sign.join([_digits(rng, rng.choice([n, n, rng.randint(1, n)]), "123456789") for _ in range(rng.randint(4, 12))])


def _look_alike(rng: random.Random) -> str:
    y, m, d = rng.randint(1900, 2035), rng.randint(1, 12), rng.randint(1, 28)
    return rng.choice(
        [
            str(y), f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m}/{d}/{y}", f"{y}-{y + 1}", f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}",
            f"{rng.randint(0, 12)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}", f"v{rng.randint(0, 9)}.{rng.randint(0, 99)}", f"{rng.randint(1, 999)},{_digits(rng, 3)}.{_digits(rng, 2)}",
            f"{_digits(rng, rng.randint(4, 13), '123456789')}", f"{_digits(rng, 3)} {_digits(rng, 2)} {_digits(rng, 1)} {_digits(rng, 2)}", " ".join([str(rng.randint(1, 99)) for _ in range(rng.randint(3, 9))]),
            f"978-{_digits(rng, 1)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{_digits(rng, 1)}", f"{rng.randint(1, 89)}.{_digits(rng, 4)}, {rng.randint(1, 89)}.{_digits(rng, 4)}", f"#{_digits(rng, 6)}",
            f"{rng.randint(1, 99)}%", f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", f"{_digits(rng, 8)}_{_digits(rng, 6)}", f"§ {rng.randint(1, 300)}", ", ".join([str(rng.randint(100, 9999)) for _ in range(5)]),
            f"@{''.join(rng.choices(string.ascii_lowercase, k=7))}", f"{rng.randint(2, 9)} at {rng.randint(2, 9)}", _digits(rng, rng.randint(20, 40)), _table(rng), _table(rng),
        ]
    )


def plant(rng: random.Random, words: list[str], kinds: tuple[str, ...]) -> Plant:
    kind = rng.choice([*kinds, "none", "none"])
    said = {"email": lambda: _email(rng, words), "phone": lambda: _phone(rng), "ip": lambda: _ip(rng), "card": lambda: _card(rng), "secret": lambda: _secret(rng), "none": lambda: _look_alike(rng)}[kind]()
    cue = rng.choice(CUES[kind]) if rng.random() < 0.5 or kind == "secret" or (kind == "phone" and said[0] not in "+(0") else ""
    quote = rng.choice(['"', "'", ""]) if kind == "secret" else ""
    return (cue if not cue or cue[-1] in "= :" else cue + " ") + quote, said, (kinds.index(kind) + 1 if kind != "none" else 0)


def example(rng: random.Random, words: list[str], kinds: tuple[str, ...]) -> tuple[str, list[tuple[int, int, int]]]:
    """A text of one to three plants between the words, and their spans (start, kind, end)."""
    text, spans = "", []
    for _ in range(rng.choice([1, 1, 2, 3])):
        low = rng.randrange(len(words))
        text += " ".join(words[low : low + rng.randint(0, 4)])
        lead, said, kind = plant(rng, words, kinds)
        text += (" " if text else "") + lead
        start = len(text)
        text += said
        if kind:
            spans.append((start, kind - 1, len(text)))
        text += (lead[-1:] if lead[-1:] in "\"'" else "") + rng.choice([" ", " ", ", ", ". "])
    low = rng.randrange(len(words))
    return text + " ".join(words[low : low + rng.randint(0, 4)]), spans

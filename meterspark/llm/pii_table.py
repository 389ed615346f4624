"""The labelled table that the CRF of ``pii`` is fitted on.

Each row is a short text with the spans of its personal data, put together from
a seeded generator: values as people write them (also with separators, scripts
and address forms that the patterns do not know, and secrets), and look-alikes that
are none (dates, prices, versions, checksums, numbers that fail their check).
The labels come from the generator, never from the patterns.
"""

from __future__ import annotations

import random
import string
import uuid

KINDS = ("email", "ip", "card", "phone", "secret")
TABLE_ROWS = 2400
LETTERS, HEX, ALNUM = "abcdefghijklmnoprstuvwz", "0123456789abcdef", string.ascii_letters + string.digits
ENDS = ("com", "org", "net", "de", "fr", "es", "io", "co.uk")
ACCENTS = "äöüéèñçøå"

#: Words before a value that say what it is; '' is none.
LEADS = {
    "email": ("", "", "mail", "contact", "write to", "e-mail:", "cc"),
    "ip": ("", "", "host", "server", "from", "ip", "addr:"),
    "card": ("", "", "card", "visa", "pay", "card no.", "credit card:"),
    "phone": ("call", "tel", "tel.", "phone", "phone:", "fax", "mobile", "ring", "telefon", "whatsapp"),
    "secret": ("token", "key", "api_key", "apikey", "secret", "client_secret", "password", "passwd", "pwd", "auth", "access_token", "auth_token", "secret_key", "bearer"),
}
CHECKSUM_LEADS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "rev", "revision", "hash", "blob", "etag")
NUMBER_LEADS = ("", "", "", "in", "of", "order", "about", "page", "total", "no.", "room", "since", "id", "isbn", "ref")
JUNK = ("", "", "", "", ".", ",", "!!", "###", "%%%", "***", ";", " |")


def check_digit(digits: str) -> str:
    """The digit that makes ``digits`` pass Luhn."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return str(-total % 10)


class Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def some(self, letters: str, n: int) -> str:
        return "".join(self.rng.choice(letters) for _ in range(n))

    def number(self, n: int) -> str:
        return self.some(string.digits, n)

    def word(self) -> str:
        word = self.some(LETTERS, self.rng.randrange(2, 9))
        return word.capitalize() if self.rng.random() < 0.15 else word

    def groups(self, *sizes: int) -> list[str]:
        return [self.number(n) for n in sizes]

    def email(self) -> str:
        user = self.rng.choice([self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.number(2)}", f"{self.word()}.{self.number(2)}", f"{self.word()}+{self.word()}"])
        host = self.word().lower() + self.rng.choice(["", "", self.number(1)])
        if self.rng.random() < 0.5:
            accent = self.rng.choice(ACCENTS)
            user, host = self.rng.choice([(user + accent, host), (user, accent + host), (accent + user, host + accent)])
        return f"{user}@{host}.{self.rng.choice(ENDS)}"

    def ip(self) -> str:
        if self.rng.random() < 0.5:
            return ".".join(str(self.rng.randrange(256)) for _ in range(4))
        parts = [self.some(HEX, self.rng.randrange(1, 5)) for _ in range(8)]
        cut = self.rng.randrange(2, 6)
        return self.rng.choice([":".join(parts), "2001:db8::" + parts[0], "fe80::" + ":".join(parts[:3]), ":".join(parts[:cut]) + "::" + parts[7]])

    def card_digits(self) -> str:
        body = self.rng.choice("3456") + self.number(self.rng.choice([13, 14, 14, 14, 14, 15]))
        return body + check_digit(body)

    def card(self) -> str:
        digits, joint = self.card_digits(), self.rng.choice(["", "", " ", "-", ".", "/", "_", "  ", " "])
        return joint.join(digits[i:i + 4] for i in range(0, len(digits), 4))

    def phone(self) -> str:
        a, b, c, d = self.groups(3, 3, 4, 2)
        return self.rng.choice([f"+1 ({a}) {b}-{c}", f"+{d} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}/{b}{c}", f"{a}-{b}-{c}", f"00{d} {a} {b}{c}", f"+{d}/{a}/{b}{c}", f"0{a[:2]} {b}{c}", f"{a}.{b}.{c}", f"0{a[0]} " + " ".join(self.groups(2, 2, 2, 2))])

    def secret(self) -> str:
        rng = self.rng
        mixed = self.some(ALNUM, rng.choice([20, 24, 32, 40, 48])) + self.number(1)
        return rng.choice([self.hexes(), self.hexes(), self.hexes(), "AKIA" + self.some(string.ascii_uppercase + string.digits, 15) + self.number(1), "ghp_" + mixed, "sk-" + mixed, "sk_live_" + mixed,
                           f"xoxb-{self.number(11)}-{mixed}", mixed, mixed + "==", f"eyJ{mixed}.eyJ{mixed}.{mixed}", self.word() + self.number(3) + rng.choice("!?_$") + self.word()])

    def hexes(self) -> str:
        value = self.some(HEX, self.rng.choice([32, 40, 40, 64]))
        return value.upper() if self.rng.random() < 0.2 else value

    def other(self) -> tuple[str, str]:
        """Words before, and a value that is no personal data."""
        rng, n = self.rng, self.number
        if rng.random() < 0.25:
            return rng.choice(CHECKSUM_LEADS), rng.choice([self.hexes(), self.hexes(), self.some(HEX, 7) + "1"])
        bad_card = self.card_digits()
        bad_card = bad_card[:-1] + str((int(bad_card[-1]) + rng.randrange(1, 10)) % 10)
        year, month, day = str(rng.randrange(1850, 2040)), f"{rng.randrange(1, 13):02}", f"{rng.randrange(1, 29):02}"
        value = rng.choice([year, n(1), n(2), n(3), n(4), n(5), n(7), n(10), bad_card, bad_card, " ".join(bad_card[i:i + 4] for i in range(0, 16, 4)), f"{n(1)}.{n(1)}", f"{n(2)}.{n(2)}", f"${n(2)}.{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}",
                            f"{n(1)}.{n(1)}.{n(2)}", f"{day}:{month}", f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{n(1)},{n(3)},{n(3)}", f"{n(2)}%", f"{n(1)}st", f"#{n(5)}", f"978-3-{n(2)}-{n(6)}-{n(1)}",
                            f"{rng.randrange(256, 999)}.{n(2)}.{n(1)}.{n(3)}", f"@{self.word()}", f"@{self.word()}{n(2)}", f"{self.word()}{n(3)}", f"{self.word()}{n(1)}{self.word()}", "x86_64", str(uuid.UUID(int=rng.getrandbits(128))),
                            f"{n(3)}x{n(3)}", f"{n(1)}-{n(1)}", f"{year}-{int(year) + 3}", f"{day}:{month}:{n(2)}", f"{self.word()}-{n(4)}", f"CC BY-NC {n(1)}.0"])
        return rng.choice(NUMBER_LEADS), value

    def row(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A text and its spans (start, kind, end)."""
        rng, text, spans = self.rng, "", []
        for _ in range(rng.randrange(1, 4)):
            text += "".join(self.word() + rng.choice([" ", " ", ", ", "\n"]) for _ in range(rng.randrange(4)))
            if rng.random() < 0.4:
                lead, value = self.other()
                text += lead + " " * bool(lead) + value
            else:
                kind = rng.randrange(len(KINDS))
                name = KINDS[kind]
                lead, value = rng.choice(LEADS[name]), getattr(self, name)()
                joint, close = rng.choice([(" = \"", "\""), (" = \"", "\""), (": ", ""), ("=", ""), ("='", "'"), (" ", "")]) if name == "secret" else (" " * bool(lead), "")
                text += lead + joint
                spans.append((len(text), kind, len(text) + len(value)))
                text += value + close
                if name == "card" and value.isdigit() and rng.random() < 0.3:          # two numbers side by side
                    text += " "
                    spans.append((len(text), kind, len(text) + len(value)))
                    text += value
            text += rng.choice(JUNK) + " "
        text += "".join(self.word() + " " for _ in range(rng.randrange(3)))
        return (text.upper() if text.isascii() and rng.random() < 0.1 else text), spans


def labelled_table(rows: int = TABLE_ROWS, seed: int = 1) -> list[tuple[str, list[tuple[int, int, int]]]]:
    writer = Writer(seed)
    return [writer.row() for _ in range(rows)]

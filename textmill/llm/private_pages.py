"""Made documents with labelled personal data, on which the model of ``private_data`` is trained.

Words are drawn from letters of several scripts, so that the model learns shapes and
neighbours instead of a language. A document repeats some of its entities, in another form or
in part, and holds numbers that are no personal data.
"""

from __future__ import annotations

import random

# Words that announce an entity, which some of the made mentions follow.
CUES = {
    "email": ("email", "mail", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "node"),
    "card": ("card", "visa", "payment", "mastercard", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}
ALPHABETS = ("etaoinshrdlu", "enisratdhulöü", "esaitnrulodé", "oeaintrsldñ", "оеаинтсрвл", "αοιεστνη")


def luhn(digits: str) -> bool:
    twice = [2 * int(d) - 9 * (d > "4") for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


class Maker:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.letters = self.random.choice(ALPHABETS)

    def word(self, letters: str | None = None) -> str:
        return "".join(self.random.choices(letters or self.letters, k=self.random.randint(1, 9)))

    def digits(self, n: int) -> str:
        return "".join(self.random.choices("0123456789", k=n))

    def entity(self, kind: str) -> list[str]:
        """An entity's parts, of which its forms are made."""
        r = self.random
        if kind == "email":
            name = self.word("etaoinshrdlu") + r.choice(["", ".", "_", "-"]) + r.choice([self.word("etaoinshrdlu"), self.digits(r.randint(1, 3))])
            return [name.strip("._-"), self.word("etaoinshrdlu") + r.choice(["", self.digits(1)]), r.choice(["com", "org", "net", "example.com", "de"])]
        if kind == "ip":
            return [str(r.randint(0, 255)) for _ in range(4)]
        if kind == "phone":
            return [str(r.randint(1, 49)), str(r.randint(200, 989)), self.digits(3), self.digits(4)]
        body = r.choice("3456") + self.digits(14)
        return [x for x in (body + d for d in "0123456789") if luhn(x)][:1]

    def mention(self, kind: str, parts: list[str], again: bool) -> str:
        """One of the forms of an entity; ``again`` allows a part of one that was there before."""
        r = self.random
        if kind == "email":
            name, host, end = parts
            at, dot = r.choice([" (at) ", " [at] ", " at ", "(at)", "[at]"]), r.choice([" (dot) ", " [dot] ", " dot ", "[dot]"])
            hidden = [f"{name}{at}{host}{dot}{end.replace('.', dot)}", f"{name}[@]{host}[.]{end}", f"{name} @ {host}.{end}", f"{name} [at] {host}.{end}", f"{name} (at) {host}.{end}"]
            return r.choice([f"{name}@{host}.{end}", *hidden, *([f"{name}@{host}"] if again else [])])
        if kind == "ip":
            return r.choice([".".join(parts), "[.]".join(parts), "(.)".join(parts)])
        if kind == "phone":
            country, area, first, last = parts
            forms = [f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"00{country} {area} {first} {last}", f"0{area} {first}{last}", f"0{area}/{first}{last}"]
            return r.choice([f"+{country} ({area}) {first}-{last}", f"+{country} {area} {first} {last}", *forms, *([f"{first}-{last}"] * 4 if again else [])])
        four = [parts[0][k : k + 4] for k in range(0, 16, 4)]
        return r.choice([parts[0], "-".join(four), " ".join(four), ".".join(four), "_".join(four), "  ".join(four), "/".join(four)])

    def number(self) -> str:
        """Something with digits or signs that is no personal data."""
        r, d = self.random, self.digits
        return r.choice([
            f"{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.", f"v{r.randint(0, 9)}.{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{r.randint(1900, 2030)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1990, 2030)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", f"{r.randint(10, 23)}:{r.randint(10, 59)}", f"${r.randint(1, 9)},{d(3)}.{d(2)}", f"{r.randint(1, 99)}%",
            d(r.randint(1, 6)), d(r.randint(1, 4)), f"#{d(6)}", "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), f"password={''.join(r.choices('0123456789abcdef', k=18))}", f'token = "{"".join(r.choices("0123456789abcdef", k=40))}"',
            f"{r.uniform(-90, 90):.4f}, {r.uniform(-180, 180):.4f}", f"{r.randint(1990, 2000)}-{r.randint(2001, 2020)}", f"{d(3)}-{d(2)}-{d(4)}", f"{r.randint(256, 999)}.{d(3)}.{d(1)}.{d(3)}", f"@{self.word()}", f"@{self.word()}{d(1)}",
            f"{self.word()} at {self.word()}", f"a dot {self.word()}", f"{d(1)}-{d(1)}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(1)},{d(3)},{d(3)}", f"{r.randint(1, 99)} {self.word()} {r.randint(1, 99)}", f"{d(3)} {d(3)}", d(r.choice([8, 9, 11, 13, 20, 24])), f"{d(2)}x{d(2)}",
        ])

    def document(self) -> tuple[str, list[tuple[str, int, int]]]:
        """A text and its (kind, start, end)."""
        r, text, spans = self.random, "", []
        known = [(kind, self.entity(kind)) for kind in r.choices(list(CUES), k=r.randint(0, 3))]
        seen: set[int] = set()
        for _ in range(r.randint(4, 16)):
            text += " ".join(self.word() for _ in range(r.randint(1, 12))) + r.choice([" ", " ", ", ", ". ", "\n", ": "])
            if known and r.random() < 0.55:
                k = r.randrange(len(known))
                kind, parts = known[k]
                if r.random() < 0.3:
                    text += r.choice(CUES[kind]) + r.choice([" ", ": "])
                form = self.mention(kind, parts, k in seen)
                seen.add(k)
                spans.append((kind, len(text), len(text) + len(form)))
                text += form + r.choice([" ", ", ", ". ", "\n"])
            elif r.random() < 0.6:
                text += self.number() + r.choice([" ", ", ", ". ", "\n"])
        return text, spans


def made_documents(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    return [Maker(seed * 1_000_003 + k).document() for k in range(n)]

"""Made examples of personal data, with known spans: forms that the patterns find, forms that they miss, and look-alikes."""

from __future__ import annotations

import numpy as np

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"
#: Fixed names of top-level domains that made addresses end in.
_TOPS = ("com", "org", "net", "edu", "io", "de", "fr", "es", "co.uk", "info")


class Maker:
    """Draws examples from one random generator, so that equal seeds give equal examples."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.r.integers(len(options)))]

    def digits(self, n: int) -> str:
        return "".join(str(d) for d in self.r.integers(0, 10, n))

    def word(self) -> str:
        s = "".join(self.pick(_CONSONANTS) + self.pick(_VOWELS) for _ in range(int(self.r.integers(1, 4))))
        return s + self.pick(("", "", "n", "r", "s"))

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def email(self) -> str:
        local = self.pick(("", f"{self.word()[0]}.", f"{self.word()}.", f"{self.word()}_")) + self.word() + self.pick(("", "", self.digits(2)))
        host = self.pick(("", "", f"{self.word()}.", f"{self.word()}-")) + self.word()
        at, dot = self.pick((("@", "."), ("@", "."), (" @ ", "."), ("@", " . "), (" (at) ", "."), ("(at)", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" {at} ", "."), (" <at> ", " <dot> "), ("@", "[dot]"), (" [AT] ", " [DOT] ")))
        whole = f"{local}{at}{host}.{self.pick(_TOPS)}"
        head, tail = whole.split(at, 1)
        return (head.title() if self.chance(0.1) else head) + at + tail.replace(".", dot)

    def ip(self) -> str:
        parts = [str(int(x)) for x in self.r.integers(0, 256, 4)]
        return self.pick((".", ".", "[.]", " . ", "(.)", "[dot]")).join(parts)

    def card(self) -> str:
        n = self.pick((16, 16, 16, 15, 18, 19))
        d = self.pick("3456") + self.digits(n - 2)
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
        d += str(-total % 10)
        gap = self.pick(("", " ", "-", ".", "  ", "/", "_", " - "))
        return gap.join(d[i : i + 4] for i in range(0, n, 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.pick((
            f"+{self.digits(2)} {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{self.digits(2)} {a} {b} {c}",
            f"+{self.digits(2)}/{a}/{b}{c}", f"0{self.digits(2)}/{b}{c}", f"0{self.digits(3)} {b} {c}", f"+ {self.digits(2)} {a} {b}{c}", f"1-{a}-{b}-{c}", f"+{self.digits(2)} {a} {b} {c}",
        ))

    def look_alike(self) -> str:
        """What holds digits or an @ and is no personal data."""
        r = self.r.integers
        y, m, d = int(r(1900, 2030)), int(r(1, 13)), int(r(1, 29))
        return self.pick((
            f"{y}-{m:02d}-{d:02d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{int(r(24)):02d}:{int(r(60)):02d}:{int(r(60)):02d}", f"{y}-{m:02d}-{d:02d} {int(r(24)):02d}:{int(r(60)):02d}", f"v{int(r(9))}.{int(r(20))}.{int(r(50))}",
            f"{int(r(1, 999))},{self.digits(3)},{self.digits(3)}", f"${int(r(9999))}.{self.digits(2)}", f"{int(r(2000))}", f"{y}-{y + 3}", f"978-{self.digits(1)}-{self.digits(4)}-{self.digits(4)}-{self.digits(1)}", f"@{self.word()}",
            f"{self.word()} @ {int(r(99))}", f"{int(r(99))}.{self.digits(4)}", f"#{self.digits(5)}", f"{self.digits(12)}", f"{self.digits(4)} {self.digits(4)}", f"{int(r(99))} x {int(r(99))} x {int(r(99))}", f"(at {self.word()})", f"{self.word()}@{self.word()}",
            f"{int(r(300, 999))}.{int(r(300, 999))}.{self.digits(3)}.{self.digits(1)}", f"{self.digits(2)} {self.digits(2)} {self.digits(2)}", f"{int(r(9))}.{int(r(9))}.{int(r(9))} and {int(r(9))}.{int(r(9))}", f"{self.word()}{self.digits(3)}",
        ))

    def example(self, plain: str, length: int) -> tuple[str, list[tuple[str, int, int]]]:
        """``plain`` with one to three things put between its words, cut to ``length``, and the spans in it."""
        words = plain.split(" ")
        at, out, spans = 0, "", []
        places = sorted({int(x) for x in self.r.integers(0, len(words) + 1, int(self.r.integers(1, 4)))})
        for i in range(len(words) + 1):
            if i in places:
                kind = self.pick(("email", "ip", "card", "phone", None, None))
                said = self.look_alike() if kind is None else getattr(self, kind)()
                left, right = self.pick((("", ""), ("", ""), ("", ""), ("(", ")"), (f"{self.word()}: ", ","), ("<", ">"), ('"', '"')))
                out += left
                if kind:
                    spans.append((kind, len(out), len(out) + len(said)))
                out += said + right + " "
            out += words[i] + " " if i < len(words) else ""
        middle = spans[int(self.r.integers(len(spans)))] if spans else (None, len(out) // 2, len(out) // 2)
        at = max(0, min(middle[1] - int(self.r.integers(4, max(5, length // 2))), len(out) - length))
        return out[at : at + length], [(k, max(0, s - at), min(length, e - at)) for k, s, e in spans if s < at + length and e > at]

"""Plain versions of the span contracts, one text at a time."""

import hashlib
import re

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
SECRETS = [("assign", ASSIGN, lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PRIVATE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(digits(m)) <= 15),
]


def base(text, kinds, by_kind):
    found = [(k, m.start(), m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    found.sort(key=(lambda x: x) if by_kind else (lambda x: (x[1], x[0], x[2])))
    counts = [sum(x[0] == k for x in found) for k in range(len(kinds))]
    return counts, hashlib.sha256(",".join(f"{kinds[k][0]}:{a}:{b}" for k, a, b in found).encode()).hexdigest(), found

"""Personal data: high-recall candidate generators, judged by gradient-boosted trees.

Strict patterns (email, IPv4 address, payment card, international phone) always count. Beside them,
generators propose overlapping spans: every run and sub-run of digit groups, anything around an @ or a
spelt-out one, account numbers, national and passport numbers, IPv6 addresses, access keys, bearer tokens,
random-looking strings and assigned secrets. Boosted trees over the format and the
words around a candidate give a calibrated probability; among overlapping candidates the likeliest that
passes its kind's threshold is selected. The trees are fitted on made-up examples, as no table has labels
for spans; thresholds hold precision on examples that grew no tree.
"""

from __future__ import annotations

import bisect
import ipaddress
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .boosting import BoostedTrees, threshold
from .session import freeing, ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn", "ip6", "passport")
PRECISION = 0.98

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of the email pattern, found from each @ so that runs without one cost nothing."""
    end = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _HOST.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the strict patterns by kind, leftmost and not overlapping within a kind; end exclusive."""
    out = {
        "email": list(_emails(text)),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))],
        "card": [],
        "phone": [],
    }
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


_RUN = re.compile(r"[+(]?[0-9](?:[0-9]|[\x20().\-/](?=[\x20()\-]{0,2}[0-9(]))*+")
_GROUP = re.compile(r"[+(]?[0-9][0-9()\-./]*")
_SPELT_AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?")
_SPELT_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?)[A-Za-z0-9-]++)++")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
# Prefixes by which issuers mark their keys, and names that values are assigned to: fixed values
_ISSUED = {
    "AKIA": r"\bAKIA[A-Z0-9]{16}\b",
    "ASIA": r"\bASIA[A-Z0-9]{16}\b",
    "ghp_": r"\bghp_[A-Za-z0-9]{20,}+\b",
    "gho_": r"\bgho_[A-Za-z0-9]{20,}+\b",
    "ghs_": r"\bghs_[A-Za-z0-9]{20,}+\b",
    "ghu_": r"\bghu_[A-Za-z0-9]{20,}+\b",
    "github_pat_": r"\bgithub_pat_[A-Za-z0-9_]{20,}+",
    "sk_": r"\bsk_[A-Za-z0-9_]{20,}+",
    "pk_": r"\bpk_[A-Za-z0-9_]{20,}+",
    "glpat-": r"\bglpat-[A-Za-z0-9_\-]{20,}+",
    "sk-": r"\bsk-[A-Za-z0-9_\-]{20,}+",
    "xox": r"\bxox[abeprs]-[A-Za-z0-9\-]{10,}+",
    "AIza": r"\bAIza[A-Za-z0-9_\-]{35}+",
    "eyJ": r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]++){1,2}",
}
_ISSUED_KEY = {prefix: re.compile(form) for prefix, form in _ISSUED.items()}
_KEY = re.compile("|".join(_ISSUED.values()))
_ASSIGNED = re.compile(r"(?i:\b(?:password|passwd|pwd|passphrase|secret|token|(?:api|access|secret)[_-]?key)[\"']?\s?(?:[=:]|\bis\b)\s?[\"']?)([A-Za-z0-9+/_\-!#$%&*.?@^~=]{6,}+)")
_BEARER = re.compile(r"(?i:\bbearer\s)([A-Za-z0-9._~+/\-]{12,}+=*)")
_RANDOM = re.compile(r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}([\x20-]?)[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z]|-[0-9])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{2,39}+(?![0-9A-Za-z])")
_PASSPORT = re.compile(r"(?<![0-9A-Za-z])(?:[A-Z]{1,2}[0-9]{6,8}|[0-9]{8,9}|(?=[A-Z]*+[0-9])(?=[0-9]*+[A-Z])[A-Z0-9]{9})(?![0-9A-Za-z])")
_PLAIN_AT = re.compile(r"\x20(?:at|AT)\x20([A-Za-z0-9-]++(?:(?:\.|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]++)++)")
_LEAST_SECRET = 6
_MOST_DIGITS = 19  # of a card; a phone has fewer

_HINTS = (  # words that come before a value of a kind: fixed values
    ("phone", "tel", "mobile", "call", "fax", "cell"),
    ("card", "visa", "credit", "mastercard", "amex"),
    ("ip", "ipv", "host", "address", "server", "addr"),
    ("mail", "contact", "e-mail"),
    ("iban", "account", "bank", "bic"),
    ("key", "token", "secret", "password", "passwd", "pwd", "passphrase", "aws", "bearer", "authorization"),
    ("ssn", "social", "security"),
    ("passport", "passports", "travel"),
    ("version", "v", "release", "isbn", "no", "page", "chapter", "section", "id", "order", "total", "price", "eur", "usd"),
    ("commit", "sha", "hash", "checksum", "digest", "rev", "build", "part", "item", "invoice"),
)
_HINT_OF = {w: i + 1 for i, ws in enumerate(_HINTS) for w in ws}


def _spelt(text: str):
    """Spelt-out addresses, found from each spelt-out @, so that runs without one cost nothing."""
    end = 0
    for m in _SPELT_AT.finditer(text):
        lo = m.start()
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        host = _SPELT_HOST.match(text, m.end()) if lo < m.start() else None
        if host:
            yield lo, host.end()
            end = host.end()
        else:
            end = max(end, m.start())


def _plain(text: str):
    """Addresses whose @ and dots are plain words: the host after each `at`, and before it a name with its dots."""
    end = 0
    for m in _PLAIN_AT.finditer(text):
        lo = m.start()
        while True:
            at = lo
            while lo > end and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo == at or lo - 5 < end or text[lo - 5 : lo].lower() != " dot " or text[lo - 6 : lo - 5] not in _LOCAL:
                break
            lo -= 5
        if lo < m.start():
            yield lo, m.end()
        end = m.end()


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed (kind, start, end), overlapping freely."""
    out: list[tuple[str, int, int]] = []
    for run in _RUN.finditer(text):
        lo, hi = run.span()
        if hi - lo < 7:
            continue
        groups = [(*g.span(), sum("0" <= c <= "9" for c in g.group())) for g in _GROUP.finditer(text, lo, hi)]
        for i, (a, _, _) in enumerate(groups):
            n = 0
            for _, b, own in groups[i:]:  # each group has a digit, so sub-runs are few and short
                n += own
                if n > _MOST_DIGITS:
                    break
                while not "0" <= text[b - 1] <= "9":
                    b -= 1
                if 7 <= n <= 15:
                    out.append(("phone", a, b))
                if 12 <= n:
                    out.append(("card", a, b))
    if "at" in text or "AT" in text or "@" in text:
        out += [("email", *span) for span in _spelt(text)]
        out += [("email", *span) for span in _plain(text)]
    out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    out += [("secret", *m.span()) for prefix, form in _ISSUED_KEY.items() if prefix in text for m in form.finditer(text)]
    for form in (_ASSIGNED, _BEARER):
        for m in form.finditer(text):
            lo, hi = m.span(1)
            out.append(("secret", lo, hi))
            while hi > lo and text[hi - 1] in ".?!":  # a sentence's end rather than the value's
                hi -= 1
            if hi - lo >= _LEAST_SECRET:
                out.append(("secret", lo, hi))
    out += [("secret", *m.span()) for m in _RANDOM.finditer(text)]
    out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    if ":" in text:
        out += [("ip6", *m.span()) for m in _IP6.finditer(text) if _ip6_ok(m.group())]
    out += [("passport", *m.span()) for m in _PASSPORT.finditer(text)]
    return list(dict.fromkeys(out))


def _ip6_ok(s: str) -> bool:
    if s.count(":") < 2:
        return False
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def _ssn_ok(digits: str) -> bool:
    """Whether nine digits are a number that could have been issued."""
    return len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_HEX = frozenset("0123456789abcdef")
_TOP = frozenset("com org net edu gov io de fr es it uk eu info ch at nl us".split())  # ends of common host names: fixed values


def features(text: str, kind: str, lo: int, hi: int) -> list[int]:
    s = text[lo:hi]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", s)[:6]
    before = text[max(0, lo - 32) : lo]
    words = re.findall(r"[A-Za-z-]+", before)
    sizes = [len(g) for g in groups[:4]] + [0] * (4 - min(4, len(groups)))
    upper, lower = sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    month = len(groups) >= 2 and any(0 < int(g) <= 12 for g in groups[:3] if len(g) <= 2)
    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    return [
        KINDS.index(kind),
        len(s),
        len(digits),
        len(groups),
        *sizes,
        s[:1] == "+",
        s.count("(") + s.count(")"),
        s.count("-"),
        s.count("."),
        s.count(" "),
        s.count("/"),
        luhn(digits) if digits else 0,
        upper,
        lower,
        len(set(s)),
        kind == "iban" and _iban_ok(s),
        "@" in s or "at" in s.lower(),
        month + 2 * year,
        _HINT_OF.get(words[-1].lower(), 0) if words else 0,
        _HINT_OF.get(words[-2].lower(), 0) if len(words) > 1 else 0,
        _HINT_OF.get(words[-3].lower(), 0) if len(words) > 2 else 0,
        s.count(":"),
        "::" in s,
        _ssn_ok(digits),
        " dot " in s.lower(),
        kind == "email" and re.split(r"[^A-Za-z]+", s.rstrip(" ])}>"))[-1].lower() in _TOP,
        bool(_KEY.fullmatch(s)),
        len(s) - len(digits) - upper - lower,
        sum((a < "A") != (b < "A") for a, b in zip(s, s[1:])),
        not set(s) - _HEX,
        0 if not before else 1 if before[-1].isspace() else 2 if before[-1].isalnum() else 3 if before[-1] in "=:\"'(" else 4 if before[-1] in "$€£#%+-./," else 5,
        0 if hi >= len(text) else 1 if text[hi].isspace() else 2 if text[hi].isalnum() else 3 if text[hi] in ",.;:\"')" else 4,
        bool(re.match(r"[\x20().-]{1,2}[0-9]", text[hi : hi + 3])),
        bool(re.search(r"[0-9][\x20().-]{1,2}\Z", before)),
        int(groups[0][0]) if groups else 10,
    ]


def _examples(seed: int, n: int):
    """Made-up texts with the spans in them that are personal data, and values that only look alike."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "re", "in", "le", "de", "mo", "ti")) for _ in range(r.randint(1, 4)))

    def card() -> str:
        body = r.choice("3456") + d(r.choice((12, 13, 14, 14, 14)))
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        return " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if r.random() < 0.3 else body

    def phone() -> str:
        a, b, c = r.choice("23456789") + d(2), r.choice("23456789") + d(2), d(4)
        cc = "+" + str(r.choice((1, 33, 34, 44, 49, 41, 351)))
        return r.choice((f"{cc} ({a}) {b}-{c}", f"{cc} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{cc}-{a}-{b}-{c}", f"0{r.choice('12345679')} {d(2)} {d(2)} {d(2)} {d(2)}", f"{cc} {d(3)} {d(6)}", f"{a}.{b}.{c}", " ".join(a + b + c)))

    def iban() -> str:
        head, body = r.choice(("DE", "FR", "ES", "GB")), d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
        s = f"{head}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    def some(letters: str, k: int) -> str:
        return "".join(r.choice(letters) for _ in range(k))

    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed, hexes = big + big.lower() + "0123456789", "0123456789abcdef"

    def key() -> str:
        return r.choice(("AKIA" + some(big + "234567", 16), r.choice(("ghp_", "gho_", "sk_", "pk_")) + some(mixed, r.randint(20, 40)), f"xox{r.choice('bp')}-{d(12)}-{d(12)}-{some(mixed, 24)}", "sk-" + some(mixed, 40), f"eyJ{some(mixed, r.randint(10, 40))}.eyJ{some(mixed, r.randint(10, 60))}.{some(mixed + '_-', 43)}"))

    def password() -> str:
        w = word()
        while len(w) < 4:
            w += word()
        return r.choice((w.capitalize(), w)) + r.choice((d(r.randint(1, 4)) + r.choice(("", "", "x", "!", "#", "ab")), "-" + word() + d(2), "!" + d(3), "@" + d(4)))

    def secret() -> tuple[str, str]:
        name = r.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "Password", "passphrase"))
        to = name + r.choice(("=", ": ", " = ", ' = "', ":", " is "))
        return r.choice((
            lambda: ("", key()),
            lambda: (to, key()),
            lambda: (to, some(hexes, r.choice((16, 18, 32, 40)))),
            lambda: (to, password()),
            lambda: (r.choice(("Authorization: Bearer ", "bearer ", "Bearer ")), some(mixed + "._-", r.randint(20, 60)) + some(mixed, 1)),
            lambda: (r.choice(("aws_secret_access_key = ", "aws secret ", "secret key ", "key: ")), some(mixed + "/+", 40)),
        ))()

    def email() -> str:
        tail, dot = r.choice(("com", "org", "net", "de", "io")), r.choice((" dot ", " DOT "))
        return r.choice((
            lambda: f"{word()}{r.choice(('.', '_', ''))}{d(2)} [at] {word()} [dot] {tail}",
            lambda: f"{word()}{r.choice(('', '', dot + word(), d(2), '.' + word()))} at {word()}{r.choice(('', '', dot + word()))}{dot}{tail}",
            lambda: f"{word()}{r.choice(('.' + word(), '_' + word(), d(2)))} at {word()}.{tail}",
        ))()

    def ssn() -> tuple[str, str]:
        a, b, c = f"{r.choice((r.randint(1, 665), r.randint(667, 899))):03d}", f"{r.randint(1, 99):02d}", f"{r.randint(1, 9999):04d}"
        hint = r.choice(("ssn ", "ssn is ", "SSN: ", "social security number ", "social security "))
        return r.choice((("", f"{a}-{b}-{c}"), (hint, f"{a}-{b}-{c}"), (hint, f"{a} {b} {c}"), (hint, a + b + c)))

    def ip6() -> str:
        part = lambda k: ":".join(f"{r.randrange(65536):x}" for _ in range(k))
        return r.choice((f"{r.choice(('2001', '2a02', 'fe80', 'fd00'))}:{part(7)}", f"2001:db8::{part(r.randint(1, 3))}", f"fe80::{part(r.randint(2, 4))}", f"{part(r.randint(3, 5))}::{part(r.randint(1, 2))}"))

    def passport() -> tuple[str, str]:
        value = r.choice((d(9), some(big, 1) + d(8), some(big, 2) + d(7), some(big, 1) + d(7), "".join(("C", d(1), some("FGHJKLMNPRTVWXYZ", 1), d(2), some("FGHJKLMNPRTVWXYZ", 2), d(2)))))
        return r.choice(("passport ", "passport no. ", "passport number ", "passport number is ", "Passport No: ", "passport: ")), value

    hints = {"phone": "tel ", "card": "card ", "iban": "iban ", "email": "mail ", "ip6": "host "}
    made = {"phone": phone, "card": card, "iban": iban, "email": email, "ip6": ip6}
    whole = {"secret": secret, "ssn": ssn, "passport": passport}  # with the hint that such a value needs

    def alike() -> str:
        y = r.randint(1900, 2030)
        return r.choice(
            (f"{y}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{y}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{y} {r.randint(0, 23):02d}", f"{y}-{y + 3}", d(r.randint(7, 11)), d(r.randint(12, 19)), f"{d(3)}.{d(3)}.{d(3)}", f"{d(1)}.{d(6)}", f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(2)} {d(2)} {d(2)}", f"{d(5)}-{d(5)}", f"{d(4)} {d(4)}", f"{d(4)}/{d(4)}", f"{d(3)}-{d(2)}-{d(6)}-{d(3)}", f"DE{d(20)}", word().upper() + d(8), f"{d(2)},{d(3)}.{d(2)}", f"{y}{r.randint(1, 12):02d}{r.randint(1, 28):02d}{d(6)}", " ".join(str(i % 10) for i in range(r.randint(0, 2), r.randint(9, 17))),
             f"{d(2)}:{d(2)}:{d(2)}", f"{word()}::{word()}", r.choice(("ab::fe", "bad::add", "a::b", "::", "dead::be")), ":".join(some(hexes, 2) for _ in range(6)), f"{some(big, 2)}{d(r.randint(6, 8))}", f"{some(big, 1)}{d(7)}", d(9), d(8), some(big + "0123456789", 9), f"invoice {d(3)}-{d(2)}-{d(4)}", f"part {d(3)}-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"commit {some(hexes, 40)}", some(hexes, 40), some(mixed, 40),
             f"{r.choice(('password', 'secret', 'token', 'passwd', 'api_key'))}{r.choice((': ', ' = ', '=', ' is '))}{r.choice(('required', 'value', 'missing', 'nothing', word() + word(), word() + '_' + word(), 'getpass.getpass'))}", f"bearer {word()}{word()}{word()}{word()}{word()}", f"{word()} at {word()}.{word()}", f"{word()} at {r.choice(('com', 'site', word()))}.{r.choice(('com', 'org', 'net'))}", f"{word()} at {d(2)}.{d(2)}", f"{word()} at the dot")
        )

    for _ in range(n):
        bits: list[str] = []
        truth: list[tuple[str, int, int]] = []
        close = False  # values that follow each other directly are as true as others
        for _ in range(r.randint(1, 4)):
            if not close:
                bits.append(" ".join(word() for _ in range(r.randint(1, 4))) + " ")
            kind = r.choice(("phone", "phone", "card", "card", "iban", "secret", "secret", "email", "ssn", "ip6", "passport", *("none",) * 10))
            if kind == "none":
                bits.append(("" if close else r.choice(("version ", "no. ", "order ", "id ", "isbn ", "", "", "", "$", "#"))) + alike())
                if r.random() < 0.2:
                    bits.append(" " + d(r.randint(1, 3)))
            else:
                if kind in whole:
                    hint, value = whole[kind]()
                else:
                    hint, value = "" if close else r.choice(("", "", hints[kind])), made[kind]()
                at = sum(map(len, bits)) + len(hint)
                truth.append((kind, at, at + len(value)))
                bits.append(hint + value)
            close = r.random() < 0.25
            bits.append(" " if close else r.choice((" ", " ", ". ", ", ")))
        yield "".join(bits), truth


@lru_cache(maxsize=4)
def model(precision: float = PRECISION, seed: int = 5, n: int = 5000) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees and each kind's threshold, fitted on the driver on a few thousand short examples and sent with the tasks."""
    x, y, kinds = [], [], []
    for text, truth in _examples(seed, n):
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(c in truth)
            kinds.append(c[0])
    x_, y_, k = np.array(x, np.int64), np.array(y, bool), np.array(kinds)
    trees = BoostedTrees().fit(x_, y_)
    held = np.arange(len(y_)) % 5 == 0
    p = trees.probability(x_)
    return trees, {kind: max(0.5, threshold(p[held & (k == kind)], y_[held & (k == kind)], precision)) for kind in KINDS if (k == kind).any()}


Model = tuple[BoostedTrees, dict[str, float]]


def find(texts: list[str], fitted: Model | None = None) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """Of each text: the strict spans by kind, and the spans that the trees add, none touching a strict one."""
    trees, least = fitted or model()
    base = [base_spans(t) for t in texts]
    found, x, owner = [], [], []
    for i, (text, strict) in enumerate(zip(texts, base)):
        taken: list[tuple[int, int]] = []  # the union of strict spans
        for lo, hi in sorted(s for spans in strict.values() for s in spans):
            if taken and lo < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(hi, taken[-1][1]))
            else:
                taken.append((lo, hi))
        for c in candidates(text):
            if _free(taken, c[1], c[2]) is not None:
                found.append(c)
                owner.append(i)
                x.append(features(text, *c))
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if x:
        p = trees.probability(np.array(x, np.int64))
        chosen: dict[int, list[tuple[int, int]]] = {}
        for j in np.lexsort((np.array([c[1] for c in found]), np.array([c[1] - c[2] for c in found]), -np.round(p, 6))).tolist():
            kind, lo, hi = found[j]
            if p[j] < least.get(kind, 1.0):
                continue
            own = chosen.setdefault(owner[j], [])
            at = _free(own, lo, hi)
            if at is not None:
                own.insert(at, (lo, hi))
                added[owner[j]].append((kind, lo, hi))
    return list(zip(base, added))


def _free(spans: list[tuple[int, int]], lo: int, hi: int) -> int | None:
    """Where a span belongs among spans in order and apart from each other; None if it overlaps one."""
    at = bisect.bisect_left(spans, (lo, hi))
    return None if at and spans[at - 1][1] > lo or at < len(spans) and spans[at][0] < hi else at


SPAN = "array<struct<kind:string,start:bigint,end:bigint,strict:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_())]))


def ordered(base: dict, added: list) -> list[tuple[str, int, int, bool]]:
    out = [(k, a, b, True) for k, spans in base.items() for a, b in spans] + [(*s, False) for s in added]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Replace the union of spans by their kinds; spans that overlap become one with the first's kind."""
    out, at = [], 0
    for kind, lo, hi, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if hi <= at:
            continue
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join(out) + text[at:]


def _scan(texts: pa.Array, fitted: Model) -> tuple[list, list]:
    spans: list = [[] for _ in range(len(texts))]
    changed: list = [None] * len(texts)
    for b in tc.blocks(texts):
        read = [b.bytes_of(i).decode("utf-8", "replace") for i in range(len(b))]
        for i, (text, (base, added)) in enumerate(zip(read, find(read, fitted))):
            s = ordered(base, added)
            if s:
                spans[b.lo + i] = s
                changed[b.lo + i] = redact(text, s)
    return spans, changed


def _finder(fitted: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPAN)])

    def run(batches):
        for batch in batches:
            spans, _ = _scan(batch.column("text"), fitted)
            rows = [[{"kind": k, "start": a, "end": b, "strict": s} for k, a, b, s in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPAN)], schema=schema)

    return run


def find_personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, strict), by kind and start; one row for each row.

    Null and empty texts have no spans. Rows are independent; repeated and null doc_ids stay as they are;
    other columns are not read.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(freeing(_finder(model(precision))), f"doc_id bigint, spans {SPAN}")


def redact_documents(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """docs with all its columns, texts with every selected span replaced by its kind in brackets, and
    n_chars, where there is such a column, set to the new length. Null texts stay null, empty ones empty. Rows are
    independent, so equal and null doc_ids are rows like others; other columns pass unchanged. An empty table stays one."""
    ship(docs.sparkSession)
    schema, at, fitted = docs.schema, docs.columns.index("text"), model(precision)

    def run(batches):
        for batch in batches:
            _, changed = _scan(batch.column(at), fitted)
            old = batch.column(at)
            new = pa.array([c if c is not None else old[i].as_py() for i, c in enumerate(changed)], old.type) if any(c is not None for c in changed) else old
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(freeing(run), schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    """op8: counts and digest of the strict spans, and all spans, of every document."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    strict = F.filter("spans", lambda x: x["strict"])
    of = lambda k: F.filter("spans", lambda x: x["strict"] & (x["kind"] == k))
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(line(strict), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))

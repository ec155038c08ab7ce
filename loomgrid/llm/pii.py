"""Private data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, identifier cues (token, key, password, bearer, ...), cues of
numbers (account, routing, passport, ssn, iban), and the starts of numbers and network addresses (two digits,
digit-dot-digit, plus-digit, bracket-digit, hexadecimal groups at colons). At each anchor a deterministic parser
expands to the boundaries of an e-mail or network address, an account or phone number, a secret or a URL with
credentials, and validates it (labels of a domain, octets and groups, Luhn, mod-97 and routing check digits, digit counts). The leftmost
anchor wins, and spans never overlap. Numbers that fail their check are left alone, unless a cue names them.

Defined results: a null, empty or blank text has no spans; offsets count characters of the text as given; a null id is
kept; repeated rows give repeated spans; texts are scanned whole, and addresses, URLs and secrets are read to their ends, however long; an empty table gives an empty table; other columns are
ignored by `find` and returned unchanged by `redact`, whatever their names.
"""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import arrow_map, pick

CUES = ("token", "secret", "password", "passwd", "key", "bearer", "iban")
#: Cues of numbers -> the kind of what follows.
NAMED = {"account": "account", "acct": "account", "routing": "routing", "passport": "passport", "ssn": "ssn", "social security": "ssn"}
#: What may stand before "key" in a word that is written in one, as apikey; other words that end so, as monkey, are no cues.
BEFORE_KEY = ("", "api", "access", "private", "auth", "secret", "encryption", "signing", "account", "master", "session", "client", "ssh")
#: Words of an identifier: parted by case, _, - or digits.
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
IDENTIFIER = re.compile(r"[\w-]*")
LOWER = {c: c + 32 for c in range(65, 91)}
ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
LOCAL, LABEL, DIGITS = set("._%+-"), set(ASCII + "-"), set("0123456789")
HEX = "0123456789abcdef"
#: Longest run of digits, and of an IBAN's characters, that a parser looks at (ISO 7812, ISO 13616); numbers in longer runs are none.
REACH = {"number": 40, "iban": 45}
SECRET = re.compile(r"""(?:["']?\s*[:=]\s*|\s+)["']?([A-Za-z0-9_\-+/=.]{16,})""")
URL = re.compile(r"[^\s\"'<>`{}|\\^]+")
USERINFO = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*)://[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[^\s/\"'<>]+")
URL_SECRET = re.compile(r"[?&](?:token|key|api_key|apikey|access_token|secret|password|sig)=[A-Za-z0-9_\-+/=.%]{8,}", re.I)
IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})", re.A)
PHONE = re.compile(r"\+\d[\d ().\-]{6,24}\d|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}", re.A)
SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})", re.A)
CARD = re.compile(r"\d(?:[ -]?\d){12,18}", re.A)
#: Behind a cue of numbers: what may name it further, and the number.
BEHIND = re.compile(r"s?(?:[ _-]?(?:number|numbers|no\.?|num|nr\.?|id|code))?[\"']?(?: ?[:=#] ?| is | )#?[\"']?([A-Za-z]{0,2}\d[\d -]*\d)", re.I | re.A)
V6 = re.compile(r"[0-9a-f:]+(?:\d+\.\d+\.\d+\.\d+)?", re.I | re.A)
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", re.A)


def anchors() -> dict[str, str]:
    """Pattern -> what it announces."""
    out = {"@": "at", "://": "scheme"}
    out |= {f"{a}{b}": "number" for a in "0123456789" for b in "0123456789"} | {f"{a}.{b}": "ip" for a in "0123456789" for b in "0123456789"}
    out |= {f"{p}{d}": "phone" for p in "+(" for d in "0123456789"}
    out |= {f"{a}:{b}": "ipv6" for a in HEX for b in HEX + ":"}
    return out | dict.fromkeys(CUES, "cue") | dict.fromkeys(NAMED, "named")


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def word(c: str) -> bool:
    return c.isalnum() or c == "_"


def bounded(t: str, a: int, b: int) -> bool:
    """No digit or letter touches the span."""
    return (a == 0 or not word(t[a - 1])) and (b == len(t) or not word(t[b]))


def email(t: str, i: int) -> tuple[int, int, str] | None:
    a = i
    while a > 0 and (t[a - 1].isalnum() or t[a - 1] in LOCAL):
        a -= 1
    while a < i and not t[a].isalnum():
        a += 1
    b, n = i + 1, len(t)
    while b < n and (t[b] in LABEL or t[b] == "."):
        b += 1
    domain = t[i + 1 : b].rstrip(".-")
    labels = domain.split(".")
    while len(labels) > 1 and (not labels[-1].isalpha() or len(labels[-1]) < 2):
        labels.pop()
    domain = ".".join(labels)
    if a == i or ".." in t[a:i] or t[i - 1] == "." or len(labels) < 2 or not all(x and x[0] != "-" and x[-1] != "-" and len(x) < 64 for x in labels):
        return None
    return a, i + 1 + len(domain), "email"


def ends(t: str, m: re.Match | None, separators: str) -> list[int]:
    """Where a number may end: at the match's end, then before each separator, longest first."""
    return [m.end(), *(b for b in range(m.end() - 1, m.start(), -1) if t[b] in separators and t[b - 1] in DIGITS)] if m else []


def ip(t: str, i: int) -> tuple[int, int, str] | None:
    a = i
    while a > 0 and t[a - 1] in DIGITS and i - a < 4:
        a -= 1
    m = IP.match(t, a)
    if not m or not all(int(x) < 256 for x in m.groups()):
        return None
    b = m.end()
    if not bounded(t, a, b) or a > 1 and t[a - 1] == "." and t[a - 2] in DIGITS or t[b : b + 1] == "." and t[b + 1 : b + 2].isdigit():
        return None
    return a, b, "ip"


def ipv6(t: str, i: int) -> tuple[int, int, str] | None:
    """Of the ranges that are routed or local to a site or link; any other compressed form may be code, as a::b."""
    a = i
    while a > 0 and i - a < REACH["number"] and (t[a - 1] in HEX or t[a - 1] in "ABCDEF:"):
        a -= 1
    m = V6.match(t, a, min(len(t), a + REACH["number"] + 6))
    x = m.group() if m else ""
    if len(x) > 45 or x.count(":") < 2:
        return None
    v = x.rstrip(":") if not x.endswith("::") else x
    try:
        n = int(ipaddress.IPv6Address(v))
    except ValueError:
        return None
    b = a + len(v)
    top = n >> 120
    return (a, b, "ip") if bounded(t, a, b) and (top >> 5 == 1 or top >> 1 == 0x7E or n >> 118 == 0x3FA) else None


def routed(digits: str) -> bool:
    """The check digit of a routing number."""
    return len(digits) == 9 and sum(int(d) * w for d, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0


def named(t: str, i: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """The number behind a cue that names it: so many digits as its kind has, no letter or digit next to it."""
    if i and word(t[i - 1]) and t[i - 1] != "_":
        return None
    m = BEHIND.match(t, end)
    if not m:
        return None
    a = m.start(1)
    for b in ends(t, re.compile(r"[A-Za-z]{0,2}\d[\d -]*\d", re.A).match(t, a, min(len(t), a + REACH["number"])), " -"):
        x = re.sub("[ -]", "", t[a:b])
        n = sum(c in DIGITS for c in x)
        fits = {"account": n == len(x) and 6 <= n <= 19, "routing": routed(x) if n == len(x) else False, "passport": 6 <= n <= 9, "ssn": n == len(x) == 9 and x[:3] not in ("000", "666") and x < "9"}[kind]
        if fits and (b == len(t) or not word(t[b])):
            return a, b, kind
    return None


def iban(t: str, i: int) -> tuple[int, int, str] | None:
    if i < 2 or not (t[i - 2 : i].isascii() and t[i - 2 : i].isalpha() and t[i - 2 : i].isupper()):
        return None
    m = IBAN.match(t, i - 2, min(len(t), i + REACH["iban"]))
    for b in range(m.end(), i + 11, -1) if m else ():
        x = t[i - 2 : b].replace(" ", "")
        if 15 <= len(x) <= 34 and bounded(t, i - 2, b) and mod97(x):
            return i - 2, b, "iban"
    return None


def digits(t: str, i: int) -> tuple[int, int, str] | None:
    """An account, social security or phone number that begins at i, the first of its digits."""
    for b in ends(t, CARD.match(t, i), " -"):
        x = re.sub("[ -]", "", t[i:b])
        if 13 <= len(x) <= 19 and bounded(t, i, b) and luhn(x):
            return i, b, "account"
    if (m := SSN.match(t, i)) and bounded(t, i, m.end()) and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
        return i, m.end(), "ssn"
    return phone(t, i)


def phone(t: str, i: int) -> tuple[int, int, str] | None:
    for b in ends(t, PHONE.match(t, i), " ") if i == 0 or not word(t[i - 1]) else ():
        n = sum(c in DIGITS for c in t[i:b])
        if (10 if t[i] != "+" else 8) <= n <= 15 and (b == len(t) or not word(t[b])):
            return i, b, "phone"
    return None


def url(t: str, i: int, plain: int) -> tuple[tuple[int, int, str] | None, int]:
    """A URL with credentials or a secret; where URLs without a secret end, which are read once: it was `plain` before."""
    a = i
    while a > 0 and (t[a - 1] in LABEL or t[a - 1] in "+."):
        a -= 1
    if m := USERINFO.match(t, a):
        return (a, m.end(), "url"), plain
    if i < plain or not (m := URL.match(t, a)):
        return None, plain
    return ((a, m.end(), "url"), plain) if URL_SECRET.search(m.group()) else (None, m.end())


def cue(part: str) -> bool:
    """A word of an identifier says that a secret follows."""
    part = part.lower()
    part = part.removesuffix("s")
    return part.endswith(("token", "secret", "password", "passwd")) or part in ("bearer", "iban") or part.endswith("key") and part[:-3] in BEFORE_KEY


def identifier(t: str, i: int) -> tuple[int, int]:
    """The letters, digits, _ and - around i."""
    a = i
    while a > 0 and (word(t[a - 1]) or t[a - 1] == "-"):
        a -= 1
    return a, IDENTIFIER.match(t, i).end()


def secret(t: str, a: int, end: int) -> tuple[tuple[int, int, str] | None, int]:
    """The value behind the identifier from a to end, if a word of it is a cue: at least 16 characters, letters and digits among them;
    up to where no other cue is worth a look, since a value that has no digit has none in any part."""
    if not any(map(cue, PARTS.findall(t, a, end))) or not (m := SECRET.match(t, end)):
        return None, end
    if got := iban(t, m.start(1) + 2):
        return got, end
    v = m[1].rstrip(".=-") if not m[1].endswith("=") else m[1]
    if len(v) >= 16 and any(c in DIGITS for c in v) and any(c.isalpha() for c in v):
        return (m.start(1), m.start(1) + len(v), "secret"), end
    return None, m.end() if not any(c in DIGITS for c in v) else end


class Finder:
    """The automaton and its parsers; made anew in each Python worker."""

    def __init__(self):
        import ahocorasick

        self.a = ahocorasick.Automaton()
        for k, what in anchors().items():
            self.a.add_word(k, (len(k), what))
        self.a.make_automaton()

    def __call__(self, t: str | None) -> list[tuple[int, int, str]]:
        """Sorted (start, end, kind), none overlapping."""
        if not t:
            return []
        spans, done, tried, judged, plain = [], 0, -1, 0, 0
        folded = t.lower()
        if len(folded) != len(t):  # some letters get longer
            folded = t.translate(LOWER)
        for last, (size, what) in self.a.iter(folded):
            i = last - size + 1
            if last < done:
                continue
            if what == "at":
                got = email(t, i)
            elif what == "scheme":
                got, plain = url(t, i, plain)
            elif what == "cue":
                if i < judged:
                    continue
                a, judged = identifier(t, i)
                got, judged = secret(t, a, judged)
            elif what == "ip":
                got = ip(t, i)
            elif what == "ipv6":
                got = ipv6(t, i)
            elif what == "named":
                got = named(t, i, last + 1, NAMED[folded[i : last + 1]])
            elif what == "phone":
                got, tried = phone(t, i), i + 1
                other = digits(t, i + 1)  # an account number may begin at the sign, and be longer than a phone number
                got = other if other and (got is None or other[1] > got[1]) else got
            else:
                a = i
                while a > 0 and t[a - 1] in DIGITS and i - a < REACH["number"]:
                    a -= 1
                got = iban(t, a) or (digits(t, a) if a != tried else None)
                tried = a
            if got and got[0] >= done:
                spans.append(got)
                done = got[1]
        return spans


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, kind, value: a row a span. A map without a shuffle."""
    made: list[Finder] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Finder())
        rows = [(d, a, b, k, t[a:b]) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for a, b, k in made[0](t)]
        return dict(zip(("doc_id", "start", "end", "kind", "value"), zip(*rows) if rows else ((),) * 5))

    return arrow_map(pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), run, "doc_id long, start long, end long, kind string, value string")


def replaced(text: Column) -> Column:
    """The text with every span replaced by its kind in capitals, as <EMAIL>."""

    made: list[Finder] = []

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Finder())
        return pa.array([mask(t, made[0]) for t in texts.to_pylist()], pa.string())

    return masked(text)


def mask(t: str | None, finder: Finder) -> str | None:
    if not t or not (spans := finder(t)):
        return t
    out, at = [], 0
    for a, b, k in spans:
        out += [t[at:a], f"<{k.upper()}>"]
        at = b
    return "".join(out) + t[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with their private data masked; n_chars, where there is such a column, is the new length. All columns stay, in their order."""
    field = docs.schema[text_col].dataType
    out = docs.withColumn(text_col, replaced(docs[text_col].cast("string")).cast(field))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(F.col(text_col).cast("string")).cast(docs.schema[length_col].dataType))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

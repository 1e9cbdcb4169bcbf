"""Operator 3: private values become format-preserving pseudonyms by a keyed Feistel network.

A value is found by its pattern, validated (check digits, octets, calendar, number plan), read as a number in the set of all
values of its format and permuted within that set: a Feistel network over the next even number of bits, walked until
it falls back into the set.  So pseudonyms are valid values of the same format, different values stay different, and equal
values stay linked across documents without any shared table.  Every text is rewritten in its own row.

A match that fails its check is read anew: as one of its beginnings (the country's length of an IBAN, whole groups of a card or
phone number), as one of the other kinds, and then from the next character on.

Kinds: e-mail addresses, IPv4 and global IPv6 addresses, payment cards (check digit kept valid), phone numbers, social security numbers, IBANs,
calendar dates, access keys, and the values of password and token assignments.

Defined results: a null text stays null and an empty one empty; numbers that fail their check are left alone; repeated rows
and ties change alike; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import datetime
import ipaddress
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from leafgrid.llm.common import worker_cache

ROUNDS = 10
LETTERS, CAPITALS, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

MONTHS = [
    "January February March April May June July August September October November December".split(),
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
]
_NAMES = "|".join(sorted({m for names in MONTHS for m in names}, key=lambda m: (-len(m), m)))
#: Letters and digits of an IBAN by country.
IBAN = {k[:2]: int(k[2:]) for k in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 "
    "NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<key>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))
  | (?P<secret>(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key))["']?[ ]?(?:=[ ]?["']?[A-Za-z0-9]{8,}|:[ ]?["']?(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{8,}))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<hex>(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9]))
  | (?P<ipv6>(?<![\w:.])[23][0-9A-Fa-f]{3}:(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:]))
  | (?P<phone>(?<![\w+(])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<![0-9][ -])0[1-9][0-9]{0,3}(?:[ -][0-9]{2,4}){2,4}(?![ -][0-9]))(?![\w]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<date>(?<![\w/.-])(?:[0-9]{4}(?P<_sep>[-/.])[0-9]{1,2}(?P=_sep)[0-9]{1,2}|[0-9]{1,2}(?P<_sep2>[-/.])[0-9]{1,2}(?P=_sep2)[0-9]{4})(?!(?!T[0-9]{2}:?[0-9]{2})[\w/-]))
  | (?P<named>(?<![\w/.-])(?:[0-9]{1,2}(?:\.|st|nd|rd|th)?\ (?:de\ )?(?:MONTH)\.?,?\ (?:de\ )?[0-9]{4}|(?:MONTH)\.?\ [0-9]{1,2}(?:st|nd|rd|th)?,?\ [0-9]{4})(?![\w/-]))
  | (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
  | (?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
    """.replace("MONTH", _NAMES),
    re.X,
)
KINDS = [k for k in PATTERN.groupindex if k[0] != "_"]
#: Each kind alone, for other readings of a place.
ALONE = {k: re.compile(part, re.X) for k, part in zip(KINDS, re.split(r"\n  \| ", PATTERN.pattern.strip()))}
FIGURES = re.compile(r"[0-9]\.?[0-9]")
SIGNS = re.compile(r"(?i:[dtny])[\"']? ?[=:]")
#: Days of birth and other past days stay before NOW, later ones after it.
FIRST, NOW, LAST = (datetime.date(*d).toordinal() for d in ((1900, 1, 1), (2025, 1, 1), (2100, 1, 1)))


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """The keyed permutation of range(size) for one format."""
    half = max(1, -(-(size - 1).bit_length() // 2)) if size > 1 else 0
    if not half:
        return value
    mask, name = (1 << half) - 1, tweak.encode()
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            data = b"%d|%d|%d|" % (r, size, right) + name
            left, right = right, left ^ (int.from_bytes(blake2b(data, key=key, digest_size=64).digest(), "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _spell(text: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """Permute a string whose i-th character is of the i-th alphabet."""
    value, size = 0, 1
    for c, a in zip(text, alphabets):
        value, size = value * len(a) + a.index(c), size * len(a)
    value, out = permute(value, size, key, tweak), []
    for a in reversed(alphabets):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _by_class(text: str, key: bytes, tweak: str, fixed: int = 0) -> str:
    """Letters stay letters and digits digits; other characters, and the first ``fixed`` ones, stay."""
    place = [i for i, c in enumerate(text) if i >= fixed and c.isascii() and c.isalnum()]
    kinds = [DIGITS if text[i].isdigit() else LETTERS if text[i].islower() else CAPITALS for i in place]
    # parts keep the numbers small; each is permuted under the parts before it
    out, before = list(text), ""
    for lo in range(0, len(place), 40):
        part = place[lo : lo + 40]
        old = "".join(text[i] for i in part)
        for i, c in zip(part, _spell(old, kinds[lo : lo + 40], key, f"{tweak}|{before}")):
            out[i] = c
        before += old
    return "".join(out)


def _put(text: str, digits: str) -> str:
    """Other digits at the places of the text's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The sum whose last figure is 0 for a valid number."""
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))


def _card(text, key):
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19:
        return None
    if luhn(digits) % 10 or digits[0] not in "23456" or len(set(digits)) < 2:
        return None
    body = digits[0] + _spell(digits[1:-1], [DIGITS] * (len(digits) - 2), key, f"card|{digits[0]}")
    return _put(text, body + str(-luhn(body + "0") % 10))


def _iban(text, key):
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))
    if not 15 <= len(plain) <= 34 or number(plain) % 97 != 1:
        return None
    body = _by_class(plain[4:], key, f"iban|{plain[:2]}|{len(plain)}")
    check = 98 - number(f"{plain[:2]}00{body}") % 97
    it = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def _ip(text, key):
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    low, high = 1 << 24, 224 << 24  # addresses of single hosts stay such
    if not low <= value < high:
        return None
    return ".".join(map(str, (permute(value - low, high - low, key, "ip") + low).to_bytes(4, "big")))


def _ipv6(text, key):
    """Addresses of the global unicast range 2000::/3 stay in it; equal ones are linked however they are written."""
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    low = 1 << 125
    new = ipaddress.IPv6Address(permute(value - low, low, key, "ipv6") + low)
    new = new.compressed if "::" in text else ":".join(f"{int(g, 16):x}" for g in new.exploded.split(":"))
    return new.upper() if text.isupper() else new


def _phone(text, key):
    """The national number is permuted, alike with and without the country's code or a leading 0."""
    digits = re.sub(r"\D", "", text)
    if not 9 <= len(digits) <= 15:
        return None
    fixed = 0
    if text[0] == "+":
        fixed = len(re.match(r"\+([0-9]+)", text)[1])
        if fixed > 3:  # country code without a separator
            fixed = 1 if digits[0] in "17" else 2
    elif digits[0] == "0":
        fixed = 1
        if not re.fullmatch("0[1-9][0-9]{0,3}(?:[ -][0-9]{2,4}){2,4}", text) or len(digits) > 12:
            return None
    rest = digits[fixed:]
    plan = len(rest) == 10 and (not fixed or digits[:fixed] == "1")
    if plan and (rest[0] in "01" or rest[3] in "01"):
        return None if not fixed else _put(text, digits[:fixed] + _spell(rest, [DIGITS] * 10, key, "phone|odd"))
    kinds = [DIGITS[2:] if plan and i in (0, 3) else DIGITS for i in range(len(rest))]
    if digits[0] == "0" or not plan:  # a national number does not begin with 0 in either form
        kinds[0] = DIGITS[1:] if rest[0] != "0" else DIGITS
    return _put(text, digits[:fixed] + _spell(rest, kinds, key, f"phone|{len(rest)}|{plan}|{rest[0] == '0'}"))


def _ssn(text, key):
    a, b, c = map(int, text.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if a not in areas or not b or not c:
        return None
    n = permute((areas.index(a) * 99 + b - 1) * 9999 + c - 1, len(areas) * 99 * 9999, key, "ssn")
    n, c = divmod(n, 9999)
    a, b = divmod(n, 99)
    return f"{areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"


def _day(y, m, d, key):
    """The pseudonym of a day of the calendar, or None."""
    try:
        at = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    low, high = (FIRST, NOW) if at < NOW else (NOW, LAST)
    return datetime.date.fromordinal(permute(at - low, high - low, key, "date") + low) if low <= at < high else None


def _date(text, key):
    a, sep, b, _, c = re.split(r"([-/.])", text)
    padded = len(a) > 1 and len(b) > 1 and len(c) > 1
    two = "{:02d}" if padded else "{:d}"
    if len(a) == 4:
        day = _day(int(a), int(b), int(c), key)
        return day and sep.join((f"{day.year:04d}", two.format(day.month), two.format(day.day)))
    if day := _day(int(c), int(b), int(a), key):
        return sep.join((two.format(day.day), two.format(day.month), f"{day.year:04d}"))
    day = _day(int(c), int(a), int(b), key) if sep != "." else None
    return day and sep.join((two.format(day.month), two.format(day.day), f"{day.year:04d}"))


def _named(text, key):
    d, y = re.findall("[0-9]+", text)
    month = re.search(_NAMES, text)[0]
    names = next(x for x in MONTHS if month in x)
    day = _day(int(y), names.index(month) + 1, int(d), key)
    if not day:
        return None
    parts = iter((str(day.day), f"{day.year:04d}"))
    return re.sub("[0-9]+|" + re.escape(month), lambda m: next(parts) if m[0].isdigit() else names[day.month - 1], text)


def _email(text, key):
    local, _, domain = text.lower().rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{_by_class(local, key, 'local')}@{_by_class(host, key, 'host')}.{top}"


def _hex(text, key):
    return "".join(_spell(text[i : i + 32], [HEX] * len(text[i : i + 32]), key, f"hex|{text[:i]}") for i in range(0, len(text), 32))


def _secret(text, key):
    """The value of an assignment; its name, sign and quotes stay."""
    name, value = re.fullmatch("(.*[^A-Za-z0-9])([A-Za-z0-9]+)", text, re.S).groups()
    return name + (_hex(value, key) if set(value) <= set(HEX) else _by_class(value, key, "secret"))


CHANGE = {
    "email": _email,
    "key": lambda t, k: _by_class(t, k, "key", 4),
    "secret": _secret,
    "ipv6": _ipv6,
    "iban": _iban,
    "hex": _hex,
    "phone": _phone,
    "ssn": _ssn,
    "date": _date,
    "named": _named,
    "ip": _ip,
    "card": _card,
}


def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None if it fails its check."""
    kept = worker_cache("private")
    if "of" not in kept:
        kept["of"] = lru_cache(100_000)(lambda kind, text, key: CHANGE[kind](text, key))
    return kept["of"](kind, text, key)


def _shorter(kind: str, text: str):
    """The value of a match, then its shorter beginnings that end where a group of it ends, the longest first."""
    size = IBAN.get(text[:2]) if kind == "iban" else None
    ends = [m.start() for m in re.finditer("[ -]", text)][::-1] if kind in ("iban", "card") else []
    if kind == "phone":
        ends = [m.start() for m in re.finditer("[ .-]", text)][::-1]
    own = [e for e in ends if len(text[:e].replace(" ", "")) == size]
    if size and len(text.replace(" ", "")) != size:
        yield from (text[:e] for e in own)
    yield text
    yield from (text[:e] for e in ends if e not in own and e >= 9)


def _reading(m, text: str, key: bytes):
    """(length, pseudonym) of the first valid reading of what stands at a match, or None."""
    at = m.start()
    for kind in KINDS[KINDS.index(m.lastgroup) :]:
        found = m if kind == m.lastgroup else ALONE[kind].match(text, at)
        for value in _shorter(kind, found[0]) if found else ():
            new = pseudonym(kind, value, key)
            if new is not None:
                return len(value), new
    return None


def may_hold_values(text: str) -> bool:
    """What every kind needs somewhere: two figures in a row or around a dot, an @, an access key, or = or : after the last
    letter of a secret's name."""
    return "@" in text or FIGURES.search(text) is not None or ("=" in text or ":" in text) and SIGNS.search(text) is not None or "AKIA" in text or "ASIA" in text


def rewrite(text: str | None, key: bytes) -> tuple[str | None, int]:
    """A text with its private values replaced, and how many there were."""
    if not text or not may_hold_values(text):
        return text, 0
    out, done, pos, n = [], 0, 0, 0
    while m := PATTERN.search(text, pos):
        found = _reading(m, text, key)
        if found is None:  # another value may begin inside
            pos = m.start() + 1
            continue
        out += [text[done : m.start()], found[1]]
        done = pos = m.start() + found[0]
        n += 1
    return "".join([*out, text[done:]]), n


#: Setting of the session that holds the secret of the permutation.
KEY, NO_SECRET = "spark.leafgrid.pii.key", "leafgrid"


def _key(docs: DataFrame, key: str | None) -> str:
    return key or docs.sparkSession.conf.get(KEY, NO_SECRET)


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_values) for every row of docs; ``key`` is the secret of the permutation, else the session's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _replace(rows, _key(docs, key), True)


def with_pseudonyms(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with rewritten texts, all columns kept."""
    done = _replace(docs, _key(docs, key), False)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def _replace(docs, key, count):
    at, secret = docs.columns.index("text"), key.encode()

    def run(batches):
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(lo, 1000)
                done = [rewrite(t, secret) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in done], pa.string())
                if count:
                    columns.append(pa.array([n for _, n in done], pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *["n_values"] * count])

    kinds = StructType([*docs.schema.fields, *[StructField("n_values", IntegerType())] * count])
    return docs.mapInArrow(run, kinds)

"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

What is found and valid (card and account numbers by their check digits, phone numbers by their length,
addresses of machines and mail, dates of the calendar in several layouts, secrets by their context or
prefix) is replaced by another value of the same format. Each format is a finite set of values with a
number each; a balanced Feistel network with a keyed hash permutes the numbers, and walks on where one
stands for no value of the format. So a format's values are permuted among themselves: equal values give
equal pseudonyms in every document, and no two values of a format give the same one.

The key is the caller's. Who has it can undo the pseudonyms (recovered), nobody else.
"""

from __future__ import annotations

import hashlib
import math
import re
import secrets
from collections.abc import Callable
from datetime import date

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, shared_dir

ROUNDS = 10
LETTERS, CAPITALS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: The session's setting that holds the key.
KEY_CONF = "spark.folio.pseudonym.key"


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    text = b"%d|%d|%d|" % (i, size, half) + tweak
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=32).digest(), "big")


def permuted(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): Feistel over the next square, walked back into range."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, a)
        for i in range(ROUNDS):
            left, right = right, (left + _round(key, tweak, i, right, size)) % a
        value = left * a + right
        if value < size:
            return value


def recovered(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """The inverse of permuted."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, a)
        for i in reversed(range(ROUNDS)):
            left, right = (right - _round(key, tweak, i, left, size)) % a, left
        value = left * a + right
        if value < size:
            return value


def walked(value: int, size: int, fits: Callable[[int], bool], key: bytes, tweak: bytes) -> int:
    """A keyed permutation of the numbers below ``size`` that fit, of which ``value`` is one."""
    while not fits(value := permuted(value, size, key, tweak)):
        pass
    return value


def digits_permuted(digits: str, key: bytes, tweak: bytes, fits: Callable[[str], bool] = lambda d: True) -> str:
    """Numbers of a length permuted among those that fit."""
    n = len(digits)
    return str(walked(int(digits), 10**n, lambda v: fits(str(v).zfill(n)), key, tweak)).zfill(n) if digits else digits


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _relaid(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _card(m: re.Match, key: bytes) -> str:
    """Numbers with a right check digit among themselves, and the others among themselves."""
    digits = re.sub(r"\D", "", m[0])
    if _luhn(digits):
        body = digits_permuted(digits[:-1], key, b"card")
        return _relaid(m[0], body + luhn_digit(body))
    return _relaid(m[0], digits_permuted(digits, key, b"number", lambda d: not _luhn(d)))


def _iban_check(country: str, rest: str) -> str:
    value = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - value % 97:02d}"


def _iban(m: re.Match, key: bytes) -> str:
    """Digits among digits and letters among letters, with new check digits; the country stays."""
    plain = re.sub(r"\s", "", m[0])
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if _iban_check(country, rest) != check:
        return m[0]
    new = _by_kind(rest, key, b"iban" + country.encode())
    out = iter(country + _iban_check(country, new) + new)
    return "".join(c if c.isspace() else next(out) for c in m[0])


def _ip(m: re.Match, key: bytes) -> str:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(x != str(int(x)) for x in m[0].split(".")):
        return m[0]
    value = permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


#: Country codes of one and of two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _phone(m: re.Match, key: bytes) -> str:
    """The country code stays; numbers of one country and length are permuted among themselves."""
    digits = re.sub(r"\D", "", m[0])
    if not m[0].startswith("+"):
        return _relaid(m[0], digits_permuted(digits, key, b"national"))
    if not 8 <= len(digits) <= 15:
        return m[0]
    n = 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3
    return _relaid(m[0], digits[:n] + digits_permuted(digits[n:], key, b"phone" + digits[:n].encode()))


def _plain_phone(m: re.Match, key: bytes) -> str:
    """Ten digits that a North American number may have, among all such."""
    return digits_permuted(m[0], key, b"plain", lambda d: d[0] in "23456789" and d[3] in "23456789")


def _ssn(m: re.Match, key: bytes) -> str:
    return _relaid(m[0], digits_permuted(m[0].replace("-", ""), key, b"ssn"))


FIRST_YEAR, YEARS = 1900, 200


def _valid(year: int, month: int, day: int) -> bool:
    try:
        date(year, month, day)
    except ValueError:
        return False
    return FIRST_YEAR <= year < FIRST_YEAR + YEARS


def _date(m: re.Match, key: bytes) -> str:
    """Three numbers, the year first or last, with one separator: dates of this layout and these widths among themselves.

    With the year last either order of month and day is a date.
    """
    a, sep, b, _, c = re.split(r"([-/.])", m[0])
    first = len(a) == 4
    year, x, y = (a, b, c) if first else (c, a, b)
    if first and sep == "." and (len(x), len(y)) != (2, 2):
        return m[0]  # more likely a version

    def fits(v: int) -> bool:
        v, j = divmod(v, 32)
        v, i = divmod(v, 32)
        if (len(x) == 1 and i > 9) or (len(y) == 1 and j > 9):
            return False
        return _valid(FIRST_YEAR + v, i, j) or (not first and _valid(FIRST_YEAR + v, j, i))

    value = ((int(year) - FIRST_YEAR) * 32 + int(x)) * 32 + int(y)
    if int(x) > 31 or int(y) > 31 or not 0 <= value < YEARS << 10 or not fits(value):
        return m[0]
    v = walked(value, YEARS << 10, fits, key, f"date {sep} {first} {len(x)} {len(y)}".encode())
    new = str(v >> 5 & 31).zfill(len(x)), str(v & 31).zfill(len(y))
    year = str(FIRST_YEAR + (v >> 10))
    return sep.join((year, *new) if first else (*new, year))


#: Names of months.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}


def _named_date(m: re.Match, key: bytes) -> str:
    """A date with a month's name: those of its layout, its day's width and its list of names among themselves."""
    name = next(w for w in re.findall(r"[^\W\d]+", m[0]) if any(w in names for names in MONTHS.values()))
    day, year = re.findall(r"\d+", m[0])
    layout = m[0].replace(name, "M").replace(year, "Y").replace(day, "D")
    # May counts as a whole name: as a short one it could be taken for it
    kind = {"D. M Y": "de", "D de M de Y": "es"}.get(layout) or ("fr" if name[0].islower() else "en" if name in MONTHS["en"] else "short")
    names = MONTHS[kind]

    def fits(v: int) -> bool:
        i, j = v >> 5 & 15, v & 31
        return not (len(day) == 1 and j > 9) and not (kind == "short" and i == 5) and _valid(FIRST_YEAR + (v >> 9), i, j)

    value = ((int(year) - FIRST_YEAR) * 16 + names.index(name) + 1) * 32 + int(day)
    if int(day) > 31 or not 0 <= value < YEARS << 9 or not fits(value):
        return m[0]
    v = walked(value, YEARS << 9, fits, key, f"date {layout} {kind} {len(day)}".encode())
    return layout.replace("Y", str(FIRST_YEAR + (v >> 9))).replace("D", str(v & 31).zfill(len(day))).replace("M", names[(v >> 5 & 15) - 1])


def _symbols(text: str, alphabet: str, key: bytes, tweak: bytes) -> str:
    """Characters of one alphabet permuted together; a leading one of value 0 is like any other."""
    base, value = len(alphabet), 0
    for c in text:
        value = value * base + alphabet.index(c)
    value = permuted(value, base ** len(text), key, tweak)
    out = []
    for _ in text:
        value, r = divmod(value, base)
        out.append(alphabet[r])
    return "".join(reversed(out))


def _by_kind(text: str, key: bytes, tweak: bytes) -> str:
    """Small letters, capitals and digits permuted, each kind as one number under what the kinds before became; the rest stays."""
    out = list(text)
    tweak += b"|" + re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text))).encode()
    for alphabet in (LETTERS, CAPITALS, DIGITS):
        at = [i for i, c in enumerate(text) if c in alphabet]
        new = _symbols("".join(text[i] for i in at), alphabet, key, tweak) if at else ""
        for i, c in zip(at, new):
            out[i] = c
        tweak += b"|" + new.encode()
    return "".join(out)


def _cased(new: str, like: str) -> str:
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, like))


def _mail(m: re.Match, key: bytes) -> str:
    """Local part and domain, each by kind; capitals are as good as small letters and stay where they are. The last label stays."""
    local, domain = m[0].rsplit("@", 1)
    name, last = domain.rsplit(".", 1)
    new = _by_kind(name.lower(), key, b"domain" + last.lower().encode())
    return _cased(_by_kind(local.lower(), key, b"mail" + new.encode()), local) + "@" + _cased(new, name) + "." + last


def _secret(m: re.Match, key: bytes) -> str:
    """Hex digits of one case among themselves, other secrets by kind; what stands before stays."""
    text = m["secret"] or m["bare"]
    start = m.start("secret" if m["secret"] else "bare") - m.start()
    low = re.fullmatch("[0-9a-f]+", text)
    if low or re.fullmatch("[0-9A-F]+", text):
        new = _symbols(text.lower(), DIGITS + "abcdef", key, b"hex" if low else b"HEX")
        new = new if low else new.upper()
    else:
        new = _by_kind(text, key, b"secret")
    return m[0][:start] + new + m[0][start + len(text) :]


_NAMES = {k: "(?:" + "|".join(names) + ")" for k, names in MONTHS.items()}
_BIG = "(?:" + "|".join(MONTHS["en"] + MONTHS["short"]) + ")"
#: Patterns in order of precedence.
KINDS = (
    ("mail", r"[A-Za-z0-9._%+-]{0,63}[A-Za-z0-9_%+-]@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,30}\.[A-Za-z]{2,63}", _mail),
    ("secret", r"(?i:token|secret|password|api[_-]?key)\s*[=:]\s*[\"']?(?P<secret>[0-9A-Za-z_+/-]{16,128})(?![0-9A-Za-z_+/-])|\b(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)(?P<bare>[0-9A-Za-z]{16,64})\b", _secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("date", r"(?<![\d./-])(?:(?:19|20)\d\d(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)(?:19|20)\d\d)(?![\d/-]|\.\d)", _date),
    ("named", rf"(?<!\w){_BIG} \d{{1,2}}, (?:19|20)\d\d(?!\d)|(?<![\d.])\d{{1,2}} (?:{_BIG}|{_NAMES['fr']}|de {_NAMES['es']} de) (?:19|20)\d\d(?!\d)|(?<![\d.])\d{{1,2}}\. {_NAMES['de']} (?:19|20)\d\d(?!\d)", _named_date),
    ("phone", r"\+\d{8,15}(?!\d)|\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]\d{2,8}){1,5}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}(?P<s3>[ .-])\d{3}(?P=s3)\d{4}(?![\d-]|\.\d)", _phone),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    ("card", r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])", _card),
    ("plain", r"(?<![\w.,/-])[2-9]\d\d[2-9]\d{6}(?![\w/-]|[.,]\d)", _plain_phone),
)
_ALL = re.compile("|".join(f"(?P<k_{name}>{pattern})" for name, pattern, _ in KINDS), re.ASCII)
_MAKE = {name: make for name, _, make in KINDS}
_SINGLE = {name: re.compile(pattern, re.ASCII) for name, pattern, _ in KINDS}
#: A text without any of these has nothing to replace.
_SIGNS = re.compile("[0-9@]|(?i:token|secret|password|api.?key)|AKIA|ASIA|gh[pousr]_|sk-|xox", re.ASCII)


def pseudonymised(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """A text with pseudonyms, and how many of each kind."""
    counts: dict[str, int] = {}
    if not _SIGNS.search(text):
        return text, counts

    def replace(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup.startswith("k_") else next(g for g in m.groupdict() if g.startswith("k_") and m[g] is not None)
        kind = kind[2:]
        new = _MAKE[kind](_SINGLE[kind].fullmatch(m[0]) or _SINGLE[kind].search(m.string, m.start(), m.end()) or m, key)
        if new != m[0]:
            counts[kind] = counts.get(kind, 0) + 1
        return new

    return _ALL.sub(replace, text), counts


def _run(key: bytes):
    def go(batches):
        for batch in batches:
            texts, found, n = [], [], []
            for raw, null in zip(bytes_of(batch.column("text")), batch.column("text").is_null().to_pylist()):
                new, counts = pseudonymised(raw.decode(), key)
                texts.append(None if null else new)
                found.append(sorted(counts.items()))
                n.append(sum(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(found, pa.map_(pa.string(), pa.int64()))],
                names=["doc_id", "text", "n_replaced", "kinds"],
            )

    return go


def with_pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with pseudonyms, n_replaced, kinds.

    Found are: mail addresses; hex and other secrets behind a word like token, or with a known prefix;
    account numbers (IBAN) and cards with or without a right check digit, of 13 to 19 digits; dates from
    1900 to 2099 as three numbers (year first or last, ``-``, ``/`` or ``.``) or with an English, German,
    French or Spanish month's name in the usual order; telephone numbers with ``+`` and 8 to 15 digits,
    in groups of 3, 3 and 4, or of ten digits that a North American number may have; ``123-45-6789``;
    and IPv4 addresses. Other layouts stay as they are. The rest of a text is never touched. An empty
    key is an error.

    Null stays null, and a text without personal data is unchanged. Ids, null or repeated, play no
    part. An empty table gives no rows. Other columns play no part.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    key = hashlib.blake2b(key, digest_size=32).digest()  # of any length
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_run(key), "doc_id long, text string, n_replaced long, kinds map<string,long>")


def key_of(spark: SparkSession) -> bytes:
    """The key that the setting names; without one, a random key that is kept in the shared folder from its first use on.

    So jobs that share the folder link values over several runs, and so do reruns. Who may read that folder can
    undo the pseudonyms; set the key where that is not wanted.
    """
    held = spark.conf.get(KEY_CONF, None)
    if held:
        return held.encode()
    path = f"{shared_dir(spark)}/folio-pseudonym.key"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        try:
            out = files.create(at, False)  # fails if another job was first
        except Py4JJavaError:
            pass
        else:
            out.writeBytes(secrets.token_hex(32))
            out.close()
    kept = spark.read.text(path).first()
    if kept is None or len(kept[0]) != 64:
        raise RuntimeError(f"{path} is no key; another job may be writing it")
    return bytes.fromhex(kept[0])


def op4_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return with_pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet"), key_of(spark)).drop("kinds")

"""PII: format-preserving Feistel pseudonyms, in built-in functions only.

One pattern finds candidates; each is validated (Luhn, IBAN check digits, real
calendar dates, issued SSN ranges, octets, groups of IPv6 addresses) and replaced by a keyed permutation
of its own format, all formats by the same one Feistel expression.  A value is read as a pair (a, b) of Z_m x Z_n and goes
through ``ROUNDS`` Feistel rounds that add a keyed hash of one half to the
other, so the map is a bijection of the format: equal values get equal
pseudonyms in every document, different values different ones.  Check digits are
computed again, punctuation stays, dates stay in their century.  E-mail
addresses and secrets have no numeric format; they get keyed hashes of the same
shape, 64 bits and 48 bits of them, so two addresses are as good as never given
one.  A secret is what stands behind a word such as ``token`` and ``=`` or ``:``,
to its end: eight characters or more with a digit or a sign among them, or of
any kind after ``=``, a quotation mark, or a word for password; a key with a
prefix of its issuer (``ISSUED``), 16 characters or more with a digit; a JSON
web token; and a private key between its BEGIN and END lines, which stay.  Ten
plain digits are a phone number behind a word for one only, four numbers behind
the word version are no address, and IPv6 addresses keep their first group and
are written in full.  Candidates that fail validation are left as they are.

Nulls and edge cases: a null text stays null with nothing found; empty texts and
texts without candidates pass through, and texts of any length are read whole;
repeated rows and equal values (ties) are treated alike; where a value fits two
formats the first of ``PATTERNS`` takes it; an empty table gives an empty
result; a column named like ``into`` is replaced and all others are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
KEY = "voxspark-pseudonyms"  # a deployment passes its own

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
HEX = r"[0-9A-Fa-f]{1,4}"
PASSWORD = r"(?:[Pp]assword|[Pp]asswd|PASSWORD|PASSWD|(?:[Pp]wd|PWD)(?![\"']?\s{0,3}[=:]\s{0,3}[\"']?[/~.$%\\]))"
NAMED = rf"(?:{PASSWORD}|[Ss]ecret|[Tt]oken|[Aa]pi[_-]?[Kk]ey|SECRET|TOKEN|API_KEY)[\"']?"
VALUE = r"""[^\s"'<>(),;`]"""
ISSUED = r"(?:gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-|AIza|[Bb]earer\s{1,3})"
PHONE = r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}"
CALLED = r"(?:[Pp]hone|PHONE|[Tt]el|TEL|[Mm]obile|[Ff]ax|FAX|[Cc]all|[Cc]ell)(?: number| no)?[.:]?\s{0,2}"
PATTERNS = {
    "private_key": r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+){0,50}+-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "secret": rf"(?<![A-Za-z0-9])(?:{NAMED}\s{{0,3}}[=:]\s{{0,3}}[\"']?(?=[A-Za-z/+_.:-]*+(?![A-Za-z/+_.:-]){VALUE})|{NAMED}\s{{0,3}}(?:=\s{{0,3}}[\"']?|:\s{{0,3}}[\"'])|{PASSWORD}\s{{0,3}}:\s{{0,3}})(?![\p{{L}}\p{{N}}._%+-]{{1,64}}@[\p{{L}}\p{{N}}-]{{1,63}}\.\p{{L}}){VALUE}{{7,}}(?<![.!?:])",
    "token": rf"(?<![A-Za-z0-9])(?:{ISSUED}(?=[A-Za-z._~+/=-]*+\d)[A-Za-z0-9._~+/=-]{{16,}}(?<![.~+/-])|eyJ[A-Za-z0-9_-]{{8,}}+\.eyJ[A-Za-z0-9_-]{{4,}}+\.[A-Za-z0-9_-]{{8,}})",
    "access_key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.A-Za-z])(?<![Vv]ersion[ :=]|[Vv]ersion: |[Rr]elease ){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d|[A-Za-z])",
    "ipv6": rf"(?<![\w:.])(?:[23][0-9A-Fa-f]{{3}}|[fF][cCdDeE][0-9A-Fa-f]{{2}})(?:(?::{HEX}){{7}}|(?::{HEX}){{0,5}}::{HEX}(?::{HEX}){{0,5}})(?![\w:]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)",
    "phone": rf"(?<![\w+(])(?:{PHONE}|\d{{10}}(?<={CALLED}\d{{10}}))(?![\w-]|\.\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\w-])",
}
NUMBERS = ("ip", "ipv6", "ssn", "date", "phone", "card")  # the last ones; they begin with a digit, f, + or (
# no candidate but a private key begins inside a word: said once, before any of them is tried
ANY = rf"(?:(?<![A-Za-z0-9])(?=[\p{{L}}\p{{N}}_%+(-])|(?=-----BEGIN ))(?:{'|'.join(v for k, v in PATTERNS.items() if k not in NUMBERS)}|(?=[\dfF+(])(?:{'|'.join(PATTERNS[k] for k in NUMBERS)}))"
WHOLE = PATTERNS | {"phone": rf"{PHONE}|\d{{10}}"}  # of a candidate, without what stood before it
DIGITS = ("card", "iban", "phone")
SOME = rf"[0-9@]|(?<![A-Za-z0-9])(?=[AaePpSsTt])(?:A[KS]IA|eyJ|{NAMED}\s{{0,3}}[=:])|-----BEGIN "  # in every text with a candidate


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of Z_m x Z_n: struct<a, b>, all of them bigint."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, s["b"]).otherwise(s["a"])
        add = F.conv(F.substring(_digest(key, tweak, m, n, i, other), 1, 15), 16, 10).cast("long")
        return F.struct(F.when(even, F.pmod(s["a"] + add, m)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(F.pmod(s["b"] + add, n)).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _pair(s: Column, then: Callable[[Column], Column]) -> Column:
    """Use a struct several times while computing it once."""
    return F.transform(F.array(s), then)[0]


def _power(width: Column) -> Column:
    return F.rpad(F.lit("1"), (width + 1).cast("int"), "0").cast("long")


def digit_halves(digits: Column, tweak: Column) -> Column:
    """A digit string (1 to 34) as numbers for ``permuted``."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    a = F.when(left > 0, F.substring(digits, F.lit(1), left).cast("long")).otherwise(F.lit(0).cast("long"))
    return _numbers(a, F.substring(digits, left + 1, right), _power(left), _power(right), tweak)


def join_digits(s: Column, size: Column) -> Column:
    """The digit string of ``size`` digits that two numbers stand for."""
    left = F.floor(size / 2).cast("int")
    return F.concat(F.when(left > 0, F.lpad(s["a"].cast("string"), left, "0")).otherwise(""), F.lpad(s["b"].cast("string"), size - left, "0"))


def _numbers(a: Column, b: Column, m: Column, n: Column, tweak: Column) -> Column:
    return F.struct(*[c.cast("long").alias(name) for name, c in (("a", a), ("b", b), ("m", m), ("n", n))], tweak.alias("tweak"))


def permuted(s: Column, key: str) -> Column:
    """The permutation of numbers given with their sizes and tweak."""
    return feistel(s["a"], s["b"], s["m"], s["n"], key, s["tweak"])


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refill(shape: Column, digits: Column) -> Column:
    """Put digits, in order, where a string has digits."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike(r"\d")
        return F.struct((s["at"] + digit.cast("int")).alias("at"), F.concat(s["out"], F.when(digit, F.substring(digits, s["at"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit stands at the check place."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def mod97(text: Column) -> Column:
    """Remainder of an IBAN moved for checking: letters count as 10 to 35."""

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _case(pairs: dict[str, Column], kind: Column) -> Column:
    """The value of a kind; null for kinds without one."""
    out = F
    for name, value in pairs.items():
        out = out.when(kind == name, value)
    return out


def kind_of(m: Column) -> Column:
    out = F
    for kind, pattern in WHOLE.items():
        out = out.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind))
    return out


def _country(m: Column) -> Column:
    return F.regexp_extract(m, r"^\+(\d{1,3})(?=[ .(-])", 1)


def _plain(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _american(m: Column) -> Column:
    """A date with slashes has the month first unless only day first is a date; dots: day first."""
    return F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))


def _day(m: Column) -> Column:
    swapped = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))
    month_first = F.when(F.contains(m, F.lit("/")), F.try_to_date(_american(m)))
    return F.when(m.rlike(r"^\d{4}-"), F.try_to_date(m)).otherwise(F.coalesce(month_first, F.try_to_date(swapped)))


def _groups(m: Column) -> Column:
    """The eight groups of an IPv6 address as 32 hex digits; null where there are too many."""

    def hex_digits(part: Column) -> Column:
        return F.array_join(F.transform(F.split(part, ":"), lambda g: F.lpad(F.lower(g), 4, "0")), "")

    sides = F.split(m, "::")
    short = F.size(sides) == 2
    whole = F.concat(hex_digits(sides[0]), F.when(short, hex_digits(F.get(sides, F.lit(1)))).otherwise(""))
    return F.when(F.length(whole) == F.when(short, F.least(F.length(whole), F.lit(28))).otherwise(32), F.concat(hex_digits(sides[0]), F.repeat(F.lit("0"), 32 - F.length(whole)), F.when(short, hex_digits(F.get(sides, F.lit(1)))).otherwise("")))


def _body(kind: Column, m: Column) -> Column:
    """What of a candidate is permuted, in one spelling."""
    digits = only_digits(m)
    return _case(
        {
            "card": F.substring(digits, F.lit(2), F.length(digits) - 2),
            "iban": only_digits(F.substring(_plain(m), 5, 40)),
            "phone": F.substring(digits, F.length(_country(m)) + 1, F.lit(20)),
            "date": F.date_format(_day(m), "yyyy-MM-dd"),
            "ipv6": _groups(m),
        },
        kind,
    )


def _valid(kind: Column, m: Column, body: Column) -> Column:
    digits, plain = only_digits(m), _plain(m)
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rules = {
        "card": (luhn_sum(digits) % 10 == 0) & digits.rlike("[^0]"),
        "iban": (mod97(moved) == 1) & F.length(plain).between(15, 34) & (body != ""),
        "ssn": area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0),
        "date": body >= "1000",
        "phone": F.length(digits).between(7, 15),
        "ipv6": body.isNotNull() & (m.rlike("[A-Fa-f]") | (F.size(F.split(m, ":+")) > 2)),
    }
    return F.coalesce(F.when(kind.isin(*rules), _case(rules, kind)).otherwise(kind.isNotNull()), F.lit(False))


def _century(day: Column) -> Column:
    return F.floor(F.year(day) / 100).cast("int")


def _january(century: Column) -> Column:
    return F.make_date(century * 100, F.lit(1), F.lit(1))


def _halves(kind: Column, m: Column, body: Column) -> Column:
    """The numbers of a valid candidate; null for kinds that are hashed."""
    octet, ssn = F.split(m, r"\."), F.split(m, "-")
    area = ssn[0].cast("long")
    century = _century(body.cast("date"))
    offset = F.datediff(body.cast("date"), _january(century))
    m1, m2 = F.when(century % 4 == 0, 75).otherwise(92), F.when(century % 4 == 0, 487).otherwise(397)  # 36525 = 75 * 487 days, else 36524 = 92 * 397
    numbers = {
        "ip": _numbers(octet[0].cast("long") * 256 + octet[1].cast("long"), octet[2].cast("long") * 256 + octet[3].cast("long"), F.lit(65536), F.lit(65536), F.lit("ip")),
        "ssn": _numbers((area - 1 - (area > 666).cast("int")) * 99 + ssn[1].cast("long") - 1, ssn[2].cast("long") - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn")),
        "date": _numbers(F.floor(offset / m2), offset % m2, m1, m2, F.concat(F.lit("date"), century)),
        "ipv6": _numbers(*[F.conv(F.substring(body, at, 14), 16, 10) for at in (5, 19)], F.lit(1 << 56), F.lit(1 << 56), F.concat(F.lit("ipv6"), F.substring(body, 1, 4))),
    }
    return F.when(kind.isin(*DIGITS), digit_halves(body, kind)).otherwise(_case(numbers, kind))


def _digits_again(kind: Column, m: Column, body: Column, new: Column) -> Column:
    """A card, IBAN or phone number with new digits and its check digits computed again."""
    plain = _plain(m)
    inner = F.concat(refill(F.substring(plain, 5, 40), new), F.substring(plain, 1, 2), F.lit("00"))
    digits = {
        "card": _pair(F.concat(F.substring(only_digits(m), 1, 1), new), lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))),
        "iban": F.concat(F.lpad((98 - mod97(inner)).cast("string"), 2, "0"), new),
        "phone": F.concat(_country(m), new),
    }
    return refill(m, _case(digits, kind))


def _written(kind: Column, m: Column, body: Column, s: Column) -> Column:
    """The permuted numbers in the candidate's own format."""
    place = F.floor(s["a"] / 99) + 1
    century = _century(body.cast("date"))
    new = F.date_add(_january(century), (s["a"] * F.when(century % 4 == 0, 487).otherwise(397) + s["b"]).cast("int"))
    slash = F.contains(m, F.lit("/"))
    groups = F.concat(F.substring(body, 1, 4), *[F.lpad(F.lower(F.hex(s[h])), 14, "0") for h in ("a", "b")])
    formats = {
        "ip": F.concat_ws(".", *[F.floor(s[h] / 256) if hi else s[h] % 256 for h in ("a", "b") for hi in (True, False)]),
        "ssn": F.concat_ws("-", F.lpad((place + (place > 665).cast("int")).cast("string"), 3, "0"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0")),
        "date": F.when(m.rlike(r"^\d{4}-"), F.date_format(new, "yyyy-MM-dd")).when(slash & F.try_to_date(_american(m)).isNotNull(), F.date_format(new, "MM/dd/yyyy")).when(slash, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy")),
        "ipv6": _pair(groups, lambda g: F.concat_ws(":", *[F.substring(g, at, 4) for at in range(1, 33, 4)])),
    }
    return F.when(kind.isin(*DIGITS), _pair(join_digits(s, F.length(body)), lambda d: _digits_again(kind, m, body, d))).otherwise(_case(formats, kind))


def _hashed(kind: Column, m: Column, key: str) -> Column:
    """Addresses and secrets: keyed hashes, behind the word or prefix that marks them."""

    def mask(head: str) -> Column:
        start = F.regexp_extract(m, head, 1)
        value = F.substring(m, F.length(start) + 1, F.length(m))
        return F.concat(start, F.rpad(_digest(key, F.lit("secret"), value), F.length(value), "0123456789abcdef"))

    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    name = F.substring(_digest(key, F.lit("email"), F.lower(m)), F.lit(1), F.greatest(F.lit(16), F.least(F.length(local), F.lit(60))))
    forms = {
        "email": F.concat(F.lit("u"), name, F.lit("@d"), F.substring(_digest(key, F.lit("domain"), F.lower(domain)), 1, 12), F.lit(".example")),
        "secret": mask(r"^([A-Za-z_-]+[\"']?\s*[=:]\s*[\"']?)"),
        "token": mask(rf"^({ISSUED}|eyJ)"),
        "access_key": F.concat(F.substring(m, 1, 4), F.upper(F.substring(_digest(key, F.lit("access_key"), m), 1, 16))),
        "private_key": F.concat_ws("\n", F.regexp_extract(m, "^(-----.*?-----)", 1), _digest(key, F.lit("private_key"), m), F.regexp_extract(m, "(-----END .*-----)$", 1)),
    }
    return _case(forms, kind)


def pseudonym(match: Column, key: str) -> Column:
    """struct<kind, text> of one candidate; kind is null where it is not valid."""

    def new(c: Column) -> Column:
        kind, m, body = c["kind"], c["text"], c["body"]
        numbers = _pair(_halves(kind, m, body), lambda s: F.when(s.isNotNull(), permuted(s, key)))
        text = _pair(numbers, lambda s: F.when(s.isNotNull(), _written(kind, m, body, s)).otherwise(_hashed(kind, m, key)))
        same = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
        return F.when(_valid(kind, m, body), F.struct(kind.alias("kind"), text.alias("text"))).otherwise(same)

    named = _pair(kind_of(match), lambda kind: F.struct(kind.alias("kind"), match.alias("text"), _body(kind, match).alias("body")))
    return _pair(named, new)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY, into: str = "pii_kinds") -> DataFrame:
    """Replace ``text`` and add (or replace) ``into``, the kinds found in order."""
    body = F.col(text)
    found = F.when(body.rlike(SOME), F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there is
    marked = docs.withColumn(free + "found", F.coalesce(found, F.array().cast("array<string>")))
    marked = marked.withColumn(free + "new", F.transform(free + "found", lambda m: pseudonym(m, key)))
    gaps = F.split(body, ANY)
    parts = F.when(F.size(free + "found") > 0, F.transform(F.array(gaps), lambda g: F.concat(g[0], F.array_join(F.transform(free + "new", lambda r, i: F.concat(r["text"], F.get(g, i + 1))), "")))[0])
    kinds = F.filter(F.transform(free + "new", lambda r: r["kind"]), lambda k: k.isNotNull())
    return marked.withColumn(text, F.coalesce(parts, body)).withColumn(into, kinds).drop(free + "found", free + "new")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their pseudonyms in place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs)
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",").alias("kinds"))

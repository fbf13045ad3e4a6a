"""Format-preserving pseudonyms of personal data (operator 3). DataFrame
functions only.

Found and validated: e-mail addresses, IBANs (length of the country, mod 97),
payment cards (issuer, Luhn), dates (``2024-03-01``, also before a time, and
``01.03.2024`` or ``01/03/2024`` with the day first; calendar, 1901 to 2096;
dates with the month first, single digits or two-digit years are not sought),
US social security numbers, IPv4 addresses, North American and ``+``
international telephone numbers. What fails its validation stays as it is.

A card or IBAN is written in one block or in its usual groups with one separator
throughout (cards 4-4-4-4, 4-4-4-4 and one to three, 4-6-5, 4-6-4; IBANs by
fours), so other numbers are never put together to one. Every place where one
could begin is tried, also inside what failed, and the longest valid value
counts, so numbers and words beside a value do not hide it. By chance one in ten
numbers of a card's form and issuer validates, and one in 97 of an IBAN's.

A value is read as a vector of numbers with one radix each (digits, letters of
the local part of an address, octets, parts of an SSN, a day number as
147 x 487). A keyed Feistel network of ``ROUNDS`` rounds adds, in turn, to one
half of the vector a SHA-256 value of the other half, modulo the radix. This is
a permutation of all values of a format, so equal values get equal pseudonyms in
every document, different values different ones. Separators, letter case, the
domain of an address, the first digit of a card and of an international number
stay; check digits are computed anew. So the text keeps its length. A value can
be its own pseudonym with the chance 1 / (number of values of its format).

Defined cases: a null text stays null with no replacements; empty texts stay;
texts of any length are treated whole; repeated rows, null ids and further
columns are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: kind -> pattern, in order of precedence at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])*\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    "iso_date": r"(?<![0-9A-Za-z.-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?:(?=T[0-9]{2}:)|(?![0-9A-Za-z-]))",
    "day_first": r"(?<![0-9A-Za-z./-])[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2}(?![0-9A-Za-z/-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ipv4": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "nanp": r"(?<![0-9A-Za-z+.-])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?\(?[0-9]\)?){7,14}(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())

#: Length of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|CR|HR|LI|LV",
    22: "BG|BH|DE|GB|GE|IE|ME|RS", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}


def _iban_form(country: str, n: int) -> str:
    """An IBAN of ``n`` characters, in one block or by fours."""
    k, rest = divmod(n - 4, 4)
    return f"(?:{country})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{k}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "") + ")"


#: First digits that card issuers use (ISO/IEC 7812).
ISSUER = "(?=2[2-7]|3|4|5|6)"
#: The forms of a card, the longest at one place first.
CARDS = [*(f"{ISSUER}[0-9]{{4}}(?:{sep}[0-9]{{4}}){{3}}{sep}[0-9]{{1,3}}" for sep in " -"),
         *(f"{ISSUER}[0-9]{{4}}(?:{sep}[0-9]{{4}}){{3}}" for sep in " -"),
         *(f"{ISSUER}[0-9]{{4}}{sep}[0-9]{{6}}{sep}[0-9]{{4,5}}" for sep in " -"), f"{ISSUER}[0-9]{{13,19}}"]
IBANS = [_iban_form(c, n) for n, c in IBAN_LENGTHS.items()]
#: What stands before and after a card or IBAN.
CARD_EDGES = (r"(?<![0-9A-Za-z.+])(?<!(?<![0-9])-)", r"(?![0-9A-Za-z]|\.[0-9])")
IBAN_EDGES = ("(?<![A-Za-z0-9])", "(?![A-Za-z0-9])")
#: Where one could begin, and how far a value and its edge reach at most.
BEGIN = "|".join(f"{before}(?=(?:{'|'.join(forms)}){after})" for forms, (before, after) in ((IBANS, IBAN_EDGES), (CARDS, CARD_EDGES)))
REACH = 48
#: Places that are joined to stretches of text at once.
PLACES = 256


def _number(*parts) -> Column:
    """A number from 0 to 2^52 - 1 that depends on all parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("bigint")


def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """Permute a vector of numbers below ``radices`` (both array<bigint>)."""
    half = F.ceil(F.size(values) / 2).cast("int")

    def parts(a):
        return F.slice(a, F.lit(1), half), F.slice(a, half + 1, F.size(a) - half)

    def shifted(own, limit, other, step):
        return F.zip_with(
            F.transform(own, lambda x, i: x + _number(
                F.lit(key), F.lit(kind), step.cast("string"), F.array_join(other.cast("array<string>"), ","), i.cast("string"))),
            limit, lambda x, m: F.pmod(x, m))

    (left, right), (left_limit, right_limit) = parts(values), parts(radices)
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")),
        lambda s, step: F.when(step % 2 == 1, F.struct(shifted(s["l"], left_limit, s["r"], step).alias("l"), s["r"].alias("r")))
        .otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], right_limit, s["l"], step).alias("r"))))
    return F.concat(done["l"], done["r"])


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _rewrite(chars: Column, base, radix, key: str, kind: str) -> Column:
    """Permute the characters that have a radix above 1. ``base(c, i)`` is the
    code of a class's first character, ``radix(c, i)`` its size (1: stays)."""
    marked = F.transform(chars, lambda c, i: F.struct(
        base(c, i).cast("bigint").alias("base"), radix(c, i).cast("bigint").alias("radix"),
        F.ascii(c).cast("bigint").alias("code")))
    free = F.filter(marked, lambda x: x["radix"] > 1)
    new = feistel(F.transform(free, lambda x: x["code"] - x["base"]), F.transform(free, lambda x: x["radix"]), key, kind)
    # one struct beside the characters, so that the permutation is computed once
    return F.aggregate(
        F.array(F.struct(marked.alias("marked"), new.alias("new"))), F.lit(""),
        lambda _, both: F.aggregate(
            both["marked"], F.struct(F.lit("").alias("s"), F.lit(0).alias("k")),
            lambda acc, x: F.when(x["radix"] > 1, F.struct(
                F.concat(acc["s"], F.char(x["base"] + F.get(both["new"], acc["k"]))).alias("s"), (acc["k"] + 1).alias("k")))
            .otherwise(F.struct(F.concat(acc["s"], F.char(x["code"])).alias("s"), acc["k"].alias("k"))))["s"])


def _class_base(c: Column, i=None) -> Column:
    return F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(0)


def _class_size(c: Column, i=None) -> Column:
    return F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1)


def _digit_size(c: Column, i=None) -> Column:
    return F.when(c.between("0", "9"), 10).otherwise(1)


def _int(x) -> Column:
    return x.cast("bigint")


def _email(s: Column, key: str) -> Column:
    at = F.instr(s, "@")
    local = F.substring(s, F.lit(1), at - 1)
    return F.concat(_rewrite(_chars(local), _class_base, _class_size, key, "email"), F.substring(s, at, F.length(s)))


def _mod97(s: Column) -> Column:
    """A string of digits and capital letters (10 to 35) modulo 97."""
    return F.aggregate(_chars(s), F.lit(0).cast("bigint"), lambda acc, c: F.when(
        c.between("0", "9"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(
        F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))).cast("bigint"))


def _iban_valid(s: Column) -> Column:
    plain = F.replace(s, F.lit(" "), F.lit(""))
    return _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1


def _iban(s: Column, key: str) -> Column:
    body = _rewrite(_chars(F.substring(s, F.lit(5), F.length(s))), _class_base, _class_size, key, "iban")
    country = F.substring(s, 1, 2)

    def whole(b):
        check = F.lpad((98 - _mod97(F.concat(F.replace(b, F.lit(" "), F.lit("")), country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, b)

    return F.when(_iban_valid(s), F.element_at(F.transform(F.array(body), whole), 1)).otherwise(s)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    return F.aggregate(
        F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, _int(c)).otherwise(
            F.when(_int(c) > 4, _int(c) * 2 - 9).otherwise(_int(c) * 2))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)


def _card_valid(s: Column) -> Column:
    return _luhn(F.regexp_replace(s, "[ -]", "")) % 10 == 0


def _card(s: Column, key: str) -> Column:
    payload = F.substring(s, F.lit(2), F.length(s) - 2)
    new = F.concat(F.substring(s, 1, 1), _rewrite(_chars(payload), _class_base, _digit_size, key, "card"))

    def whole(b):
        check = F.pmod(-_luhn(F.concat(F.regexp_replace(b, "[ -]", ""), F.lit("0"))), F.lit(10))
        return F.concat(b, check.cast("string"))

    return F.when(_card_valid(s), F.element_at(F.transform(F.array(new), whole), 1)).otherwise(s)


#: First day, and the radices whose product is the number of days up to 2096-12-31.
FIRST_DAY, DAY_RADICES = "1901-01-01", (147, 487)


def _date(s: Column, iso: Column, shape, key: str) -> Column:
    day = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    n, m = DAY_RADICES
    new = feistel(F.array(F.floor(day / m).cast("bigint"), F.pmod(day, F.lit(m)).cast("bigint")),
                  F.array(F.lit(n).cast("bigint"), F.lit(m).cast("bigint")), key, "date")
    moved = F.element_at(F.transform(F.array(new), lambda v: F.date_add(
        F.lit(FIRST_DAY).cast("date"), (F.element_at(v, 1) * m + F.element_at(v, 2)).cast("int"))), 1)
    return F.when(day.between(0, n * m - 1), shape(F.date_format(moved, "yyyy-MM-dd"))).otherwise(s)


def _iso_date(s: Column, key: str) -> Column:
    return _date(s, s, lambda d: d, key)


def _day_first(s: Column, key: str) -> Column:
    iso = F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2))
    return _date(s, iso, lambda d: F.concat(F.substring(d, 9, 2), F.substring(s, 3, 1), F.substring(d, 6, 2),
                                            F.substring(s, 6, 1), F.substring(d, 1, 4)), key)


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (_int(F.substring(s, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    new = feistel(F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1),
                  F.array(*[F.lit(r).cast("bigint") for r in (898, 99, 9999)]), key, "ssn")

    def whole(v):
        a = F.element_at(v, 1)
        a = F.when(a > 664, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.element_at(v, 2) + 1).cast("string"), 2, "0"),
                           F.lpad((F.element_at(v, 3) + 1).cast("string"), 4, "0"))

    return F.when(valid, F.element_at(F.transform(F.array(new), whole), 1)).otherwise(s)


def _ipv4(s: Column, key: str) -> Column:
    octets = F.transform(F.split(s, r"\."), _int)
    new = feistel(octets, F.transform(octets, lambda _: F.lit(256).cast("bigint")), key, "ipv4")
    return F.when(F.array_max(octets) < 256, F.array_join(new.cast("array<string>"), ".")).otherwise(s)


def _nanp(s: Column, key: str) -> Column:
    """The ten last digits; area and exchange codes begin with 2 to 9."""
    start = F.length(F.regexp_extract(s, r"^(\+?1[ .-]?)?", 0))
    own = F.substring(s, start + 1, F.length(s))
    digit = F.length(F.regexp_replace(own, "[^0-9]", ""))  # always 10

    def lead(c, i):  # the first digit, and the digit after the first three
        before = F.length(F.regexp_replace(F.substring(own, F.lit(1), i), "[^0-9]", ""))
        return (digit == 10) & ((before == 0) | (before == 3)) & c.between("0", "9")

    return F.concat(F.substring(s, F.lit(1), start), _rewrite(
        _chars(own), lambda c, i: F.when(lead(c, i), 50).otherwise(_class_base(c)),
        lambda c, i: F.when(lead(c, i), 8).otherwise(_digit_size(c)), key, "nanp"))


def _phone(s: Column, key: str) -> Column:
    return F.concat(F.substring(s, 1, 2), _rewrite(_chars(F.substring(s, F.lit(3), F.length(s))), _class_base, _digit_size, key, "phone"))


RULES = {"email": _email, "iso_date": _iso_date, "day_first": _day_first, "ssn": _ssn, "ipv4": _ipv4, "nanp": _nanp, "phone": _phone}


def _pseudonym(match: Column, key: str) -> Column:
    out = None
    for kind, rule in RULES.items():
        own = match.rlike(f"^(?:{PATTERNS[kind]})$") if kind != "iso_date" else match.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        out = F.when(own, rule(match, key)) if out is None else out.when(own, rule(match, key))
    return out.otherwise(match)


def _value(ahead: Column) -> Column:
    """The longest valid card or IBAN at the beginning of ``ahead``, else null."""
    iban = F.regexp_extract(ahead, f"^(?:{'|'.join(IBANS)}){IBAN_EDGES[1]}", 0)
    cards = F.transform(F.array(*[F.regexp_extract(ahead, f"^(?:{form}){CARD_EDGES[1]}", 0) for form in CARDS]), lambda v: v)
    best = F.get(F.filter(cards, lambda v: (v != "") & _card_valid(v)), 0)
    return F.when(ahead.rlike("^[0-9]"), best).otherwise(F.get(F.filter(F.array(iban), lambda v: (v != "") & _iban_valid(v)), 0))


_STRETCH = "struct<value:string,text:string>"


def _stretches(before: Column, places: Column) -> Column:
    """The text as stretches: each a value (null in the first) and what follows
    it. ``places``: for each place where a value could begin, the text up to the
    next place, and the value. A place inside the value before it is part of
    it. Places are joined in runs of ``PLACES``, so that long texts do not copy
    their stretches again and again."""
    def put(out, value, text):
        """A new stretch for a value, else more text for the last one."""
        last = F.element_at(out, -1)
        return F.when(value.isNotNull(), F.concat(out, F.array(F.struct(value.alias("value"), text.alias("text"))))).otherwise(
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["value"].alias("value"), F.concat(last["text"], text).alias("text")))))

    def state(rest, out):
        return F.struct(rest.cast("int").alias("rest"), out.cast(f"array<{_STRETCH}>").alias("out"))

    def step(s, x):
        rest, size, n = s["rest"], F.length(x["piece"]), F.length(x["value"])
        own = F.when(rest == 0, x["value"])
        taken = F.when(rest > 0, rest).otherwise(F.coalesce(n, F.lit(0)))
        return state(F.greatest(taken - size, F.lit(0)), put(s["out"], own, F.substring(x["piece"], taken + 1, size)))

    def run(s, k):
        mine = F.aggregate(F.slice(places, k * PLACES + 1, F.lit(PLACES)),
                           state(s["rest"], F.array(F.struct(F.lit(None).cast("string").alias("value"), F.lit("").alias("text")))), step)
        joined = F.transform(F.array(mine), lambda m: state(m["rest"], F.concat(
            put(s["out"], F.lit(None).cast("string"), F.get(m["out"], 0)["text"]), F.slice(m["out"], F.lit(2), F.size(m["out"])))))
        return F.get(joined, 0)

    first = state(F.lit(0), F.array(F.struct(F.lit(None).cast("string").alias("value"), before.alias("text"))))
    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(places) - 1) / PLACES).cast("int")), first, run)["out"]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; ``count_col`` names a column to
    add: the number of values that were replaced."""
    text = F.col(f"`{text_col}`").cast("string")
    names = set(docs.columns)
    work = next(n for n in ("_pieces" + "_" * k for k in range(len(names) + 1)) if n not in names)
    p = F.col(work)
    # most texts hold neither a digit nor an at sign and are passed over quickly
    some = text.rlike("[0-9@]")
    led = F.concat(F.lit("\n"), text)          # no place is the first character, so pieces and places stay aligned
    # cards and IBANs first: the text from each place where one could begin to the next, and the value there
    rows = docs.withColumn(work, F.when(some, F.struct(
        F.split(led, BEGIN, -1).alias("pieces"),
        F.regexp_extract_all(led, F.lit(f"(?:{BEGIN})(?=((?s:.{{1,{REACH}}})))[A-Z0-9]"), F.lit(1)).alias("ahead"))))
    rows = rows.withColumn(work, F.when(some, F.struct(p["pieces"].alias("pieces"), F.transform(p["ahead"], _value).alias("values"))))
    before = F.substring(F.get(p["pieces"], 0), F.lit(2), F.length(led))
    places = F.zip_with(F.slice(p["pieces"], F.lit(2), F.size(p["pieces"])), p["values"],
                        lambda a, b: F.struct(a.alias("piece"), b.alias("value")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("value"), text.alias("text"))).cast(f"array<{_STRETCH}>")
    rows = rows.withColumn(work, F.when(some, F.when(F.exists(p["values"], lambda v: v.isNotNull()), _stretches(before, places)).otherwise(whole)))
    # then all other kinds between them
    rows = rows.withColumn(work, F.transform(p, lambda x: F.struct(
        x["value"].alias("value"), F.when(x["value"].rlike("^[0-9]"), _card(x["value"], key)).when(x["value"].isNotNull(), _iban(x["value"], key)).alias("new"),
        F.split(x["text"], ANY, -1).alias("between"), F.regexp_extract_all(x["text"], F.lit(ANY), F.lit(0)).alias("found"))))
    rows = rows.withColumn(work, F.transform(p, lambda x: F.struct(
        x["value"].alias("value"), x["new"].alias("new"), x["between"].alias("between"), x["found"].alias("found"),
        F.transform(x["found"], lambda m: _pseudonym(m, key)).alias("news"))))
    new = F.array_join(F.transform(p, lambda x: F.concat(F.coalesce(x["new"], F.lit("")), F.array_join(
        F.zip_with(x["between"], x["news"], lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))), "")
    out = {text_col: F.when(some, new).otherwise(text)}
    if count_col:
        changed = F.transform(p, lambda x: F.size(F.filter(F.zip_with(x["found"], x["news"], lambda a, b: a != b), lambda y: y))
                              + F.when(x["value"] != x["new"], 1).otherwise(0))
        out[count_col] = F.when(some, F.aggregate(changed, F.lit(0).cast("bigint"), lambda a, n: a + n)).otherwise(0).cast("bigint")
    return rows.withColumns(out).drop(work)

"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame functions only.

Validated values are found in the whole text and replaced by a keyed permutation of their own format: digits stay
digits, letters stay letters of their case, a card number keeps a valid check digit, an address stays an address and a
date stays a date. The permutation depends on the value and the key alone, so equal values get equal pseudonyms in all
documents, and different values of one format never get the same one.

Values are found in three passes, each over the text that the passes before left: account numbers (every place where
one may start is tried, with the length of its country), kinds that a pattern decides alone (calendar included), and
card numbers (every place in a run of digits, the longest that validates). What does not validate is text again, so
no neighbour hides a value.

The network splits a string in halves and adds to each position, in turn for either half, a digit of
SHA-512(key, kind, round, other half), modulo the size of that position's alphabet. Formats with holes (dates, social
security numbers) are walked: the permutation is applied again until its value is valid.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Applications of the permutation at most; of 2 ** 31 walks one would need more than 20, of all dates none needs 64.
WALK = 64
_DAYS = 73_049  # 1900-01-01 to 2099-12-31
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

# Characters of an account number by country.
IBAN_LENGTHS: dict[str, int] = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# Months by their number of days.
_LONG_MONTHS, _SHORT_MONTHS = ("January", "March", "May", "July", "August", "October", "December"), ("April", "June", "September", "November")
#: Digits of a card number.
CARD_DIGITS = range(13, 20)


def _calendar(long: str, short: str, february: str, order: Callable[[str, str, str], str], wide: bool = True) -> str:
    """Pattern of the days that exist from 1900 to 2099; `order` puts year, month and day together."""
    zero = "0" if wide else ""
    year, leap = "(?:19|20)[0-9]{2}", "(?:(?:19|20)(?:0[48]|[2468][048]|[13579][26])|2000)"
    day = lambda *tens: f"(?:{zero}[1-9]|{'|'.join(tens)})"
    some = (
        order(year, f"(?:{long})", day("[12][0-9]", "3[01]")), order(year, f"(?:{short})", day("[12][0-9]", "30")), order(year, february, day("1[0-9]", "2[0-8]")), order(leap, february, "29")
    )
    return f"(?:{'|'.join(some)})"


_NUMBERS = ("0[13578]|1[02]", "0[469]|11", "02")
_NAMES = ("|".join(_LONG_MONTHS), "|".join(_SHORT_MONTHS), "February")
_BRIEF = ("|".join(m[:3] for m in _LONG_MONTHS), "|".join(m[:3] for m in _SHORT_MONTHS), "Feb")
#: Orders of day, month and year, in the order in which they are tried.
ORDERS: dict[str, str] = {
    "yyyy-MM-dd": _calendar(*_NUMBERS, lambda y, m, d: f"{y}-{m}-{d}"),
    "dd/MM/yyyy": _calendar(*_NUMBERS, lambda y, m, d: f"{d}/{m}/{y}"),
    "MM/dd/yyyy": _calendar(*_NUMBERS, lambda y, m, d: f"{m}/{d}/{y}"),
    "dd.MM.yyyy": _calendar(*_NUMBERS, lambda y, m, d: rf"{d}\.{m}\.{y}"),
    "d MMMM yyyy": _calendar(*_NAMES, lambda y, m, d: f"{d} {m} {y}", wide=False),
    "MMMM d, yyyy": _calendar(*_NAMES, lambda y, m, d: f"{m} {d}, {y}", wide=False),
    "d MMM yyyy": _calendar(*_BRIEF, lambda y, m, d: f"{d} {m} {y}", wide=False),
    "MMM d, yyyy": _calendar(*_BRIEF, lambda y, m, d: f"{m} {d}, {y}", wide=False),
}
_OTHER_ORDERS = [o for o in ORDERS if o != "yyyy-MM-dd"]
#: Kinds that their pattern decides, in the order in which they are tried at a place of the text. Fixed formats.
KINDS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": rf"(?=[0-9])(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": rf"(?=[12])(?<![0-9-]){ORDERS['yyyy-MM-dd']}(?![0-9-])",
    "date_other": rf"(?=[0-9JFMASOND])(?<![0-9A-Za-z/.])(?:{'|'.join(ORDERS[o] for o in _OTHER_ORDERS)})(?![0-9/])",
    "ssn": r"(?=[0-9])(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?=[0-9+(])(?:(?<![0-9+])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9+])\+[1-9][0-9]{7,14}(?![0-9])|(?<![0-9+])\+[1-9][0-9]{0,2} [1-9](?:[ .-][0-9]{2}){4}(?![0-9])"
    r"|(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9])(?<![0-9][ .-])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9]|\.[0-9])"
    r"|(?<![0-9A-Za-z+])(?<![0-9][ .-])(?:\(0[0-9]{1,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{5,9}(?![0-9]|[ -][0-9])|(?<![0-9A-Za-z+])(?<![0-9][ .-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9]|[ .-][0-9]))",
    "access_key": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "hex_secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "password": r"(?<![0-9A-Za-z])(?:[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Pp]wd|PWD)=[^\s]++",
}
#: Where an account number may start, and a run of digits that may hold card numbers.
_OF_LENGTH: dict[int, list[str]] = {}
for _country, _length in IBAN_LENGTHS.items():
    _OF_LENGTH.setdefault(_length, []).append(_country)
IBAN = "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{'|'.join(of)})[0-9]{{2}}(?:[ -]?[0-9A-Z]){{{n - 4}}}" for n, of in sorted(_OF_LENGTH.items())) + ")(?![0-9A-Za-z])"
#: The letter after a run belongs to it: no card number ends there. Unbounded repetition is possessive, which needs no stack.
DIGITS = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,}+[A-Za-z]?"
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef",)


def _shifted(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    out = c
    for letters in alphabets:
        at = F.instr(F.lit(letters), c)
        out = F.when(at > 0, F.substring(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
    return out


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _added(half: Column, other: Column, turn: Column, key: str, alphabets: tuple[str, ...]) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), turn.cast("string"), F.length(half).cast("string"), other), 512)
    # one digest for a half: it is bound by a transform over a single value
    def add(d: Column) -> Column:
        def one(c, k):
            by = F.conv(F.substring(d, (k % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return _shifted(c, by, alphabets)

        return F.array_join(F.transform(_characters(half), one), "")

    return F.when(F.length(half) > 0, F.element_at(F.transform(F.array(digest), add), 1)).otherwise(half)


def feistel(value: Column, key: str, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """Permutation of the strings with value's alphabet at each place; other characters stay."""
    half = (F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def step(s: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        left = F.when(even, _added(s["l"], s["r"], turn, key, alphabets)).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(_added(s["r"], s["l"], turn, key, alphabets))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _walked(value: Column, permute: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """permute, again and again until valid; an error rather than an invalid value."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        then = F.element_at(F.transform(F.array(permute(s["v"])), lambda v: F.struct(v.alias("v"), valid(v).alias("done"))), 1)
        return F.when(s["done"], s).otherwise(then)

    lost = F.raise_error(F.lit(f"no valid pseudonym in {WALK} steps")).cast("string")
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda s: F.when(s["done"], s["v"]).otherwise(lost))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def luhn_sum(digits: Column, first_doubled: Column) -> Column:
    """Sum of the digits, every second one doubled; first_doubled tells whether that begins with the first."""

    def one(k):
        d = F.substring(digits, k + 1, F.lit(1)).cast("int")
        twice = F.when((k % 2 == 0) == first_doubled, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), F.lit(0), lambda a, x: a + x)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def is_card(m: Column) -> Column:
    return _bound(_digits(m), lambda d: (luhn_sum(d, F.length(d) % 2 == 0) % 10 == 0) & ~d.rlike("^0+$"))


def _in_format(m: Column, digits: Column) -> Column:
    """The digits, put where m has digits, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(_characters(m), start, step, lambda s: s["out"])


def _card(m: Column, key: str) -> Column:
    def made(payload: Column) -> Column:
        check = (10 - luhn_sum(payload, F.length(payload) % 2 == 1) % 10) % 10
        return F.concat(payload, check.cast("string"))

    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    walked = _walked(body, lambda b: feistel(b, key + "|card"), lambda b: ~b.rlike("^0+$"))
    return _in_format(m, _bound(walked, made))


def _ipv4(m: Column, key: str) -> Column:
    pair = lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))
    raw = F.array_join(F.transform(F.split(m, r"\."), pair), "")
    octet = lambda h: lambda k: F.conv(F.substring(h, k * 2 + 1, F.lit(2)), 16, 10)
    return _bound(feistel(raw, key + "|ipv4", _HEX), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), octet(h)), "."))


def _date(m: Column, key: str, order: str = "yyyy-MM-dd") -> Column:
    day = F.lpad(F.datediff(F.try_to_date(m, order), F.lit("1900-01-01").cast("date")).cast("string"), 5, "0")
    walked = _walked(day, lambda v: feistel(v, key + "|date"), lambda v: v.cast("int") < _DAYS)
    return F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), walked.cast("int")), order)


def _date_other(m: Column, key: str) -> Column:
    """A date in the first order that it fits."""
    out = m
    for order in reversed(_OTHER_ORDERS):
        out = F.when(m.rlike(f"^{ORDERS[order]}$"), _date(m, key, order)).otherwise(out)
    return out


def mod97(s: Column) -> Column:
    """Remainder of a string read as a number, letters counting 10 to 35."""
    letters = _characters(s)
    return F.aggregate(letters, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + (F.ascii(c) - 48)).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def is_iban(m: Column) -> Column:
    return _bound(F.regexp_replace(m, "[ -]", ""), lambda d: mod97(F.concat(F.substring(d, 5, 64), F.substring(d, 1, 4))) == 1)


def _iban(m: Column, key: str) -> Column:
    """Country kept, account permuted, check digits made anew; blanks and dashes stay where they are."""
    plain = F.regexp_replace(m, "[ -]", "")
    country = F.substring(m, 1, 2)
    made = _bound(
        feistel(F.substring(plain, 5, 64), key + "|iban"),
        lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b),
    )

    def spaced(whole: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            mark = c.isin(" ", "-")
            return F.struct(F.concat(s["out"], F.when(mark, c).otherwise(F.substring(whole, s["k"], F.lit(1)))).alias("out"), F.when(mark, s["k"]).otherwise(s["k"] + 1).alias("k"))

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
        return F.aggregate(_characters(m), start, step, lambda s: s["out"])

    return _bound(made, spaced)


def _phone(m: Column, key: str) -> Column:
    # the country code is not personal; it ends at the first mark, or after one digit
    code = F.regexp_extract(m, r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _in_format(rest, feistel(_digits(rest), key + "|phone")))


def _ssn(m: Column, key: str) -> Column:
    valid = lambda v: v.rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    return _in_format(m, _walked(_digits(m), lambda v: feistel(v, key + "|ssn"), valid))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(feistel(local, key + "|email"), F.substring(m, F.length(local) + 1, F.length(m)))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), feistel(F.substring(m, 5, 16), key + "|access"))


def _hex_secret(m: Column, key: str) -> Column:
    permuted = feistel(F.lower(m), key + "|hex", _HEX)
    return F.when(m == F.upper(m), F.upper(permuted)).otherwise(permuted)


def _password(m: Column, key: str) -> Column:
    name = F.substring_index(m, "=", 1)
    value = F.substring(m, F.length(name) + 2, F.length(m))
    hexadecimal = value.rlike("^[0-9a-f]+$")
    return F.concat(name, F.lit("="), F.when(hexadecimal, feistel(value, key + "|password", _HEX)).otherwise(feistel(value, key + "|password")))


MAKE: Mapping[str, Callable[[Column, str], Column]] = {
    "email": _email, "ipv4": _ipv4, "date": _date, "date_other": _date_other, "iban": _iban, "ssn": _ssn, "phone": _phone, "card": _card, "access_key": _access_key, "hex_secret": _hex_secret, "password": _password
}
_CERTAIN = "|".join(f"(?:{p})" for p in KINDS.values())
_START = f"(?<![0-9A-Za-z])(?={IBAN})"
_PART = "struct<kind:string,value:string>"


def kind_of(m: Column) -> Column:
    """First of KINDS whose pattern is the whole string."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _part(kind: Column | None, value: Column) -> Column:
    return F.struct((F.lit(None).cast("string") if kind is None else kind).alias("kind"), value.alias("value"))


def _picked(pieces: Column, values: Column, kind: str) -> Column:
    """Parts of a text cut into pieces: before all others the text ahead, then one for each place where values, aligned, may start.

    A value that is empty is none. The leftmost value wins, and a place inside it starts none.
    """
    start = F.struct(F.array(_part(None, F.get(pieces, F.lit(0)))).alias("out"), F.lit(0).alias("eaten"))

    def step(s: Column, at: Column) -> Column:
        piece, value = at["p"], F.coalesce(at["v"], F.lit(""))
        taken = (s["eaten"] == 0) & (value != "")
        reach = F.when(taken, F.length(value)).otherwise(s["eaten"])
        rest = F.array(_part(None, F.substring(piece, reach + 1, F.length(piece))))
        own = F.when(taken, F.array(_part(F.lit(kind), value))).otherwise(F.array().cast(f"array<{_PART}>"))
        return F.struct(F.concat(s["out"], own, rest).alias("out"), F.greatest(reach - F.length(piece), F.lit(0)).alias("eaten"))

    # the empty array of zip_with's longer side never arises: there is a value for each piece but the first
    places = F.zip_with(F.slice(pieces, F.lit(2), F.size(pieces)), values, lambda p, v: F.struct(p.alias("p"), v.alias("v")))
    return F.aggregate(places, start, step, lambda s: F.filter(s["out"], lambda x: x["value"] != ""))


def _accounts(text: Column) -> Column:
    """Parts of a text: account numbers that validate, and what is between them."""
    marked = F.concat(F.lit("\n"), text)  # a match without width at the very start would not cut
    found = F.regexp_extract_all(marked, F.lit(f"(?<![0-9A-Za-z])(?=({IBAN}))"), F.lit(1))
    parts = _bound(F.split(marked, _START, -1), lambda pieces: _picked(pieces, F.transform(found, lambda v: F.when(is_iban(v), v)), "iban"))
    return F.transform(parts, lambda x, k: _part(x["kind"], F.when(k == 0, F.substring(x["value"], F.lit(2), F.length(x["value"]))).otherwise(x["value"])))


def _certain(text: Column) -> Column:
    """Parts of a text by the kinds that a pattern decides."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_CERTAIN), F.lit(0)), lambda m: _part(kind_of(m), m))
    pairs = F.zip_with(F.split(text, _CERTAIN, -1), found, lambda a, b: F.array(_part(None, F.coalesce(a, F.lit(""))), b))
    return F.filter(F.flatten(pairs), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def _cards(text: Column) -> Column:
    """Parts of a text: card numbers that validate, the longest at the leftmost place of each run of digits."""

    def of_run(run: Column) -> Column:
        marked = F.concat(F.lit("\n"), run)
        place = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})"
        # aligned lists, the longest first: a string of n digits that starts at the place, or nothing
        lists = [F.regexp_extract_all(marked, F.lit(rf"{place}(?=((?:[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9A-Za-z]))?))"), F.lit(1)) for n in reversed(CARD_DIGITS)]

        def longest(z: Column) -> Column:
            valid = lambda v: F.when((v != "") & is_card(v), v)
            return F.transform(z["v0"], lambda _, k: F.coalesce(*[valid(F.get(z[f"v{n}"], k)) for n in range(len(lists))]))

        best = _bound(F.struct(*[x.alias(f"v{k}") for k, x in enumerate(lists)]), longest)
        parts = _bound(F.split(marked, place, -1), lambda pieces: _picked(pieces, best, "card"))
        return F.transform(parts, lambda x, k: _part(x["kind"], F.when(k == 0, F.substring(x["value"], F.lit(2), F.length(x["value"]))).otherwise(x["value"])))

    runs = F.transform(F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0)), of_run)
    pairs = F.zip_with(F.split(text, DIGITS, -1), runs, lambda a, b: F.concat(F.array(_part(None, F.coalesce(a, F.lit("")))), F.coalesce(b, F.array().cast(f"array<{_PART}>"))))
    return F.filter(F.flatten(pairs), lambda x: x["value"] != "")


def _again(parts: Column, holds: str, finder: Callable[[Column], Column]) -> Column:
    """parts, with those of text that may hold a value parted further."""
    return F.flatten(F.transform(parts, lambda x: F.when(x["kind"].isNull() & x["value"].rlike(holds), finder(x["value"])).otherwise(F.array(_part(x["kind"], x["value"])))))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    out = m
    for name, make in MAKE.items():
        out = F.when(kind == name, make(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_found, found) for every row of docs: text with pseudonyms, their number, and (kind, value) of each in order.

    `found` holds the pseudonyms that stand in the text, never the originals. A null text stays null with nothing
    found. Strings that look like a value but do not validate stay, and are searched for other values. Values of any
    length are found. Null ids and repeated rows pass through. Other columns are ignored. Nothing is shuffled.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    some = F.coalesce(text.rlike(f"{_CERTAIN}|{DIGITS}|{_START}"), F.lit(False))
    none = F.array().cast(f"array<{_PART}>")
    rows = rows.withColumn("_parts", F.when(some, F.when(text.rlike(_START), _accounts(text)).otherwise(F.array(_part(None, text)))).otherwise(none))
    rows = rows.withColumn("_parts", _again(F.col("_parts"), _CERTAIN, _certain))
    rows = rows.withColumn("_parts", _again(F.col("_parts"), DIGITS, _cards))
    made = F.transform("_parts", lambda x: _part(x["kind"], F.when(x["kind"].isNull(), x["value"]).otherwise(pseudonym(x["value"], x["kind"], key))))
    rows = rows.withColumn("_parts", made)
    kept = F.filter("_parts", lambda x: x["kind"].isNotNull())
    whole = F.array_join(F.transform("_parts", lambda x: x["value"]), "")
    return rows.select(F.col("_id").alias(id_col), F.when(F.size("_parts") > 0, whole).otherwise(text).alias("text"), F.size(kept).cast("long").alias("n_found"), kept.alias("found"))

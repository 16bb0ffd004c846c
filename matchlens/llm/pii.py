"""Format-preserving pseudonyms for personal data, in Spark expressions only.

Values are found by one pattern, validated by kind (check digits, ranges, calendar), and permuted by a keyed Feistel
network over exactly the values that are valid in their format: Z_A x Z_B for sizes A and B fit to the kind, so no
value leaves its format and no two collide. Equal values get equal pseudonyms wherever they stand.
"""

from __future__ import annotations

import calendar
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

ROUNDS = 8
#: The setting that the query takes its key from.
KEY_SETTING = "spark.matchlens.pii.key"
#: The days of 400 years from 1700-01-01 on: 189 * 773.
DAYS, DAYS_A = 146_097, 189

# The name is tried from its first character only, and labels and their number are bounded: a very long word takes
# time in proportion to its length, and no deep stack.
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,30}\.[A-Za-z]{2,63}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])"
#: American numbers with their code; groups of one to eight digits, 8 to 15 digits in all; three groups of any code;
#: E.164 without separators; American numbers without their code, or with 1 before.
PHONE = (
    r"(?:\+1[ .\-]\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])"
    r"|\+(?=(?:[ .\-]?[()]?[ .\-]?[0-9]){8,15}+(?![ .\-]?[0-9]))[1-9][0-9]{0,2}(?:[ .\-]?\([0-9]{1,5}\)[ .\-]?[0-9]{1,8}|[ .\-][0-9]{1,8})(?:[ .\-][0-9]{1,8}){1,6}(?![0-9])"
    r"|\+[0-9]{1,3}[ .\-]\(?[0-9]{2,4}\)?[ .\-][0-9]{3,4}[ .\-][0-9]{3,4}(?![0-9])"
    r"|\+[1-9][0-9]{7,14}(?![0-9])"
    r"|(?<![0-9+\-.])(?:1[ \-])?(?:\([2-9][0-9]{2}\)[ \-]?|[2-9][0-9]{2}-)[0-9]{3}[ .\-][0-9]{4}(?![0-9\-]))"
)
#: The part of a phone number that stays: its country code, by the ITU's list where nothing sets it off.
KEPT = r"^(?:\+[0-9]{1,3}(?=[ .\-(])|\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})|1[ \-])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SOCIAL = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
DATE = r"(?<![0-9\-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9\-/])"
CARD = r"(?<![0-9])(?:(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9]{13,19})(?![0-9])"
ALL = "|".join([EMAIL, IBAN, SECRET, PHONE, ADDRESS, SOCIAL, DATE, CARD])


def _keyed(key: Column, kind: str, r: Column | int, value: Column) -> Column:
    """A number below 2^60 from the key, the kind, the round and a value."""
    r = r if isinstance(r, Column) else F.lit(r)
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted(value: Column, a: Column, b: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the whole numbers below a * b."""
    quotient = F.call_function("div", value, a)
    start = F.struct(F.pmod(value, a).cast("long").alias("x"), quotient.cast("long").alias("y"))

    def step(s: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        x = F.when(even, F.pmod(s["x"] + F.pmod(_keyed(key, kind, r, s["y"]), a), a)).otherwise(s["x"])
        y = F.when(even, s["y"]).otherwise(F.pmod(s["y"] + F.pmod(_keyed(key, kind, r, s["x"]), b), b))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda s: s["x"] + s["y"] * a)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(11)]), (n + 1).cast("int")).cast("long")


def permuted_digits(digits: Column, key: Column, kind: str) -> Column:
    """A permutation of the digit strings of this length, 1 to 18 digits; the length is part of the kind."""
    n = F.length(digits)
    half = F.floor(n / 2)
    of = F.concat(key, F.lit("/"), n.cast("string"))
    return F.lpad(permuted(digits.cast("long"), _power(half), _power(n - half), of, kind).cast("string"), n, "0")


def _american(digits: Column, key: Column) -> Column:
    """Ten digits of an American number permuted within its plan: area and exchange from 200 on stay from 200 on, others below."""
    part = lambda at, n: F.substring(digits, at, n).cast("long")
    long = lambda n: F.lit(n).cast("long")
    areas, exchanges = (F.when(part(at, 3) >= 200, long(800)).otherwise(long(200)) for at in (1, 4))
    least = lambda n: F.when(n == 800, long(200)).otherwise(long(0))
    number = ((part(1, 3) - least(areas)) * exchanges + part(4, 3) - least(exchanges)) * 10_000 + part(7, 4)
    of = F.concat(key, F.lit("/us/"), areas.cast("string"), F.lit("/"), exchanges.cast("string"))
    new = permuted(number, areas * 100, exchanges * 100, of, "phone")
    over = lambda v, n: F.call_function("div", v, n)
    text = lambda v, n: F.lpad(v.cast("string"), n, "0")
    made = F.transform(F.array(new), lambda v: F.concat(text(over(over(v, long(10_000)), exchanges) + least(areas), 3), text(F.pmod(over(v, long(10_000)), exchanges) + least(exchanges), 3), text(F.pmod(v, long(10_000)), 4)))
    return F.get(made, 0)


def refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced by others, in order."""
    pieces = F.split(m, "[0-9]", -1)
    each = F.zip_with(pieces, F.split(digits, "(?!^)(?!$)"), lambda p, d: F.concat(F.coalesce(p, F.lit("")), F.coalesce(d, F.lit(""))))
    return F.array_join(each, "")


def _luhn_digit(payload: Column) -> Column:
    """The digit that makes payload and digit pass the Luhn check."""
    passes = F.array(*[F.lit(str(i)) for i in range(10)])
    return F.element_at(F.filter(passes, lambda d: F.call_function("luhn_check", F.concat(payload, d))), 1)


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    wide = lambda c: F.when(c.between("0", "9"), 10).otherwise(100)
    return F.aggregate(F.split(text, "(?!^)(?!$)"), F.lit(0).cast("int"), lambda s, c: F.pmod(s * wide(c) + value(c), F.lit(97)).cast("int"))


def _card(m: Column, key: Column) -> Column:
    digits = _digits(m)
    payload = permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    whole = F.get(F.transform(F.array(payload), lambda p: F.concat(p, _luhn_digit(p))), 0)
    return F.when(F.call_function("luhn_check", digits), refilled(m, whole)).otherwise(m)


def _address(m: Column, key: Column) -> Column:
    parts = F.split(m, r"\.")
    byte = [F.get(parts, i).cast("int") for i in range(4)]
    valid = (byte[0] <= 255) & (byte[1] <= 255) & (byte[2] <= 255) & (byte[3] <= 255)
    number = ((byte[0].cast("long") * 256 + byte[1]) * 256 + byte[2]) * 256 + byte[3]
    new = permuted(number, F.lit(65_536).cast("long"), F.lit(65_536).cast("long"), key, "address")
    text = F.array_join(F.transform(F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)), lambda s: F.pmod(F.call_function("div", new, F.pow(F.lit(2.0), s).cast("long")), F.lit(256)).cast("string")), ".")
    return F.when(valid, text).otherwise(m)


def _social(m: Column, key: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.regexp_extract(m, r"(\d+)-(\d+)-(\d+)", i).cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    number = index + ((group - 1) * 9999 + serial - 1) * 898
    new = permuted(number, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "social")
    digits = F.transform(F.array(new), lambda v: F.struct(F.pmod(v, F.lit(898)).alias("i"), F.call_function("div", v, F.lit(898).cast("long")).alias("r")))
    made = F.transform(digits, lambda d: F.concat(F.lpad((d["i"] + F.when(d["i"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.floor(d["r"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.pmod(d["r"], F.lit(9999)) + 1).cast("string"), 4, "0")))
    return F.when(valid, F.get(made, 0)).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    out = m
    for pattern, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d\d/", "MM/dd/yyyy"), (r"^\d\d\.", "dd.MM.yyyy")):
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit("1700-01-01").cast("date")).cast("long")
        new = permuted(day, F.lit(DAYS_A).cast("long"), F.lit(DAYS // DAYS_A).cast("long"), key, "date")
        out = F.when(m.rlike(pattern), F.when(day.between(0, DAYS - 1), F.date_format(F.date_add(F.lit("1700-01-01").cast("date"), new.cast("int")), form)).otherwise(m)).otherwise(out)
    late = m.rlike(r"^\d\d/") & F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).isNotNull() & (F.substring(m, 1, 2) > "12") & F.substring(m, 7, 4).between("1700", "2099")
    return F.when(late, _late_day(m, key)).otherwise(out)


def _late_day(m: Column, key: Column) -> Column:
    """A date dd/MM/yyyy whose day is after the 12th, so that it can't be read as MM/dd/yyyy, becomes another such.

    Days to the 28th are permuted over all months of 400 years, later ones over those months that have them.
    """
    day, month, year = (F.substring(m, at, n).cast("long") for at, n in ((1, 2), (4, 2), (7, 4)))
    since = year - 1700
    long = lambda x: F.lit(x).cast("long")
    of = lambda value, a, b, kind: F.transform(F.array(permuted(value, long(a), long(b), key, kind)), lambda v: v)
    over = lambda v, n: F.call_function("div", v, long(n))
    text = lambda d, mo, y: F.concat(F.lpad(d.cast("string"), 2, "0"), F.lit("/"), F.lpad(mo.cast("string"), 2, "0"), F.lit("/"), (y + 1700).cast("string"))
    made = lambda values, f: F.get(F.transform(values, f), 0)
    in_month = lambda i: F.when(i == 0, 1).otherwise(i + 2)
    months31 = F.array(*[F.lit(x) for x in (1, 3, 5, 7, 8, 10, 12)])
    leap = F.array(*[F.lit(y) for y in range(400) if calendar.isleap(1700 + y)])
    early = made(of((since * 12 + month - 1) * 16 + day - 13, 240, 320, "day"), lambda v: text(F.pmod(v, long(16)) + 13, F.pmod(over(v, 16), long(12)) + 1, over(v, 192)))
    thirty = made(of((since * 11 + F.when(month == 1, 0).otherwise(month - 2)) * 2 + day - 29, 88, 100, "day30"), lambda v: text(F.pmod(v, long(2)) + 29, in_month(F.pmod(over(v, 2), long(11))), over(v, 22)))
    last = made(of(since * 7 + F.array_position(months31, month.cast("int")) - 1, 28, 100, "day31"), lambda v: text(F.lit(31), F.element_at(months31, (F.pmod(v, long(7)) + 1).cast("int")), over(v, 7)))
    leaps = made(of(F.array_position(leap, since.cast("int")) - 1, 1, 97, "leap"), lambda v: text(F.lit(29), F.lit(2), F.element_at(leap, (v + 1).cast("int"))))
    return F.when(day <= 28, early).when(day == 31, last).when(month == 2, leaps).otherwise(thirty)


def _iban(m: Column, key: Column) -> Column:
    """The longest run of groups of m that is valid, with what follows it as it was; m if none is."""
    parts = F.split(m, " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), " "))
    valid = F.filter(runs, lambda x: (F.length(x) >= 14) & (_mod97(_plain(F.concat(F.substring(x, 5, 100), F.substring(x, 1, 4)))) == 1))
    new = F.transform(F.slice(F.reverse(valid), 1, 1), lambda x: F.concat(_valid_iban(x, key), F.substr(m, F.length(x) + 1)))
    return F.coalesce(F.get(new, 0), m)


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def _valid_iban(m: Column, key: Column) -> Column:
    """The account's digits are permuted in blocks of at most 18, its letters and blanks stay, the check digits follow."""
    country, account = F.substring(m, 1, 2), F.substring(m, 5, 100)
    digits = _digits(account)
    head, tail = F.substring(digits, 1, 18), F.substring(digits, 19, 18)
    safe = lambda x, kind: F.when(F.length(x) > 0, permuted_digits(x, F.concat(key, country), kind)).otherwise("")
    new = refilled(account, F.concat(safe(head, "iban1"), safe(tail, "iban2")))
    check = F.lpad((98 - _mod97(_plain(F.concat(new, country, F.lit("00"))))).cast("string"), 2, "0")
    return F.concat(country, check, new)


def _hex_like(m: Column, key: Column, kind: str) -> Column:
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), m), 256)
    return F.substr(digest, F.lit(1), F.length(m))


def _email(m: Column, key: Column) -> Column:
    return F.concat(F.lit("user"), F.lpad(_keyed(key, "email", 0, F.lower(m)).cast("string"), 19, "0"), F.lit("@example.invalid"))


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of a found value; the value itself if it isn't valid. A phone number keeps its country code."""
    country = F.regexp_extract(m, KEPT, 0)
    rest = F.substr(m, F.length(country) + 1)
    american = country.isin("", "+1", "1 ", "1-") & (F.length(_digits(rest)) == 10)
    phone = F.concat(country, refilled(rest, F.when(american, _american(_digits(rest), key)).otherwise(permuted_digits(_digits(rest), key, "phone"))))
    is_ = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(is_(SECRET) & m.rlike("[a-f]"), _hex_like(m, key, "secret"))
        .when(is_(IBAN), _iban(m, key))
        .when(is_(PHONE), phone)
        .when(is_(ADDRESS), _address(m, key))
        .when(is_(SOCIAL), _social(m, key))
        .when(is_(DATE), _date(m, key))
        .when(is_(CARD), _card(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs, all columns, with pseudonyms in the text, and n_private, the number of values replaced, at the end.

    Who has the key can undo the permutations: it is the caller's to keep. Very long texts are read whole; repeated
    rows, and equal values anywhere, get equal pseudonyms; an empty table gives no rows.

    Null texts stay null, empty ones empty, with 0 values. Values that fail validation stay as they are. Addresses of
    the mail kind become addresses of one made-up domain; 32 to 64 hex digits become as many others. n_private gets
    underscores if docs has such a column. Left as they are: phone numbers without a + unless American with a bracketed
    or dashed area code, those with two separators between groups, extensions, IBANs in lower case or grouped
    otherwise than by four, cards grouped otherwise than by four, dates in other forms, addresses of IPv6, and secrets in
    capitals. A date has different pseudonyms in different forms.
    """
    count, found, new = fresh(docs, "n_private", "found_values", "new_values")
    text = F.col(text_col)
    rows = docs.select("*", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ALL})"), F.lit(0))).alias(found))
    rows = rows.select("*", F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, F.lit(key)))).alias(new))
    pieces = F.zip_with(F.split(text, f"({ALL})", -1), F.col(new), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    changed = F.filter(F.zip_with(F.col(found), F.col(new), lambda a, b: a != b), lambda x: x)
    text = F.when(F.col(new).isNull(), text).otherwise(F.array_join(pieces, ""))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.greatest(F.coalesce(F.size(changed), F.lit(0)), F.lit(0)).cast("long").alias(count))


def session_key(spark: SparkSession) -> str:
    """The key that the session's KEY_SETTING names; where it names none, one drawn for this session and kept there."""
    if (key := spark.conf.get(KEY_SETTING, None)) is None:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark)).select("doc_id", "n_private", "text")

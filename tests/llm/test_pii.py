import calendar
import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from matchlens.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


VALUES = {
    "card": "4111111111111111", "spaced": "4111 1111 1111 1111", "phone": "+1 (743) 555-3824", "address": "227.5.221.1", "mail": "été.19@mail5.example.com",
    "secret": "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "social": "123-45-6789", "date": "1984-02-29", "us": "12/24/1999", "dotted": "24.12.1999", "iban": "DE89370400440532013000",
}
CLEAN = ["4111111111111112", "300.1.1.1", "666-45-6789", "02/30/2001", "DE89370400440532013001", "1.2.3", "in 1984 there were 12345 words", "a @ b", "20.5 and 3.14"]


def test_values_change_within_their_format(spark, docs):
    rows = [(i, f"see {v}, and {v}.") for i, v in enumerate(VALUES.values())] + [(100 + i, c) for i, c in enumerate(CLEAN)] + [(200, None), (201, "")]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_private", F.lit(7)).withColumn("found_values", F.lit("x")), "k").collect()}
    new = {}
    for i, (kind, v) in enumerate(VALUES.items()):
        m = re.fullmatch(r"see (.+), and (.+)\.", out[i].text)
        assert m and m[1] == m[2] != v and out[i].n_private_ == 2, out[i]
        new[kind] = m[1]
    assert luhn(new["card"]) and re.fullmatch(r"\d{16}", new["card"]) and luhn(new["spaced"].replace(" ", "")) and new["spaced"].replace(" ", "") == new["card"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new["phone"]) and all(int(x) < 256 for x in new["address"].split("."))
    assert re.fullmatch(r"[0-9a-f]{40}", new["secret"]) and re.fullmatch(r"\d{3}-\d\d-\d{4}", new["social"]) and iban(new["iban"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", new["date"]) and re.fullmatch(r"\d\d/\d\d/\d{4}", new["us"]) and re.fullmatch(r"\d\d\.\d\d\.\d{4}", new["dotted"])
    m, d, y = new["us"].split("/")
    assert new["dotted"] == f"{d}.{m}.{y}"  # the same day, whatever its format
    for i, c in enumerate(CLEAN):
        assert out[100 + i].text == c and out[100 + i].n_private_ == 0
    assert out[200].text is None and out[201].text == ""


def test_permutations_are_bijections(spark):
    for a, b in ((898, 11), (10, 100), (1, 10), (189, 7)):
        x = spark.range(a * b).select(pii.permuted(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit("k"), "t").alias("v"))
        assert sorted(r.v for r in x.collect()) == list(range(a * b))
    digits = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("k"), "t").alias("v"))
    assert sorted(r.v for r in digits.collect()) == [f"{i:03d}" for i in range(1000)]


def test_keys_differ_and_plan_is_native(spark, docs, nothing):
    df = spark.createDataFrame([(1, VALUES["card"])], "doc_id long, text string")
    assert pii.pseudonymise(df, "one").first().text != pii.pseudonymise(df, "two").first().text
    assert not re.search("Python|Pandas|Arrow", pii.pseudonymise(docs, "k")._jdf.queryExecution().executedPlan().toString())
    assert pii.pseudonymise(nothing, "k").count() == 0 and pii.pseudonymise(docs, "k").count() == docs.count()


def test_very_long_words_and_dots(spark):
    word, dots = "ab9" * 200_000, "x@" + "a." * 100_000
    df = spark.createDataFrame([(1, word), (2, dots), (3, f"{word} me@mail5.example.com")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert out[1].text == word and out[1].n_private == 0 and out[2].n_private <= 1
    assert out[3].n_private == 1 and out[3].text.startswith(word + " user") and out[3].text.endswith("@example.invalid")


def test_other_forms_of_phones_and_accounts(spark):
    phones = ["(743) 555-3824", "743-555-3824", "+17435553824", "+33 1 42 68 53 00", "+49 30 12345678", "+44 20 7946 0958", "1-743-555-3824", "+44 (0)20 7946 0958"]
    accounts = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    tails = [".", " USD", " AND 12"]
    rows = [(k, f"see {v}{t}") for k, (v, t) in enumerate([(v, ".") for v in phones] + [(v, t) for v in accounts for t in tails])]
    clean = ["DE89 3704 0044 0532 0130 01", "in 1984-555-3824", "+1 2 3", "1743-555-38245", "a+12345"]
    rows += [(100 + k, c) for k, c in enumerate(clean)]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for k, (i, text) in enumerate(rows):
        if i >= 100:
            assert out[i].text == text and out[i].n_private == 0, out[i]
            continue
        assert out[i].text != text and out[i].n_private == 1, (text, out[i])
        assert re.sub("[0-9]", "0", out[i].text) == re.sub("[0-9]", "0", text), (text, out[i])
        if k >= len(phones):
            v, t = [(v, t) for v in accounts for t in tails][k - len(phones)]
            assert out[i].text.endswith(t) and iban(out[i].text[4 : len(out[i].text) - len(t)].replace(" ", ""))
    assert out[2].text.startswith("see +1") and out[1].text[-13:-1].replace("-", "") == out[2].text[-11:-1]


def test_pseudonyms_of_phones_are_found_again(spark):
    """American numbers stay within their plan, so that each pseudonym is a number too, and no two become one."""
    rows = [(i, f"call ({200 + i % 600}) 555-{i:04} now", f"call {200 + i % 600}-{200 + i}-{i:04} now") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    once = pii.pseudonymise(df, "k")
    again = pii.pseudonymise(once.drop("n_private"), "k2")
    a, b = once.collect(), again.collect()
    assert all(r.n_private == 1 for r in a) and all(r.n_private == 1 for r in b) and len({r.text for r in a}) == 700
    assert all(re.fullmatch(r"call \([2-9]\d\d\) [2-9]\d\d-\d{4} now", r.text) for r in a)
    dashed = pii.pseudonymise(df.select("doc_id", F.col("other").alias("text")), "k").collect()
    assert all(re.fullmatch(r"call [2-9]\d\d-[2-9]\d\d-\d{4} now", r.text) for r in dashed) and len({r.text for r in dashed}) == 700


# The same written once more, in plain Python: only the patterns are shared.


def feistel(v, a, b, key, kind):
    x, y = v % a, v // a
    for r in range(8):
        half = y if r % 2 == 0 else x
        f = int(hashlib.sha256(f"{key}|{kind}|{r}|{half}".encode()).hexdigest()[:15], 16)
        x, y = ((x + f) % a, y) if r % 2 == 0 else (x, (y + f) % b)
    return x + y * a


def digits_of(d, key, kind):
    half = len(d) // 2
    return str(feistel(int(d), 10**half, 10 ** (len(d) - half), f"{key}/{len(d)}", kind)).zfill(len(d))


def fill(m, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), m)


def slow_date(m, key):
    start = datetime.date(1700, 1, 1)
    form = "%Y-%m-%d" if m[4] == "-" else "%m/%d/%Y" if m[2] == "/" else "%d.%m.%Y"
    try:
        day = (datetime.datetime.strptime(m, form).date() - start).days
        if 0 <= day < 146_097:
            new = start + datetime.timedelta(feistel(day, 189, 773, key, "date"))
            y, mo, d = f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"
            return {"-": f"{y}-{mo}-{d}", "/": f"{mo}/{d}/{y}", ".": f"{d}.{mo}.{y}"}["-" if m[4] == "-" else m[2]]
        return m
    except ValueError:
        pass
    if m[2] != "/":
        return m
    d, mo, y = int(m[:2]), int(m[3:5]), int(m[6:])
    if not (1700 <= y < 2100 and 1 <= mo <= 12 and 12 < d <= calendar.monthrange(y, mo)[1]):
        return m
    say = lambda d, mo, y: f"{d:02}/{mo:02}/{y:04}"
    months = [(y, m) for y in range(1700, 2100) for m in range(1, 13)]
    if d <= 28:
        v = feistel(months.index((y, mo)) * 16 + d - 13, 240, 320, key, "day")
        return say(v % 16 + 13, months[v // 16][1], months[v // 16][0])
    if d == 31:
        have = [x for x in months if calendar.monthrange(*x)[1] == 31]
        v = feistel(have.index((y, mo)), 28, 100, key, "day31")
        return say(31, have[v][1], have[v][0])
    if mo == 2:
        have = [y for y in range(1700, 2100) if calendar.isleap(y)]
        return say(29, 2, have[feistel(have.index(y), 1, 97, key, "leap")])
    have = [x for x in months if x[1] != 2]
    v = feistel(have.index((y, mo)) * 2 + d - 29, 88, 100, key, "day30")
    return say(v % 2 + 29, have[v // 2][1], have[v // 2][0])


def slow_pseudonym(m, key):
    full = lambda p: re.fullmatch(p, m)
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        return f"user{int(hashlib.sha256(f'{key}|email|0|{m.lower()}'.encode()).hexdigest()[:15], 16):019}@example.invalid"
    if full(pii.SECRET) and re.search("[a-f]", m):
        return hashlib.sha256(f"{key}|secret|{m}".encode()).hexdigest()[: len(m)]
    if full(pii.IBAN):
        groups = m.split(" ")
        for k in range(len(groups), 0, -1):
            x = " ".join(groups[:k])
            plain = x.replace(" ", "")
            if len(x) >= 14 and iban(plain):
                own, account = key + x[:2], x[4:]
                d = re.sub("[^0-9]", "", account)
                new = fill(account, (digits_of(d[:18], own, "iban1") if d[:18] else "") + (digits_of(d[18:], own, "iban2") if d[18:] else ""))
                check = 98 - int("".join(str(int(c, 36)) for c in new.replace(" ", "") + x[:2] + "00")) % 97
                return f"{x[:2]}{check:02}{new}{m[len(x):]}"
        return m
    if full(pii.PHONE):
        country = re.match(pii.KEPT, m)
        head = country[0] if country else ""
        own = re.sub("[^0-9]", "", m[len(head) :])
        if len(own) == 10 and head in ("", "+1", "1 ", "1-"):
            na, ne = (800 if int(x) >= 200 else 200 for x in (own[:3], own[3:6]))
            a0, e0 = (200 if n == 800 else 0 for n in (na, ne))
            v = feistel(((int(own[:3]) - a0) * ne + int(own[3:6]) - e0) * 10_000 + int(own[6:]), na * 100, ne * 100, f"{key}/us/{na}/{ne}", "phone")
            return head + fill(m[len(head) :], f"{v // 10_000 // ne + a0:03}{v // 10_000 % ne + e0:03}{v % 10_000:04}")
        return head + fill(m[len(head) :], digits_of(own, key, "phone"))
    if full(pii.ADDRESS):
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255:
            return m
        return ".".join(map(str, feistel(int.from_bytes(bytes(parts), "big"), 65_536, 65_536, key, "address").to_bytes(4, "big")))
    if full(pii.SOCIAL):
        a, g, n = map(int, m.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and n):
            return m
        areas = [x for x in range(1, 900) if x != 666]
        v = feistel(areas.index(a) + ((g - 1) * 9999 + n - 1) * 898, 898, 99 * 9999, key, "social")
        return f"{areas[v % 898]:03}-{v // 898 // 9999 + 1:02}-{v // 898 % 9999 + 1:04}"
    if full(pii.DATE):
        return slow_date(m, key)
    if full(pii.CARD) and luhn(digits):
        payload = digits_of(digits[:-1], key, "card")
        return fill(m, payload + next(c for c in "0123456789" if luhn(payload + c)))
    return m


def slow(text, key):
    count = 0

    def new(m):
        nonlocal count
        out = slow_pseudonym(m[0], key)
        count += out != m[0]
        return out

    return (None if text is None else re.sub(pii.ALL.replace(r"\p{L}\p{N}", r"\w"), new, text)), count


def test_against_plain_python(spark):
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [*VALUES.values(), *CLEAN, None, "", "31/12/1999 and 29/02/2000, 29/02/1900, 30/04/1999, 31/04/1999, 13/13/2000, 30/01/2001, 01/31/2001, 28/02/1699, 13/01/2100"]
    rows += [f"{rng.randrange(13, 32)}/{rng.randrange(1, 13):02}/{rng.randrange(1690, 2110)}" for _ in range(60)]
    rows += [f"{rng.randrange(1, 14):02}/{rng.randrange(1, 32):02}/{rng.randrange(1690, 2110)} {rng.randrange(1600, 2200)}-{rng.randrange(0, 14):02}-{rng.randrange(0, 33):02}" for _ in range(40)]
    rows += [f"n {number(3)}-{number(2)}-{number(4)} and {number(rng.randrange(13, 20))} or {number(1)}.{number(3)}.{number(2)}.{number(3)}" for _ in range(40)]
    rows += [f"+{rng.randrange(1, 999)} {number(3)} {number(4)} {number(3)}, ({number(3)}) {number(3)}-{number(4)} +{number(11)}" for _ in range(40)]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "a key").orderBy("doc_id").collect()
    for r, text in zip(got, rows):
        assert (r.text, r.n_private) == slow(text, "a key"), text


def test_key_is_asked_for(spark):
    with pytest.raises(TypeError):
        pii.pseudonymise(spark.range(1))
    spark.conf.unset(pii.KEY_SETTING)
    drawn = pii.session_key(spark)
    assert len(drawn) == 64 and pii.session_key(spark) == drawn
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == "mine"

"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Every validated value is replaced by another valid value of the same format through a keyed
permutation, so equal values get equal pseudonyms in all documents and different values of a
format get different ones. The permutation is a Feistel network on two numbers (x, y) of Z_a x Z_b:
in turn x <- x + F(round, y) mod a and y <- y + F(round, x) mod b, F from SHA-256 over key, format,
length, round and value. Formats and their domains:

* card: 13 to 19 digits with a valid Luhn sum, in one run, in groups of 4-4-4-4 (with full stops
  too), 4-6-5 or 4-6-4, or
  in any groups with single blanks or hyphens where no other number stands next to them; all but
  the last are permuted, the last is the new check digit;
* phone: + and 8 to 15 digits in any groups, or (ddd) ddd-dddd, ddd-ddd-dddd, ddd.ddd.dddd and
  ddd ddd dddd; the last ten digits
  (all but the first of a shorter number, all but three of one over 13);
* ssn: ddd-dd-dddd of valid area, group and serial; the 898 x 989901 valid numbers;
* ip: dotted quads of numbers to 255; the 2^16 x 2^16 addresses;
* date: yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy (or dd/mm/yyyy where only that is valid), days and months
  also of one digit, before a time (T12:00) and in ranges too, of the years 1800 to 2199; their
  27 x 5411 days. Dates in a format are permuted within it; the two readings of slash dates, and
  dates with and without leading zeros, may share a pseudonym;
* email: letters and digits of the local part, each among its kind; the domain stays.

The pattern runs once over a text and puts marks round its matches; at those it is cut and put
together again, so replacement is linear and a value inside a longer number isn't touched. No
group of the pattern repeats without a bound, so its depth doesn't grow with the text. What fails
its validation stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("card", "phone", "ssn", "ip", "date", "email")
_CARD = r"\d{4}[ .-]\d{4}[ .-]\d{4}[ .-]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19}"
#: What a run of digit groups must not hold to be tried as one card.
_OTHER = rf"{_CARD}|\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}-\d{{2}}-\d{{4}}|\d{{4}}-\d{{1,2}}-\d{{1,2}}"
FORMAT = {
    "email": (r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,126}"
              r"(?!\.?[A-Za-z0-9-])"),
    "phone": (r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
              r"|(?<![\w+])\+\d(?:[ .()/-]{0,3}\d){7,14}(?!\w|[./-]\d)"
              r"|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])"
              r"|(?<![\w.-]|\d )(?:\d{3}\.\d{3}\.|\d{3} \d{3} )\d{4}(?!\w|[ .-]\d)"),
    "date": (r"(?:(?<![\w./-])|(?<=\d{4}-\d{2}-\d{2}/)|(?<=T[0-9:.,Z+-]{4,25}/))\d{4}-\d{1,2}-\d{1,2}"
             r"(?:(?!\w|[./-]\d)|(?=T\d{2})|(?=/\d{4}-\d{1,2}-\d))"
             r"|(?<![\w./-])\d{4}/\d{1,2}/\d{1,2}(?!\w|[./-]\d)"
             r"|(?:(?<![\w./-])|(?<=\.\d{4}[/-]))\d{1,2}\.\d{1,2}\.\d{4}"
             r"(?:(?!\w|[./-]\d)|(?=[/-]\d{1,2}\.\d{1,2}\.\d{4}))"
             r"|(?:(?<![\w./-])|(?<=/\d{4}-))\d{1,2}/\d{1,2}/\d{4}"
             r"(?:(?!\w|[./-]\d)|(?=-\d{1,2}/\d{1,2}/\d{4}))"),
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "card": (rf"(?<![0-9A-Za-z])(?:{_CARD})(?![0-9A-Za-z])"
             rf"|(?<![0-9A-Za-z]|\d[ -])(?!(?:\d{{1,19}}[ -]){{0,19}}(?:{_OTHER})(?![0-9A-Za-z]))"
             r"\d(?:[ -]?\d){12,18}(?![0-9A-Za-z]|[ -]?\d|[./:@+_-]\w)"),
}
ANY = "|".join(FORMAT[k] for k in ("email", "phone", "date", "ssn", "ip", "card"))
FIRST_DAY, DAYS = "1800-01-01", 146_097          # 400 years: 27 * 5411 days


def _hash(key: str, tweak: Column, i: Column, v: Column) -> Column:
    """60 bits of SHA-256 as a non-negative long."""
    h = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), v.cast("string")), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """struct(x, y) permuted on Z_a x Z_b."""
    def turn(s: Column, i: Column) -> Column:
        x, y = s["x"], s["y"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(x + F.pmod(_hash(key, tweak, i, y), a), a)).otherwise(x).alias("x"),
            F.when(even, y).otherwise(F.pmod(y + F.pmod(_hash(key, tweak, i, x), b), b)).alias("y"))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(base: int, n: Column) -> Column:
    """base ** n as a long, n <= 12 for base 26 and <= 18 for base 10."""
    most = 12 if base == 26 else 18
    table = F.array(*[F.lit(base ** i) for i in range(most + 1)])
    return F.get(table.cast("array<long>"), n)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permute_digits(d: Column, key: str, kind: str) -> Column:
    """Digits of the same length (1 to 36), permuted."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    x = F.concat(F.lit("0"), F.substring(d, F.lit(1), h)).cast("long")
    y = F.substring(d, h + 1, n - h).cast("long")
    tweak = F.concat(F.lit(kind + "|"), n.cast("string"))
    return _let(feistel(x, y, _power(10, h), _power(10, n - h), key, tweak), lambda s: F.concat(
        F.substring(F.lpad(s["x"].cast("string"), h, "0"), F.lit(1), h),
        F.lpad(s["y"].cast("string"), n - h, "0")))


def _letters(s: Column, key: str, kind: str) -> Column:
    """Lower-case letters of the same length, permuted in chunks of 12."""
    abc, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"

    def chunk(c: Column, i: Column) -> Column:
        n = F.length(c)
        h = F.floor(n / 2).cast("int")
        code = F.translate(c, abc, digits)
        x = F.conv(F.concat(F.lit("0"), F.substring(code, F.lit(1), h)), 26, 10).cast("long")
        y = F.conv(F.substring(code, h + 1, n - h), 26, 10).cast("long")
        tweak = F.concat_ws("|", F.lit(kind), F.length(s).cast("string"), i.cast("string"))

        def text(v: Column, n: Column) -> Column:
            return F.lpad(F.lower(F.conv(v.cast("string"), 10, 26)), n, "0")
        both = _let(feistel(x, y, _power(26, h), _power(26, n - h), key, tweak),
                    lambda r: F.concat(F.substring(text(r["x"], h), F.lit(1), h), text(r["y"], n - h)))
        return F.translate(both, digits, abc)
    chunks = F.regexp_extract_all(s, F.lit("[a-z]{1,12}"), F.lit(0))
    return F.array_join(F.transform(chunks, chunk), "")


def _fill(template: Column, digits: Column, letters: Column) -> Column:
    """``template`` with its digits and ASCII letters replaced in order; a letter keeps its case."""
    def step(s: Column, c: Column) -> Column:
        digit, letter = c.rlike("^[0-9]$"), c.rlike("^[A-Za-z]$")
        new = F.substring(letters, s["l"], F.lit(1))
        put = (F.when(digit, F.substring(digits, s["d"], F.lit(1)))
               .when(letter, F.when(c.rlike("^[A-Z]$"), F.upper(new)).otherwise(new)).otherwise(c))
        return F.struct(F.concat(s["out"], put).alias("out"),
                        (s["d"] + digit.cast("int")).alias("d"),
                        (s["l"] + letter.cast("int")).alias("l"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("d"), F.lit(1).alias("l"))
    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    each = F.transform(F.reverse(F.split(d, "")), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(body, lambda b: F.concat(b, F.pmod(
            -luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return _fill(m, _let(_digits(m), swap), F.lit(""))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    k = F.greatest(F.least(F.lit(10), n - m.startswith("+").cast("int")), n - 3)
    last = permute_digits(F.substring(d, n - k + 1, k), key, "phone")
    return _fill(m, F.concat(F.substring(d, F.lit(1), n - k), last), F.lit(""))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    x = area - 1 - (area > 666).cast("int")
    y = (group - 1) * 9999 + serial - 1

    def text(s: Column) -> Column:
        a = s["x"] + 1
        return F.concat(F.lpad((a + (a >= 666).cast("int")).cast("string"), 3, "0"), F.lit("-"),
                        F.lpad((F.floor(s["y"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"),
                        F.lpad((s["y"] % 9999 + 1).cast("string"), 4, "0"))
    return _let(feistel(x, y, F.lit(898), F.lit(989_901), key, F.lit("ssn")), text)


def _ip(m: Column, key: str) -> Column:
    o = [F.get(F.split(m, r"\."), F.lit(i)).cast("int") for i in range(4)]
    both = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return _let(both, lambda s: F.concat_ws(
        ".", *[f(s[v]).cast("string") for v in "xy"
               for f in (lambda n: F.floor(n / 256), lambda n: n % 256)]))


DATES = {"yyyy-MM-dd": "-", "dd.MM.yyyy": ".", "MM/dd/yyyy": "/", "dd/MM/yyyy": "/",
         "yyyy-M-d": "-", "d.M.yyyy": ".", "M/d/yyyy": "/", "d/M/yyyy": "/",
         "yyyy/MM/dd": "/", "yyyy/M/d": "/"}


def _first_valid(m: Column) -> Column:
    """struct(f, day) of the first format that a date is valid in."""
    return F.coalesce(*[F.when(m.contains(mark) & _day(m, f).between(0, DAYS - 1), F.struct(
        F.lit(f).alias("f"), _day(m, f).alias("day"))) for f, mark in DATES.items()])


def _day(m: Column, fmt: str) -> Column:
    return F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(fmt))), F.lit(FIRST_DAY).cast("date"))


def _date(m: Column, key: str) -> Column:
    def swap(v: Column) -> Column:
        both = feistel(F.floor(v["day"] / 5411), v["day"] % 5411, F.lit(27), F.lit(5411), key,
                       F.lit("date"))
        new = _let(both, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"),
                                              (s["x"] * 5411 + s["y"]).cast("int")))
        return _let(new, lambda d: F.coalesce(*[F.when(v["f"] == f, F.date_format(d, f))
                                                for f in DATES]))
    return _let(_first_valid(m), swap)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    digits = F.regexp_replace(local, "[^0-9]", "")
    letters = F.lower(F.regexp_replace(local, "[^A-Za-z]", ""))
    parts = F.regexp_extract_all(digits, F.lit("[0-9]{1,18}"), F.lit(0))
    new = F.array_join(F.transform(parts, lambda d: permute_digits(d, key, "email")), "")
    return F.concat(_fill(local, new, _letters(letters, key, "email")),
                    F.substring(m, F.length(local) + 1, F.length(m)))


def kind(m: Column) -> Column:
    """The format a matched string is valid in, else null."""
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    area, group, serial = (F.substring(m, a, n) for a, n in ((1, 3), (5, 2), (8, 4)))
    whole = {k: m.rlike(f"^(?:{FORMAT[k]})$") for k in KINDS}
    return (F.when(whole["email"], F.when(F.length(m) <= 254, F.lit("email")))
            .when(whole["phone"], F.lit("phone"))
            .when(whole["date"], F.when(_first_valid(m).isNotNull(), F.lit("date")))
            .when(whole["ssn"], F.when((area != "000") & (area != "666") & (area < "900")
                                       & (group != "00") & (serial != "0000"), F.lit("ssn")))
            .when(whole["ip"], F.when(octets, F.lit("ip")))
            .when(whole["card"], F.when(luhn_sum(_digits(m)) % 10 == 0, F.lit("card"))))


def pseudonym(m: Column, k: Column, key: str) -> Column:
    """The pseudonym of a match of kind ``k``; the match itself where the kind is null."""
    makers = {"card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "email": _email}
    out = None
    for name, make in makers.items():
        new = make(m, key)
        out = F.when(k == name, new) if out is None else out.when(k == name, new)
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text`` (pseudonymised), ``n_values`` and ``n_<kind>``.

    A null text stays null with no values, an empty one empty; null ids are kept; repeated rows
    give equal rows; other columns are not read. An empty table gives an empty result.
    """
    text = docs[text_col]
    found = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"),
                        F.coalesce(_cut(text), F.array().cast("array<string>")).alias("c"))
    found = found.select("doc_id", "text", F.filter("c", lambda x, i: i % 2 == 1).alias("m"),
                         F.filter("c", lambda x, i: i % 2 == 0).alias("b"))
    valid = found.withColumn("v", F.transform("m", lambda m: F.struct(m.alias("m"), kind(m).alias("k"))))
    made = F.transform("v", lambda v: pseudonym(v["m"], v["k"], key))
    joined = F.array_join(F.zip_with(F.col("b"), F.concat(F.col("w"), F.array(F.lit(""))),
                                     lambda a, b: F.concat(a, b)), "")
    count = {k: _count(k) for k in KINDS}
    return (valid.withColumn("w", F.when(F.size("m") > 0, made).otherwise(F.col("m")))
            .select("doc_id", F.when(F.size("m") > 0, joined).otherwise(F.col("text")).alias("text"),
                    sum((count[k] for k in KINDS), F.lit(0)).alias("n_values"),
                    *[count[k].alias(f"n_{k}") for k in KINDS]))


OPEN, CLOSE = "\ufdd0", "\ufdd1"       # code points that are no characters, as marks


def _cut(text: Column) -> Column:
    """The text in parts; every second one is a match of the pattern. A text that holds one of the
    marks takes two passes of the pattern instead."""
    marked = F.regexp_replace(text, f"(?:{ANY})", OPEN + "$0" + CLOSE)
    found, between = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    both = F.zip_with(between, found, lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(f"[{OPEN}{CLOSE}]"), F.slice(F.flatten(both), F.lit(1), 2 * F.size(found) + 1)
                  ).otherwise(F.split(marked, f"[{OPEN}{CLOSE}]", -1))


def _count(k: str) -> Column:
    return F.size(F.filter("v", lambda v: v["k"] == k))

"""Format-preserving pseudonyms for personal numbers, dates and addresses by keyed Feistel networks.

Values are found by one pattern, checked (Luhn digit, mod 97, octets, calendar, number ranges)
and permuted within their format: a card number becomes another valid card number, a date
another date. The permutation depends on the key, the kind and the value alone, so equal values get equal
pseudonyms in all documents, different values of a format different ones, and whoever has the key can
undo it. All of it is column expressions: rounds are ``aggregate`` steps, no row moves.
"""

from __future__ import annotations

import hashlib
from calendar import isleap, monthrange

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specula.llm.bpe import _q

# Formats and ranges of the kinds, as published for each of them.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: lengths of the IBAN registry; a number printed in groups ends where its country says
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
                23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
                29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
GROUPED = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
SSN = r"(?<![\p{L}\p{N}-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\p{L}\p{N}]|-\d)"
YEAR = r"(?:1[89]|2[01])\d{2}"
#: year first with hyphens or slashes, day first with dots, month or day first with slashes
DATE = rf"(?<![\p{{L}}\p{{N}}./-])(?:{YEAR}-\d{{2}}-\d{{2}}|{YEAR}/\d{{2}}/\d{{2}}|\d{{2}}\.\d{{2}}\.{YEAR}|\d{{2}}/\d{{2}}/{YEAR})(?![\p{{L}}\p{{N}}]|[./-]\d)"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.\d)"
HEX4 = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}})(?![\p{{L}}\p{{N}}]|:[0-9A-Fa-f:])"
PHONE_STEP = r"(?:[ .-]|[ .-]?\(|\)[ .-]?)?\d"
FORMATS = {
    # no group is repeated without bound anywhere: each turn of such a loop takes a frame of the matcher's stack. Domains have 253 characters at most
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}-])[\p{L}\p{N}.-]{1,253}(?<=[\p{L}\p{N}-]\.\p{L}{2,63})",
    "secret": r"(?<=(?i:token|secret|key|password) ?[=:] ?[\"']?)[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z]{{2}}\d{{2}})(?:{GROUPED}|[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}+)(?![\p{{L}}\p{{N}}])",
    # in the usual three groups, in pairs, and in any groups: to the end of the digits if these are 15 at most, else up to 12 digits
    "phone": r"(?<![\p{L}\p{N}+])\+(?:\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
             r"|\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}(?:[ .-]\d{2}){3,4}(?!\d)"
             rf"|\d(?:{PHONE_STEP}){{7,14}}+(?![ .-]?\d)|\d(?:{PHONE_STEP}){{7,11}}(?!\d))",
    # three, three and four digits without a country
    "national": r"(?<![\p{L}\p{N}.+-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-.])[2-9]\d{2}[-.]\d{4}(?![\p{L}\p{N}]|[-.]\d)",
    "ip": IP, "ip6": IP6, "ssn": SSN, "date": DATE,
    # a whole run of digits, up to a value of another kind; the numbers in it are looked for by their check digits
    "card": rf"(?<![\p{{L}}\p{{N}}.-])(?=\d(?:[ -]?\d){{12}})(?!\d{{20}})\d++(?![\p{{L}}\p{{N}}])(?:[ -](?!{DATE}|{SSN}|{IP}|{IP6})\d++(?![\p{{L}}\p{{N}}]))*+",
}
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: 1800-01-01 to 2199-12-31 are 400 years of 146,097 = 27 * 5,411 days
DAY_ZERO, DAYS = "1800-01-01", (27, 5411)


def _subkey(key: str, kind: str) -> str:
    """What stands in the plan instead of the key; the key does not follow from it."""
    return hashlib.sha256(f"{kind}|{key}|{kind}".encode()).hexdigest()


def _draw(key: str, kind: str, turn: Column, value: Column) -> Column:
    """64 hexadecimal digits that depend on all arguments."""
    own = _subkey(key, kind)
    return F.sha2(F.concat(F.lit(f"{own[:32]}|"), turn.cast("string"), F.lit("|"), value, F.lit(f"|{own[32:]}")), 256)


def _number(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 15), 16, 10).cast("bigint")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shift(text: Column, draw: Column, alphabets: list[str]) -> Column:
    """Each character moves on within its alphabet; characters of none stay."""
    def moved(c: Column, i: Column) -> Column:
        step = F.conv(F.substring(draw, (F.pmod(i, F.lit(16)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
        out = c
        for a in reversed(alphabets):
            at = F.instr(F.lit(a), c)
            out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + step, F.lit(len(a))) + 1, F.lit(1))).otherwise(out)
        return out
    return F.array_join(F.transform(_chars(text), moved), "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_text(value: Column, key: str, kind: str, alphabets: list[str], rounds: int = 8) -> Column:
    """A permutation of the strings that have the same alphabet at each place. Draws ignore case, so it does too."""
    half = (F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(2 * ((rounds + 1) // 2))), start, lambda s, r: F.struct(
        s["b"].alias("a"), _bound(_draw(key, kind, r, F.lower(s["b"])), lambda draw: _shift(s["a"], draw, alphabets)).alias("b")))
    return F.concat(done["a"], done["b"])


def permute_number(left: Column, right: Column, a: int, b: int, key: str, kind: str, rounds: int = 10) -> tuple[Column, Column]:
    """A permutation of the pairs with 0 <= left < a and 0 <= right < b."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, k: F.struct(
        F.when(k % 2 == 1, F.pmod(s["l"] + _number(_draw(key, kind, k, s["r"].cast("string"))), F.lit(a))).otherwise(s["l"]).alias("l"),
        F.when(k % 2 == 0, F.pmod(s["r"] + _number(_draw(key, kind, k, s["l"].cast("string"))), F.lit(b))).otherwise(s["r"]).alias("r")))
    return done["l"], done["r"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _laid_out(text: Column, digits: Column, places: str = DIGITS) -> Column:
    """``digits`` in the places that the digits (or the characters of ``places``) of ``text`` have."""
    done = F.aggregate(_chars(text), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), lambda s, c: F.when(
        F.instr(F.lit(places), c) > 0, F.struct(F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))))
    return done["out"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum with the last digit counted once."""
    return F.aggregate(F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int"))
                                   .otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))), F.lit(0), lambda n, d: n + d)


def mod97(iban: Column) -> Column:
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    def step(n: Column, c: Column) -> Column:
        at = F.instr(F.lit(UPPER), c)
        return F.when(at > 0, (n * 100 + at + 9) % 97).otherwise((n * 10 + c.cast("int")) % 97)
    return F.aggregate(_chars(moved), F.lit(0), step)


#: groups of digits as cards have them
CARD = r"^(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}(?: \d{1,3})?|\d{4} \d{6} \d{4,5}|\d{4} \d{4} \d{4} \d|\d{4} \d{4} \d{5})$"


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", [DIGITS])
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return _bound(F.concat(body, check), lambda made: _laid_out(m, made))


def _cards(m: Column, key: str) -> Column:
    """(new, n): the run ``m`` with the card numbers in it replaced, and how many these are.

    A number is any sequence of whole groups of the run with 13 to 19 digits and a valid check digit. Numbers are taken
    from left to right. Of those that begin with the same group, groups as cards have them come first, the shortest of
    them, then the longest of the others; others that run into a number grouped like a card give way to it.
    """
    def spans(g: Column) -> Column:
        """(a, b) for each group: how many groups a number has that begins there, grouped like a card or in another way; 0 for none."""
        def at(i: Column) -> Column:
            def candidate(k: Column) -> Column:
                part = F.slice(g, i, k)
                joined = F.array_join(part, "")
                fits = joined.rlike(r"^\d{13,19}$") & (luhn_sum(joined) % 10 == 0)
                return F.when(joined.rlike(r"^\d{13,19}$"), F.when(fits, F.when(F.array_join(part, " ").rlike(CARD), k).otherwise(-k)))
            most = F.least(F.lit(19), F.size(g) - i + 1)
            good = F.filter(F.transform(F.sequence(F.lit(1), most), candidate), lambda k: k.isNotNull())
            return _bound(good, lambda ks: F.struct(F.coalesce(F.array_min(F.filter(ks, lambda k: k > 0)), F.lit(0)).alias("a"),
                                                    F.coalesce(-F.array_min(F.filter(ks, lambda k: k < 0)), F.lit(0)).alias("b")))
        return F.transform(F.sequence(F.lit(1), F.size(g)), at)

    def chosen(s: Column) -> Column:
        """For each group how many groups its number has, 0 for none, -1 within a number. Kept in blocks, so that long runs are not copied at every step."""
        found = s["found"]

        def step(state: Column, i: Column) -> Column:
            here = F.element_at(found, i)
            clear = ~F.exists(F.slice(found, i + 1, F.greatest(here["b"] - 1, F.lit(0))), lambda x: x["a"] > 0)
            span = F.when(state["skip"] > 0, -1).when(here["a"] > 0, here["a"]).when((here["b"] > 0) & clear, here["b"]).otherwise(0)
            full = F.size(state["block"]) >= 256
            return _bound(span, lambda k: F.struct(
                F.when(full, F.concat(state["blocks"], F.array(state["block"]))).otherwise(state["blocks"]).alias("blocks"),
                F.when(full, F.array(k)).otherwise(F.concat(state["block"], F.array(k))).alias("block"),
                F.when(k > 0, k - 1).otherwise(F.greatest(state["skip"] - 1, F.lit(0))).alias("skip")))
        none = F.array().cast("array<int>")
        start = F.struct(F.array().cast("array<array<int>>").alias("blocks"), none.alias("block"), F.lit(0).alias("skip"))
        return F.aggregate(F.sequence(F.lit(1), F.size(s["g"])), start, step, lambda x: F.flatten(F.concat(x["blocks"], F.array(x["block"]))))

    def written(s: Column) -> Column:
        g, gaps = s["g"], s["gaps"]

        def part(k: Column, i: Column) -> Column:
            more = F.zip_with(F.slice(gaps, i + 2, F.greatest(k - 1, F.lit(0))), F.slice(g, i + 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.concat(a, b))
            return F.when(k < 0, "").when(k == 0, F.concat(F.element_at(gaps, i + 1), F.element_at(g, i + 1))).otherwise(
                F.concat(F.element_at(gaps, i + 1), _bound(F.concat(F.element_at(g, i + 1), F.array_join(more, "")), lambda number: _card(number, key))))
        return F.struct(F.array_join(F.transform(s["chosen"], part), "").alias("new"), F.size(F.filter(s["chosen"], lambda k: k > 0)).alias("n"))
    # the gap before each group, and groups between gaps
    return _bound(F.split(m, "[ -]"), lambda g: _bound(F.struct(g.alias("g"), spans(g).alias("found")), lambda s: _bound(F.struct(
        s["g"].alias("g"), F.split(m, "[^ -]+", -1).alias("gaps"), chosen(s).alias("chosen")), written)))


def _iban(m: Column, key: str) -> Column:
    """(new, n): what is no IBAN may still hold a card number."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    body = permute_text(F.substring(plain, F.lit(5), F.length(plain)), key, "iban", [DIGITS, UPPER])
    check = F.lit(98) - mod97(F.concat(F.substring(plain, 1, 2), F.lit("00"), body))
    made = F.concat(F.substring(plain, 1, 2), F.lpad(check.cast("string"), 2, "0"), body)
    return F.when(mod97(plain) == 1, F.struct(_bound(made, lambda x: _laid_out(m, x, DIGITS + UPPER)).alias("new"), F.lit(1).alias("n"))).otherwise(_cards(m, key))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, _laid_out(rest, permute_text(_digits(rest), key, "phone", [DIGITS])))


def _ip(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i + 1)).cast("int") for i in range(4)]
    both = F.struct(*(x.alias(n) for n, x in zip("lr", permute_number(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip"))))
    return F.element_at(F.transform(F.array(both), lambda s: F.concat_ws(".", *(F.floor(x / d).cast("bigint").cast("string") if d > 1 else (x % 256).cast("string")
                                                                              for x in (s["l"], s["r"]) for d in (256, 1)))), 1)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i + 1)).cast("int") for i in range(3))
    left, right = permute_number(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    both = F.struct((left + F.when(left >= 665, 2).otherwise(1)).alias("l"), right.alias("r"))
    pad = lambda x, n: F.lpad(x.cast("bigint").cast("string"), n, "0")
    return F.element_at(F.transform(F.array(both), lambda s: F.concat_ws("-", pad(s["l"], 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4))), 1)


def _ip6(m: Column, key: str) -> Column:
    """Eight groups, or fewer with two colons; names with colons in them have no digit."""
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    fits = m.rlike(r"\d") & F.when(m.contains("::"), (groups <= 7) & (groups >= 2)).otherwise(groups == 8)
    return F.when(fits, permute_text(m, key, "ip6", [DIGITS + LOWER[:6], UPPER[:6]])).otherwise(m)


#: the days after the 12th of a month that every year has, and the leap years: places in these texts are numbers
LATE_DAYS = ",".join(f"{d:02d}/{m:02d}" for m in range(1, 13) for d in range(13, monthrange(1999, m)[1] + 1))
LEAP_YEARS = ",".join(str(y) for y in range(1800, 2200) if isleap(y))


def _date(m: Column, key: str) -> Column:
    """A date of the same layout. With slashes the month comes first unless the first number is above 12; such dates are permuted among themselves."""
    year_first, part = m.rlike(r"^\d{4}"), lambda i, n: F.substring(m, i, n)
    day_first = m.contains(".")
    late = m.contains("/") & ~year_first & (part(1, 2).cast("int") > 12)
    plain = F.when(year_first, F.concat_ws("-", part(1, 4), part(6, 2), part(9, 2))).when(day_first, F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))).otherwise(
        F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))
    day = F.datediff(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")).cast("date"), F.lit(DAY_ZERO).cast("date"))
    left, right = permute_number(F.floor(day / DAYS[1]), day % DAYS[1], *DAYS, key, "date")
    made = F.date_add(F.lit(DAY_ZERO).cast("date"), (left * DAYS[1] + right).cast("int"))
    usual = F.when(day.isNull(), m).otherwise(F.when(year_first, F.date_format(made, "yyyy-MM-dd")).when(day_first, F.date_format(made, "dd.MM.yyyy")).otherwise(F.date_format(made, "MM/dd/yyyy")))
    usual = F.when(year_first & m.contains("/"), F.translate(usual, "-", "/")).otherwise(usual)
    at = F.instr(F.lit(LATE_DAYS), part(1, 5))
    year, slot = permute_number(part(7, 4).cast("int") - 1800, F.floor((at - 1) / 6), 400, (len(LATE_DAYS) + 1) // 6, key, "late date")
    both = F.struct(year.alias("l"), slot.alias("r"))
    moved = _bound(both, lambda s: F.concat(F.substring(F.lit(LATE_DAYS), (s["r"] * 6 + 1).cast("int"), F.lit(5)), F.lit("/"), (s["l"] + 1800).cast("string")))
    leap = F.instr(F.lit(LEAP_YEARS), part(7, 4))
    other, _ = permute_number(F.floor((leap - 1) / 5), F.lit(0), (len(LEAP_YEARS) + 1) // 5, 1, key, "leap day")
    leap_day = F.concat(F.lit("29/02/"), F.substring(F.lit(LEAP_YEARS), (other * 5 + 1).cast("int"), F.lit(4)))
    return F.when(~late, usual).when(at > 0, moved).when((part(1, 5) == "29/02") & (leap > 0), leap_day).otherwise(m)


CHANGES = {
    "email": lambda m, key: permute_text(m, key, "email", [DIGITS, LOWER, UPPER, ACCENTED]),
    "secret": lambda m, key: permute_text(m, key, "secret", [DIGITS + LOWER[:6], UPPER[:6]]),
    "national": lambda m, key: permute_text(m, key, "national", ["01", DIGITS[2:]]),
    "iban": _iban, "phone": _phone, "ip": _ip, "ip6": _ip6, "ssn": _ssn, "date": _date, "card": _cards,
}


def pseudonymise(df: DataFrame, text: str, key: str, into: str | None = None, found: str | None = None) -> DataFrame:
    """``df`` with the values in column ``text`` replaced by pseudonyms (in column ``into`` if given).

    ``found``, if given, is a column with the number of values replaced. Text around values, values that fail
    their check and null or empty texts stay as they are (found: 0). Repeated rows give repeated
    results, other columns are kept whatever their names, and an empty table gives an empty one.
    """
    t = _q(text)
    pattern = "|".join(FORMATS.values())
    matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

    def changed(m: Column) -> Column:
        out = F.struct(m.alias("new"), F.lit(0).alias("n"))
        # a value's kind shows in itself: the look-around parts of the formats only concern its neighbours
        for kind, test in (("card", F.lit(True)), ("date", m.rlike(r"^(?:\d{4}[/-]\d{2}[/-]\d{2}|\d{2}[./]\d{2}[./]\d{4})$")), ("ssn", m.rlike(r"^\d{3}-\d{2}-\d{4}$")),
                           ("ip", m.rlike(r"^\d+\.\d+\.\d+\.\d+$")), ("ip6", m.contains(":")), ("national", m.rlike(r"^\(?\d{3}(?:\) ?|[-.])\d{3}[-.]\d{4}$")), ("phone", m.startswith("+")), ("iban", m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,}$")),
                           ("secret", m.rlike("^[0-9A-Fa-f]{32,}$")), ("email", m.contains("@"))):
            new = CHANGES[kind](m, key)
            out = F.when(test, new if kind in ("card", "iban") else F.struct(new.alias("new"), F.lit(1).alias("n"))).otherwise(out)
        return out
    # every kind has a digit or an at sign: texts without either are passed through
    pieces = F.split(t, pattern, -1)
    pairs = F.transform(matches, lambda m: F.struct(m.alias("old"), changed(m).alias("made")))
    made = df.withColumn("__pairs", F.when(t.rlike(r"[@\d]"), pairs))
    joined = F.array_join(F.zip_with(pieces, F.transform("__pairs", lambda p: p["made"]["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    if found:
        made = made.withColumn(found, F.coalesce(F.aggregate("__pairs", F.lit(0), lambda n, p: n + F.when(p["old"] != p["made"]["new"], p["made"]["n"]).otherwise(0)), F.lit(0)))
    return made.withColumn(into or text, F.when(F.size("__pairs") > 0, joined).otherwise(t)).drop("__pairs")

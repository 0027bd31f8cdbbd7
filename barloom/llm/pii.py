"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Values are found by pattern and validated (check digits, octets, calendar), then permuted by a keyed Feistel network
within their own format: a card number stays a valid card number, a date a valid date of the same form. Equal
values get equal pseudonyms in every document, so they stay linked; different values of a format stay different.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of the 400 years from 1800-01-01 on, 146097 = 189 * 773, the two radices of dates.
FIRST_DAY, DAY_RADICES = "1800-01-01", (189, 773)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Name, pattern, and what must stand around it.
KINDS = {
    "email": (r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}+", r"(?<![A-Za-z0-9._%+-])", r"(?![A-Za-z0-9@])"),
    "access_key": (r"AKIA[A-Z0-9]{16}", r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"),
    "secret": (r"(?i:password|passwd|token|secret|key) ?= ?\"?[0-9a-fA-F]{16,}+", r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"),
    "date": (r"(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})", r"(?<![\d./-])", r"(?![./-]?\d)"),
    "ssn": (r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", r"(?<![\d-])", r"(?![\d-])"),
    "ip": (rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"(?<![\d.])", r"(?!\.?\d)"),
    "phone": (r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", r"(?<![\w+.-])", r"(?![.-]?\d)"),
}
#: Cards are looked for in whole runs of digit groups, because a neighbouring number may belong to the run; a run ends before a value of another kind.
_OTHERS = "|".join("".join((KINDS[k][1], KINDS[k][0], KINDS[k][2])) for k in ("date", "ssn", "ip", "phone"))
KINDS["card"] = (rf"(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{_OTHERS})\d++)*+", r"(?<!\d)", "")
#: Groups as cards are written: one number, fours with a shorter end, 4-6-5 and 4-6-4; how many groups, in order of preference.
CARD_FORM = r"^[ -]?(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,4}|\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}|\d{4}[ -]\d{6}[ -]\d{4,5})$"
CARD_SIZES = (1, 4, 3, 5)
ANY = "|".join(f"{before}{pattern}{after}" for pattern, before, after in KINDS.values())


def digest(key: str, tag: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), value.cast("string")), 256)


def number_feistel(left: Column, right: Column, a: int | Column, b: int | Column, key: str, tag: str) -> Column:
    """Struct (l, r): a keyed permutation of the pairs below the radices a and b."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def drawn(turn: Column, value: Column) -> Column:
        return F.conv(F.substring(digest(key, tag, turn, value), 1, 15), 16, 10).cast("long")

    def turned(have: Column, turn: Column) -> Column:
        odd = turn % 2 == 1
        return F.struct(F.when(odd, F.pmod(have["l"] + F.pmod(drawn(turn, have["r"]), a), a)).otherwise(have["l"]).alias("l"),
                        F.when(odd, have["r"]).otherwise(F.pmod(have["r"] + F.pmod(drawn(turn, have["l"]), b), b)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turned)


def text_feistel(value: Column, key: str, tag: str, letters: int = 26) -> Column:
    """A keyed permutation of strings of the same shape: digits stay digits, letters letters of their case."""

    def shifted(text: Column, stream: Column) -> Column:
        def one(char: Column, place: Column) -> Column:
            by = F.conv(F.substr(stream, 1 + 2 * (place % 32), F.lit(2)), 16, 10).cast("int")
            code = F.ascii(char)

            def turn(base: int, size: int) -> Column:
                return F.char(F.lit(base) + F.pmod(code - base + by, F.lit(size)))

            return (F.when(char.rlike("^[0-9]$"), turn(48, 10)).when(char.rlike("^[a-z]$"), turn(97, letters))
                    .when(char.rlike("^[A-Z]$"), turn(65, letters)).otherwise(char))

        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")

    def turned(have: Column, turn: Column) -> Column:
        odd = turn % 2 == 1
        return F.struct(F.when(odd, shifted(have["l"], digest(key, tag, turn, have["r"]))).otherwise(have["l"]).alias("l"),
                        F.when(odd, have["r"]).otherwise(shifted(have["r"], digest(key, tag, turn, have["l"]))).alias("r"))

    half = F.floor(F.length(value) / 2).cast("int")
    pair = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1).alias("r"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, turned)
    return F.concat(out["l"], out["r"])


def luhn_sum(digits: Column) -> Column:
    """Sum of digits with every second one, from the one beside the check digit on, doubled; ``digits`` without the check digit."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit(r"\d"), F.lit(0)), lambda c, k: (
        F.when(k % 2 == 1, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))))
    return F.aggregate(each, F.lit(0), lambda x, y: x + y)


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in turn."""
    chars = F.regexp_extract_all(shape, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    return F.aggregate(chars, start, lambda have, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(have["text"], F.substr(digits, have["at"], F.lit(1))).alias("text"), (have["at"] + 1).alias("at")))
                       .otherwise(F.struct(F.concat(have["text"], c).alias("text"), have["at"].alias("at"))))["text"]


def luhn_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[ -]", "")
    return (luhn_sum(F.substr(digits, F.lit(1), F.length(digits) - 1)) + F.substr(digits, F.length(digits)).cast("int")) % 10 == 0


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _card(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, r"[ -]", "")
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    n, m = F.floor(F.length(body) / 2).cast("int"), F.ceil(F.length(body) / 2).cast("int")
    fresh = number_feistel(F.substr(body, F.lit(1), n), F.substr(body, n + 1), F.pow(F.lit(10), n).cast("long"), F.pow(F.lit(10), m).cast("long"), key, "card")
    new = F.concat(F.lpad(fresh["l"].cast("string"), n, F.lit("0")), F.lpad(fresh["r"].cast("string"), m, F.lit("0")))
    return refilled(value, F.concat(new, F.pmod(-luhn_sum(new), F.lit(10)).cast("string")))


def _cards(run: Column, key: str) -> Column:
    """Struct (text, n): a run of digit groups with its n valid cards replaced, null without any.

    Groups that have the form of a card are taken from the left; a run without such a card is tried as one number in a form of its own.
    """

    def replaced(groups: Column) -> Column:
        def piece(at: Column, size: Column) -> Column:
            return F.array_join(F.slice(groups, at, size), "")

        def step(have: Column, at: Column) -> Column:
            fits = F.filter(F.array(*map(F.lit, CARD_SIZES)), lambda k: piece(at, k).rlike(CARD_FORM) & luhn_valid(piece(at, k)))
            grown = once(F.coalesce(F.get(fits, F.lit(0)), F.lit(0)), lambda k: F.when(k > 0, F.struct(
                F.concat(have["text"], once(piece(at, k), lambda v: _card(v, key))).alias("text"), (have["n"] + 1).alias("n"), (at + k).alias("next")))
                .otherwise(F.struct(F.concat(have["text"], F.get(groups, at - 1)).alias("text"), have["n"].alias("n"), (at + 1).alias("next"))))
            return F.when(at < have["next"], have).otherwise(grown)

        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(1).alias("next"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step)

    formed = once(F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0)), replaced)
    whole = F.length(F.regexp_replace(run, r"[ -]", "")).between(13, 19) & luhn_valid(run)
    return once(formed, lambda r: F.when(r["n"] > 0, F.struct(r["text"].alias("text"), r["n"].alias("n")))
                .when(whole, F.struct(_card(run, key).alias("text"), F.lit(1).alias("n"))))


def _date(value: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for form in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy"):
        day = F.datediff(F.try_to_date(value, form), F.lit(FIRST_DAY).cast("date"))
        a, b = DAY_RADICES
        fresh = number_feistel(F.floor(day / b), day % b, a, b, key, f"date {form}")
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (fresh["l"] * b + fresh["r"]).cast("int")), form)
        out = F.coalesce(out, F.when(day.between(0, a * b - 1), new))
    return out


def _ip(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.")
    fresh = number_feistel(octets[0].cast("long") * 256 + octets[1].cast("long"), octets[2].cast("long") * 256 + octets[3].cast("long"), 65536, 65536, key, "ip")
    return F.concat_ws(".", *[F.floor(fresh[s] / 256).cast("string") if high else (fresh[s] % 256).cast("string") for s in "lr" for high in (True, False)])


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.split(value, "-")[k].cast("long") for k in range(3))
    place = area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))
    fresh = number_feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    new = F.floor(fresh["l"] / 99) + 1
    new = F.when(new >= 666, new + 1).otherwise(new)
    return F.format_string("%03d-%02d-%04d", new, fresh["l"] % 99 + 1, fresh["r"] + 1)


def _phone(value: Column, key: str) -> Column:
    # the country code and the first digits of area and exchange belong to the format
    front = F.regexp_extract(value, r"^(?:\+\d{1,3}[ .-]?)?(?=\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}$)", 0)
    rest = F.regexp_replace(F.substr(value, F.length(front) + 1), r"\D", "")
    cut = F.concat(F.substr(rest, F.lit(2), F.lit(2)), F.substr(rest, F.lit(5), F.lit(2)))
    fresh = number_feistel(cut, F.substr(rest, F.lit(7)), 10_000, 10_000, key, "phone")
    left, right = (F.lpad(fresh[s].cast("string"), 4, "0") for s in "lr")
    new = F.concat(F.substr(rest, F.lit(1), F.lit(1)), F.substr(left, F.lit(1), F.lit(2)), F.substr(rest, F.lit(4), F.lit(1)), F.substr(left, F.lit(3)), right)
    return F.concat(front, refilled(F.substr(value, F.length(front) + 1), new))


def _email(value: Column, key: str) -> Column:
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    name = F.substr(value, F.lit(1), F.length(value) - F.length(top))
    return F.concat(text_feistel(name, key, "email"), top)


PSEUDONYMS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone,
    "access_key": lambda v, key: F.concat(F.lit("AKIA"), text_feistel(F.substr(v, F.lit(5)), key, "access_key")),
    "secret": lambda v, key: F.concat(F.regexp_extract(v, "^[A-Za-z]+ ?= ?\"?", 0), text_feistel(F.regexp_extract(v, "[0-9a-fA-F]+$", 0), key, "secret", 6)),
}


def pseudonym(value: Column, key: str) -> Column:
    """Struct (kind, text, n): the first kind whose pattern and validation hold, and how many values; kind null and text unchanged if none does."""
    none = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"), F.lit(0).alias("n"))
    out = []
    for kind, make in PSEUDONYMS.items():
        new = make(value, key)
        out.append(F.when(value.rlike(f"^(?:{KINDS[kind][0]})$"), F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("text"), F.lit(1).alias("n")))))
    cards = F.when(value.rlike(f"^(?:{KINDS['card'][0]})$"), once(_cards(value, key), lambda c: F.when(c.isNotNull(), F.struct(F.lit("card").alias("kind"), c["text"].alias("text"), c["n"].alias("n")))))
    out.append(cards)
    return F.coalesce(*out, none)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced, and n_<kind> for each kind and n_found appended; columns of these names are replaced.

    ``key`` decides the permutation; equal keys give equal pseudonyms. A null text stays null with counts 0, an empty text is
    empty. Whole texts are searched. Numbers that match a pattern but fail its validation stay as they are. Rows are independent, so
    repeated rows and empty tables need no rule.
    """
    counts = [f"n_{k}" for k in KINDS]
    names = [c for c in docs.columns if c not in (*counts, "n_found")]
    source = docs.select(F.struct(*names).alias("row"), docs[text].cast("string").alias("text"))
    found = source.withColumn("found", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    fresh = found.withColumn("fresh", F.transform("found", lambda v: pseudonym(v, key)))
    joined = F.flatten(F.zip_with(F.split("text", ANY, -1), "fresh", lambda part, new: F.array(part, F.coalesce(new["text"], F.lit("")))))
    done = fresh.withColumn("done", F.when(F.size("found") > 0, F.array_join(joined, "")).otherwise(F.col("text")))
    kinds = [F.coalesce(F.aggregate("fresh", F.lit(0), lambda n, x: n + F.when(x["kind"] == k, x["n"]).otherwise(0)), F.lit(0)).alias(c)
             for k, c in zip(KINDS, counts, strict=True)]
    out = done.select(*[F.col("done").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names], *kinds)
    return out.withColumn("n_found", sum((F.col(c) for c in counts[1:]), F.col(counts[0])))

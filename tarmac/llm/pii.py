"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Found values are validated (Luhn sum, octets, numbering plans, calendar) and
replaced by another valid value of their format through a keyed Feistel network
over the format's own domain: two halves of sizes a and b take turns adding a
keyed hash of the other, modulo a or b. That is a permutation, so equal values
get equal pseudonyms in all documents and different values different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import quoted

ROUNDS = 8

EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"
#: A card's number among other digits (an expiry date, a check code, a count).
CARD_PART = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\d)"
PHONE = r"(?<![\w.-])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
SSN = r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
ISO_DATE = r"(?<![\w-])(?:19|20)\d\d-\d\d-\d\d(?![\w-])"
US_DATE = r"(?<![\w/])\d\d/\d\d/(?:19|20)\d\d(?![\w/])"
EU_DATE = r"(?<![\w.])\d\d\.\d\d\.(?:19|20)\d\d(?!\w|\.\d)"
#: The first character is tested before anything else: most positions fail there.
NUMERIC = "(?=[0-9+(])(?:" + "|".join([ISO_DATE, US_DATE, EU_DATE, PHONE, SSN, CARD, ADDRESS]) + ")"
ANY = f"{NUMERIC}|{EMAIL}"
#: Dates are permuted within 1900 to 2099, which has 17 x 4297 days.
DAYS = (17, 4297)
#: Letters beyond ASCII in mail names: Latin-1, Greek and Cyrillic, small and capital.
LETTERS = ["".join(chr(c) for c in range(low, high + 1) if c not in (0xD7, 0xF7, 0x3A2, 0x3C2)) for low, high in (
    (0xE0, 0xFE), (0xC0, 0xDE), (0x3B1, 0x3C9), (0x391, 0x3A9), (0x430, 0x44F), (0x410, 0x42F))]


def _round(key: str, tag: str, turn: Column, half: Column) -> Column:
    """Keyed 60-bit number."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, tag: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Permutation of [0, a) x [0, b) as a struct ``l``, ``r``."""

    def turn(s: Column, i: Column) -> Column:
        return _let(F.pmod(s["l"] + _round(key, tag, i, s["r"]), a), lambda new: F.struct(
            new.alias("l"), F.pmod(s["r"] + _round(key, tag, -i, new), b).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _number(text: Column, at, size) -> Column:
    return F.substr(text, _c(at), _c(size)).cast("long")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _pad(x: Column, size) -> Column:
    text = x.cast("string")
    return F.concat(F.repeat(F.lit("0"), (_c(size) - F.length(text)).cast("int")), text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("k"))

    def put(s: Column, ch: Column) -> Column:
        is_digit = ch.rlike(r"^\d$")
        return F.struct(F.concat(s["t"], F.when(is_digit, F.substr(digits, s["k"] + 1, F.lit(1))).otherwise(ch)).alias("t"),
                        (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), start, put)["t"]


def luhn_digit(body: Column) -> Column:
    """Check digit that completes ``body``."""
    size = F.length(body)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(body, size - i + 1, F.lit(1)).cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(10 - F.pmod(F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add), F.lit(10)), F.lit(10))


def _card(value: Column, key: str) -> Column:
    """The whole run of digits if it is a valid number, else the valid numbers in it."""
    def rebuilt(new: Column) -> Column:
        old = F.regexp_extract_all(value, F.lit(f"({CARD_PART})"), F.lit(0))
        filled = F.zip_with(old, new, lambda o, n: F.coalesce(n, o))
        joined = F.array_join(F.zip_with(F.split(value, CARD_PART, -1), filled,
                                         lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
        return F.when(F.exists(new, lambda n: n.isNotNull()), joined)

    parts = F.transform(F.regexp_extract_all(value, F.lit(f"({CARD_PART})"), F.lit(0)), lambda v: _card_number(v, key))
    return _let(_card_number(value, key), lambda whole: F.coalesce(whole, _let(parts, rebuilt)))


def _card_number(value: Column, key: str) -> Column:
    def size(k: Column) -> Column:
        return F.pow(F.lit(10.0), k).cast("long")

    def permuted(d: Column) -> Column:
        n = F.length(d) - 1
        body, u = F.substr(d, F.lit(1), n), F.floor(n / 2).cast("int")
        v = (n - u).cast("int")
        p = feistel(key, "card", _number(d, 1, u), _number(d, u + 1, v), size(u), size(v))
        new = _let(p, lambda x: F.concat(_pad(x["l"], u), _pad(x["r"], v)))
        whole = _let(new, lambda x: F.concat(x, luhn_digit(x).cast("string")))
        valid = luhn_digit(body).cast("string") == F.substr(d, n + 1, F.lit(1))
        return F.when(valid, _let(whole, lambda x: _refill(value, x)))

    return _let(_digits(value), permuted)


def _phone(value: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        extra = F.length(d) - 10
        local = F.substr(d, extra + 1, F.lit(10))
        p = feistel(key, "phone", _number(local, 1, 3) - 200, _number(local, 4, 7) - 2_000_000,
                    F.lit(800).cast("long"), F.lit(8_000_000).cast("long"))
        new = _let(p, lambda x: F.concat(F.substr(d, F.lit(1), extra), (x["l"] + 200).cast("string"),
                                         (x["r"] + 2_000_000).cast("string")))
        return F.when(local.rlike(r"^[2-9]\d\d[2-9]\d{6}$"), _let(new, lambda x: _refill(value, x)))

    return _let(_digits(value), permuted)


def _ssn(value: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        area, group, serial = _number(d, 1, 3), _number(d, 4, 2), _number(d, 6, 4)
        rank = area - 1 - F.when(area > 666, 1).otherwise(0)
        p = feistel(key, "ssn", rank, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"),
                    F.lit(99 * 9999).cast("long"))
        new = _let(p, lambda x: F.concat(
            _pad(x["l"] + 1 + F.when(x["l"] + 1 >= 666, 1).otherwise(0), 3),
            _pad(F.floor(x["r"] / 9999) + 1, 2), _pad(F.pmod(x["r"], F.lit(9999)) + 1, 4)))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        return F.when(valid, _let(new, lambda x: _refill(value, x)))

    return _let(_digits(value), permuted)


def _address(value: Column, key: str) -> Column:
    def permuted(o: Column) -> Column:
        two, low = F.lit(65536).cast("long"), F.lit(256)
        p = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], two, two)
        new = _let(p, lambda x: F.concat_ws(".", *[n.cast("string") for n in (
            F.floor(x["l"] / 256), F.pmod(x["l"], low), F.floor(x["r"] / 256), F.pmod(x["r"], low))]))
        return F.when(F.forall(o, lambda x: x < 256), new)

    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("long")), permuted)


def _date(value: Column, key: str, year: int, month: int, day: int, pattern: str) -> Column:
    first = F.lit("1900-01-01").cast("date")
    a, b = (F.lit(x).cast("long") for x in DAYS)

    def permuted(found: Column) -> Column:
        rank = F.datediff(found, first)
        p = feistel(key, "date", F.floor(rank / DAYS[1]), F.pmod(rank, F.lit(DAYS[1])), a, b)
        new = _let(p, lambda x: F.date_add(first, (x["l"] * DAYS[1] + x["r"]).cast("int")))
        return F.when(found.isNotNull(), F.date_format(new, pattern))

    iso = F.concat_ws("-", F.substring(value, year, 4), F.substring(value, month, 2), F.substring(value, day, 2))
    return _let(iso.try_cast("date"), permuted)


def _email(value: Column, key: str) -> Column:
    """The local part's letters and digits are shifted within their class by a
    keyed stream from the other half (a Feistel network over characters)."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    n = F.length(local)
    u = F.floor(n / 2).cast("int")

    def shifted(text: Column, other: Column, turn: Column) -> Column:
        # Letters that differ only in case are one address: the stream ignores case.
        keyed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), turn.cast("string"), F.lower(other)), 256)

        def moved(stream: Column) -> Column:
            def move(ch: Column, i: Column) -> Column:
                by = F.conv(F.substr(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                code = F.ascii(ch)

                def ring(low: int, size: int) -> Column:
                    return F.char(F.pmod(code - low + by, F.lit(size)) + low)

                out = (F.when(code.between(48, 57), ring(48, 10)).when(code.between(65, 90), ring(65, 26))
                       .when(code.between(97, 122), ring(97, 26)).when(code < 192, ch))
                for some in LETTERS:
                    at = F.instr(F.lit(some), ch)
                    out = out.when(at > 0, F.substr(F.lit(some), F.pmod(at - 1 + by, F.lit(len(some))) + 1, F.lit(1)))
                return out.otherwise(ch)

            return F.array_join(F.transform(F.split(text, ""), move), "")

        return _let(keyed, moved)

    def turn(s: Column, i: Column) -> Column:
        return _let(shifted(s["l"], s["r"], i), lambda new: F.struct(
            new.alias("l"), shifted(s["r"], new, -i).alias("r")))

    start = F.struct(F.substr(local, F.lit(1), u).alias("l"), F.substr(local, u + 1, n).alias("r"))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn)
    return _let(p, lambda x: F.concat(x["l"], x["r"], F.lit("@"), domain))


def pseudonym(value: Column, key: str) -> Column:
    """Pseudonym of one found value, or null if it is not valid."""
    whole = lambda pattern: value.rlike("^(?:" + pattern + ")$")
    return (F.when(F.instr(value, "@") > 0, _email(value, key))
            .when(whole(ISO_DATE), _date(value, key, 1, 6, 9, "yyyy-MM-dd"))
            .when(whole(US_DATE), _date(value, key, 7, 1, 4, "MM/dd/yyyy"))
            .when(whole(EU_DATE), _date(value, key, 7, 4, 1, "dd.MM.yyyy"))
            .when(whole(PHONE), _phone(value, key))
            .when(whole(SSN), _ssn(value, key))
            .when(whole(CARD), _card(value, key))
            .when(whole(ADDRESS), _address(value, key)))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in the text replaced, plus ``n_replaced``
    (long; an equally named input column is replaced).

    Cards (Luhn), North American phone numbers, social security numbers, IPv4
    addresses, dates from 1900 to 2099 and the local parts of mail addresses.
    A card may stand beside other digits (an expiry date, a check code). Mail names
    may hold any letters; Latin, Greek and Cyrillic ones are replaced, others stay.
    Values that look alike but are not valid stay. Null stays null (0 replaced).
    Work is per row: nothing is shuffled, and repeated rows get equal answers.
    ``key`` is a secret of the caller; the same key keeps values linked.
    """
    text = F.col(quoted(text_col))
    none = F.array().cast("array<string>")
    # Two passes over rows with a digit or @ only. Each level of the arrays
    # below is evaluated once and used by the next.
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))).otherwise(none)

    def replaced(values: Column) -> Column:
        return F.struct(values.alias("old"), F.transform(values, lambda v: pseudonym(v, key)).alias("new"))

    def rebuilt(p: Column) -> Column:
        gaps = F.split(text, ANY, -1)
        new = F.zip_with(p["old"], p["new"], lambda old, fresh: F.coalesce(fresh, old))
        joined = F.array_join(F.zip_with(gaps, new, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
        changed = F.size(F.filter(p["new"], lambda v: v.isNotNull())).cast("long")
        return F.struct(F.when(changed > 0, joined).otherwise(text).alias("text"), changed.alias("n"))

    done = F.transform(F.transform(F.array(F.coalesce(found, none)), replaced), rebuilt)
    keep = [c for c in docs.columns if c != "n_replaced"]
    rows = docs.select(*[F.col(quoted(c)) for c in keep], F.explode(done).alias("__p"))
    return rows.select(*[F.col("__p.text").alias(c) if c == text_col else F.col(quoted(c)) for c in keep],
                       F.col("__p.n").alias("n_replaced"))

"""Format-preserving pseudonyms for personal data (SQL functions only).

The pattern of each kind is tried at every place, so a candidate hides no other;
each is validated by the rules of its kind (Luhn sum, mod-97 sum, calendar, number
ranges), and of valid ones that overlap the first stays. A valid value is split into places, each with as many choices as its format allows, and
permuted by a keyed Feistel network: the places are halved, and in each round
one half is shifted, place by place, by a digest of the other. Check digits are
made anew. So a pseudonym is valid in the same format, different values never
get the same one, and equal values get the same one in every document.

Texts are read whole, once for each kind, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.secrets import prefix_sums

KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
#: Candidates of each kind, in the order in which valid ones are taken at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\+[2-9](?:[ .-]?[0-9]){7,14})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
}
ROUNDS = 8
#: Days from 1900-01-01 on that have pseudonyms: all until 2099-12-31, which are 17 * 4,297.
FIRST_DAY, YEARS, DAY_PLACES = "1900-01-01", (1900, 2099), (17, 4_297)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_VALUES = "array<struct<start:bigint,no:int,end:bigint,x:string>>"
KEY_SETTING = "spark.tidemark.pii.key"


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def _stream(key: Column, half: Column, n: Column, choices: Column) -> Column:
    """For each place, a number below its choices, from a digest of the other half."""
    seed = F.concat_ws("|", key, F.concat_ws(",", half.cast("array<string>")))
    return F.zip_with(F.sequence(F.lit(1), n), choices, lambda i, m: (F.conv(F.substring(F.sha2(F.concat_ws("#", seed, i.cast("string")), 256), 1, 12), 16, 10).cast("long") % m).cast("int"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permuted(places: Column, choices: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """``places`` (numbers below ``choices``, two or more of them) after the Feistel rounds."""

    def add(values: Column, shift: Column, most: Column) -> Column:
        return F.zip_with(F.zip_with(values, shift, lambda a, b: a + b), most, lambda s, m: (s % m).cast("int"))

    def network(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            k = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"))
            right = F.struct(s["l"].alias("l"), add(s["r"], _stream(k, s["l"], F.size(x["cr"]), x["cr"]), x["cr"]).alias("r"))
            left = F.struct(add(s["l"], _stream(k, s["r"], F.size(x["cl"]), x["cl"]), x["cl"]).alias("l"), s["r"].alias("r"))
            return F.when(i % 2 == 0, right).otherwise(left)

        start = F.struct(x["l"].alias("l"), x["r"].alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, one, lambda s: F.concat(s["l"], s["r"]))

    def halved(x: Column) -> Column:
        n = F.size(x["p"])
        half = F.floor(n / 2).cast("int")
        cut = [f(x[c]).alias(name) for c, names in (("p", "lr"), ("c", ("cl", "cr"))) for name, f in zip(names, (lambda v: F.slice(v, F.lit(1), half), lambda v: F.slice(v, half + 1, n - half)), strict=True)]
        return _let(F.struct(*cut), network)

    return _let(F.struct(places.alias("p"), choices.alias("c")), halved)


def _in_shape(shape: Column, fresh: Column) -> Column:
    """``shape`` with its digits replaced in order by ``fresh`` (array of int)."""
    gaps = F.split(shape, "[0-9]", -1)
    return F.concat_ws("", F.zip_with(gaps, F.concat(fresh.cast("array<string>"), F.array(F.lit(""))), lambda g, d: F.concat(g, d)))


def luhn(digits: Column) -> Column:
    """Luhn sum of digits, the last one being the check digit."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """Letters as 10..35, the whole as a number modulo 97."""
    return F.aggregate(
        _chars(text),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _leading(d: Column) -> Column:
    return F.when(d < 2, 2).otherwise(8)


def _card(x: Column, key: str) -> Column:
    """All digits but the first (the scheme) and the last, which is made anew."""

    def fresh(d: Column) -> Column:
        inner = F.slice(d, F.lit(2), F.size(d) - 2)
        return F.concat(F.slice(d, 1, 1), permuted(inner, F.transform(inner, lambda _: F.lit(10)), key, "card"))

    def checked(d: Column) -> Column:
        return F.concat(d, F.array(((10 - luhn(F.concat(d, F.array(F.lit(0)))) % 10) % 10).cast("int")))

    return _in_shape(x, _let(_let(_digits(x), fresh), checked))


def _phone(x: Column, key: str) -> Column:
    """The country code stays; leading digits of area and exchange stay 2-9 (or 0-1)."""
    national = x.startswith("+1") | ~x.startswith("+")
    keep = F.when(x.startswith("+1"), 1).when(x.startswith("+"), 2).otherwise(0)
    lead = lambda i: national & ((i == 0) | (i == 3))

    def shifted(s: Column) -> Column:
        choices = F.transform(s["d"], lambda v, i: F.when(lead(i), _leading(v)).otherwise(10))
        fresh = permuted(F.zip_with(s["d"], s["low"], lambda v, w: v - w), choices, key, "phone")
        return F.zip_with(fresh, s["low"], lambda v, w: v + w)

    def split(d: Column) -> Column:
        inner = F.slice(d, keep + 1, F.size(d) - keep)
        with_low = _let(inner, lambda y: F.struct(y.alias("d"), F.transform(y, lambda v, i: F.when(lead(i) & (v >= 2), 2).otherwise(0)).alias("low")))
        return F.concat(F.slice(d, F.lit(1), keep), _let(with_low, shifted))

    return _in_shape(x, _let(_digits(x), split))


def _ssn_ok(x: Column) -> Column:
    a = F.substring(x, 1, 3).cast("int")
    return (a > 0) & (a < 900) & (a != 666) & (F.substring(x, 5, 2) != "00") & (F.substring(x, 8, 4) != "0000")


def _ssn(x: Column, key: str) -> Column:
    a, g, s = (F.substring(x, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    area = lambda v: F.when(v >= 665, v + 2).otherwise(v + 1)
    fresh = permuted(F.array(F.when(a > 666, a - 2).otherwise(a - 1), g - 1, s - 1), F.array(F.lit(898), F.lit(99), F.lit(9_999)), key, "ssn")
    return _let(fresh, lambda p: F.format_string("%03d-%02d-%04d", area(F.get(p, 0)), F.get(p, 1) + 1, F.get(p, 2) + 1))


def _ip(x: Column, key: str) -> Column:
    v = F.split(x, r"\.").cast("array<int>")
    return F.concat_ws(".", permuted(v, F.transform(v, lambda _: F.lit(256)), key, "ip").cast("array<string>"))


def _in_form(x: Column, made) -> Column:
    """``made`` of the form that a date is written in."""
    return F.when(x.contains("-"), made("yyyy-MM-dd")).when(x.contains("."), made("dd.MM.yyyy")).when(F.substring(x, 5, 1) == "/", made("yyyy/MM/dd")).otherwise(made("MM/dd/yyyy"))


def _day(x: Column) -> Column:
    return _in_form(x, lambda form: F.try_to_date(x, form))


def _phone_ok(x: Column) -> Column:
    """National area codes begin with 2 to 9."""
    area = F.when(x.startswith("+1"), F.substring(F.regexp_replace(x, "[^0-9]", ""), 2, 1)).when(~x.startswith("+"), F.substring(F.regexp_replace(x, "[^0-9]", ""), 1, 1))
    return area.isNull() | (area >= "2")


def _date(x: Column, key: str) -> Column:
    day = F.datediff(_day(x), F.lit(FIRST_DAY).cast("date"))
    a, b = DAY_PLACES
    places = _let(day, lambda y: F.array(F.floor(y / b).cast("int"), (y % b).cast("int")))

    def written(p: Column) -> Column:
        fresh = F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(p, 0) * b + F.get(p, 1))
        return _in_form(x, lambda form: F.date_format(fresh, form))

    return _let(permuted(places, F.array(F.lit(a), F.lit(b)), key, "date"), written)


def _letters(text: Column, key: str, kind: str) -> Column:
    """Letters and digits permuted within their class, other characters as they are; at least two are needed."""

    def place(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[a-z]"), F.ascii(c) - 97).when(c.rlike("[A-Z]"), F.ascii(c) - 65).otherwise(0)

    def size(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)

    def back(c: Column, v: Column) -> Column:
        letter = lambda alphabet: F.substring(F.lit(alphabet), v + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), letter(DIGITS)).when(c.rlike("[a-z]"), letter(LOWER)).when(c.rlike("[A-Z]"), letter(UPPER)).otherwise(c)

    def whole(chars: Column) -> Column:
        return F.concat_ws("", F.zip_with(chars, permuted(F.transform(chars, place), F.transform(chars, size), key, kind), back))

    return _let(_chars(text), whole)


def _email(x: Column, key: str) -> Column:
    """The local part and the domain's own name are permuted; the last label stays."""
    return F.concat(_letters(F.regexp_extract(x, r"^(.*)\.[^.]*$", 1), key, "email"), F.lit("."), F.substring_index(x, ".", -1))


def _iban_ok(x: Column) -> Column:
    s = F.replace(x, F.lit(" "), F.lit(""))
    return F.length(s).between(15, 34) & (mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def _iban(x: Column, key: str) -> Column:
    s = F.replace(x, F.lit(" "), F.lit(""))
    country = F.substring(s, 1, 2)

    def checked(own: Column) -> Column:
        return F.concat(country, F.lpad((98 - mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0"), own)

    # Written in groups of four if the original was.
    whole = _let(_letters(F.substring(s, F.lit(5), F.length(s)), key, "iban"), checked)
    return _let(whole, lambda w: F.when(x.contains(" "), F.trim(F.regexp_replace(w, "(.{4})", "$1 "))).otherwise(w))


def _iban_read(x: Column) -> Column:
    """The longest valid reading of a candidate that ends where one of its groups does, null if there is none."""
    words = F.split(x, " ")
    readings = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda i: F.concat_ws(" ", F.slice(words, F.lit(1), i)))
    return F.get(F.filter(readings, _iban_ok), F.lit(0))


def value_of(x: Column, kind: str) -> Column:
    """The valid value at the start of a candidate of a kind, null if there is none."""
    if kind == "iban":
        return _iban_read(x)
    if kind == "card":
        return F.when(luhn(_digits(x)) % 10 == 0, x)
    if kind == "ssn":
        return F.when(_ssn_ok(x), x)
    if kind == "ip":
        return F.when(F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255), x)
    if kind == "phone":
        return F.when(_phone_ok(x), x)
    if kind == "date":
        return F.when(F.year(_day(x)).between(*YEARS), x)
    return x


def _found(text: Column, kind: str) -> Column:
    """Valid values of a kind at all places of ``text``, which starts with a space: (start, no, end, x)."""
    # Group 1 is the candidate; the back references move up by one.
    pattern = f"(?=({PATTERNS[kind].replace(chr(92) + '2', chr(92) + '3').replace(chr(92) + '1', chr(92) + '2') if kind == 'card' else PATTERNS[kind]}))"

    def located(m: Column) -> Column:
        # Matches are empty, so starts are the sums of the pieces before them, less the space.
        lengths = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        starts = _let(lengths, lambda n: F.slice(prefix_sums(n), F.lit(2), F.size(n) - 1))
        values = F.zip_with(starts, m, lambda a, x: F.struct((a - 1).alias("start"), value_of(x, kind).alias("x")))
        held = F.filter(values, lambda v: v["x"].isNotNull())
        return F.transform(held, lambda v: F.struct(v["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"), (v["start"] + F.length(v["x"])).alias("end"), v["x"].alias("x")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(F.array())).cast(_VALUES)


def _apart(values: Column) -> Column:
    """Values by start, without those that begin before the end of one that stays."""

    def add(acc: Column, v: Column) -> Column:
        return F.when(F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] > v["start"], F.lit(False)), acc).otherwise(F.array_append(acc, v))

    def resolved(vs: Column) -> Column:
        meets = F.zip_with(F.slice(vs, F.lit(1), F.greatest(F.size(vs) - 1, F.lit(0))), F.slice(vs, F.lit(2), F.size(vs)), lambda a, b: a["end"] > b["start"])
        return F.when(F.exists(meets, lambda x: x), F.aggregate(vs, F.array().cast(_VALUES), add)).otherwise(vs)

    return _let(values, resolved)


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    out = F.when(kind == "email", _email(x, key))
    for name, make in (("iban", _iban), ("card", _card), ("phone", _phone), ("ssn", _ssn), ("ip", _ip), ("date", _date)):
        out = out.when(kind == name, make(x, key))
    return out.otherwise(x)


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and ``spans``: array of (kind, start, end) in the old text.

    Offsets are code points, end exclusive. Null text stays null and has no
    spans; repeated rows are treated each; an empty table gives no rows. A
    column called spans gives way to the new one; others may have any names.
    The key is the session's KEY_SETTING unless given; without one there are no
    pseudonyms that only its owner can undo, so that is an error.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"a key is needed: give one or set {KEY_SETTING}")
    columns = [c for c in docs.columns if c != "spans"]
    df = docs.select(F.struct(*columns).alias("row"), "text").withColumn("_t", F.concat(F.lit(" "), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", _found(F.col("_t"), kind))
    every = [f"_{kind}" for kind in KINDS]
    some = F.size("_m") > 0
    df = df.withColumn("_m", F.concat(*every)).withColumn("_m", F.when(some, _apart(F.array_sort("_m"))).otherwise(F.col("_m"))).drop(*every)
    names = F.array(*[F.lit(k) for k in KINDS])
    kind = lambda s: F.element_at(names, s["no"] + 1)
    df = df.withColumn("spans", F.transform("_m", lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    # Each pseudonym and the text from there to the next value; places in _t are one more than in the text.
    tails = F.concat(F.transform(F.slice("_m", F.lit(2), F.size("_m")), lambda s: s["start"]), F.array((F.length("_t") - 1).cast("bigint")))
    rest = lambda s, to: F.substring(F.col("_t"), (s["end"] + 2).cast("int"), (to - s["end"]).cast("int"))
    pieces = F.zip_with("_m", tails, lambda s, to: F.concat(pseudonym(s["x"], kind(s), key), rest(s, to)))
    head = F.substring(F.col("_t"), F.lit(2), F.element_at("_m", 1)["start"].cast("int"))
    text = F.when(some, F.concat(head, F.concat_ws("", pieces))).otherwise(F.col("text"))
    return df.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns], "spans")


def digest(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_<kind> for each kind, spans (kind:start:end, comma-joined), text with pseudonyms.

    One row for each row of ``docs``, with null text where that is null; an
    empty table gives none. The key is as in ``pseudonymised``.
    """
    found = pseudonymised(docs.select("doc_id", "text"), key)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    listed = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return found.select("doc_id", *[count(k) for k in KINDS], listed.alias("spans"), "text")

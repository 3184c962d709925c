"""Personal data replaced by surrogates, in DataFrame operations only.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards (13 to 19 digits with a valid check
digit), IBANs (with valid check digits), US social security numbers, secrets and titled names. Phone numbers have 7 to
15 digits: international ones in any grouping or none, national ones that start with a zero or a code in parentheses,
have hyphens, dots or spaces between groups of 3-3-4, 2-4-4 or 3-4-4 digits, hyphens between 3-3-3, or follow a word for
telephone; dates and spans of times are none. Secrets are 32 or more hexadecimal digits with a digit among them, 32 or
more letters of both cases and digits in two places or more (three if there are signs of base 64 among them, and not in
a URL), values with a letter and a digit of 16 characters or more behind a word for key, and known forms of keys. A word
of a titled name is also replaced where it recurs without a title in the same document, capitalised.

An entity consists of units: the local part and the domain of an address, the words of a name, else one. Each distinct
unit of the corpus gets one surrogate from a keyed digest, so the same unit has the same surrogate in every document,
and two units never share one, nor is a surrogate a unit that occurs: units in conflict draw again until none is left.
Surrogates have the type, the script and the length of what they replace; they are longer where there are too few of
that length. Words that occur as given names behind titles of one gender only have surrogates of that gender, whatever
the title of an occurrence. Surrogates are laid into each occurrence's own separators and case.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, unused, written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles by the gender that they tell.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "x": ["Dr", "Prof"]}
_TITLE = "(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.?"
_INITIALS = r"(?:\p{Lu}\. ?){0,3}"
#: A word of a name, without a possessive ending.
_NAME = r"\p{Lu}(?:\p{L}+|(?=['’]\p{Lu}))(?:(?:['’](?![sS](?!\p{L}))|-)\p{L}+){0,4}"
_GAP = r"[ \t\u00a0\u202f.()/\u2010-\u2015\-]"
_MORE = rf"(?![\p{{L}}\p{{N}}])(?!{_GAP}?\d)"
_DATE = r"\d{1,2}[.\-/ ]\d{1,2}[.\-/ ](?:\d\d){1,2}(?![.\-/ ]?\d)|\d\d\.\d\d ?[\-\u2013] ?\d\d\.\d\d(?!\d)"
_PHONE_WORD = r"(?i:tel|tel\.|t[eé]l[eé]phone|tel[eé]fono|telefon|phone|fax|mobile|m[oó]vil|mobil|handy|portable|call)"
_NATIONAL = "|".join([
    rf"(?!000|{_DATE})0\d(?:{_GAP}{{0,2}}\d){{5,13}}{_MORE}",
    rf"(?:1[ .\-])?(?:\d{{3}}[ .\-]\d{{3}}|\d{{2,3}}[ .\-]\d{{4}})[ .\-]\d{{4}}{_MORE}",
    rf"\d{{3}}-\d{{3}}-\d{{3}}{_MORE}",
    rf"(?=\d(?:{_GAP}{{0,2}}\d){{6}})(?<={_PHONE_WORD}[.: ]{{1,3}})(?!{_DATE})\d(?:{_GAP}{{0,2}}\d){{6,14}}{_MORE}",
])
_SECRET_WORD = r"(?i:key|token|secret|password|passwd|pwd)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_IPV6 = rf"(?:{_HEX}(?::{_HEX}){{7}}|(?=[0-9A-Fa-f:]*\d)(?!(?:{_HEX}:+){{8}}){_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)"
_SSN = r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}"
#: Entities that start with a letter or digit, and have a digit or an @ near their start.
PATTERNS = {
    "email": r"(?<![._%+\-])[\p{L}\p{N}._%+\-]{1,100}+@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){0,8}\.\p{L}{2,24}",
    "ip": rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ipv6": rf"(?<!:){_IPV6}(?![\p{{L}}\p{{N}}:])",
    "ssn": rf"(?<![\-.]){_SSN}(?![\p{{L}}\p{{N}}]|-\d)",
    "secret": r"(?=[A-Fa-f]*+\d)[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])",
    "key": r"(?<![_+/\-])(?=[A-Za-z0-9_+/=~.\-]{15})(?:(?=[a-z0-9_]*+[A-Z])(?=[A-Z0-9_]*+[a-z])(?=[A-Za-z_]*+\d++[A-Za-z_]++\d)[A-Za-z0-9_]{32,}+"
    r"|(?=[a-z0-9_+/\-]*+[A-Z])(?=[A-Z0-9_+/\-]*+[a-z])(?=(?:[A-Za-z_+/\-]*+\d++){2}[A-Za-z_+/\-]++\d)(?<!\.)[A-Za-z0-9_+/\-]{32,}+={0,2}"
    r"|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]+|AKIA[A-Z0-9]{16}|AIza[A-Za-z0-9_\-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|xox[a-z]-[A-Za-z0-9\-]{10,}|[sr]k[_\-][A-Za-z0-9_\-]{16,}"
    rf"|(?<={_SECRET_WORD}[\"' :=]{{1,6}})(?=[^\s\d]*+\d)(?=[^\sA-Za-z]*+[A-Za-z])[A-Za-z0-9_+/=~.\-]{{15,}}[A-Za-z0-9_+/=~\-])(?![\p{{L}}\p{{N}}@])",
    "iban": r"[A-Z]{2}\d\d(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![\p{L}\p{N}])",
    "card": r"(?<![.\-])\d(?:[ \-]?\d){12,18}(?![\p{L}\d])",
    "national": rf"(?=\d)(?<!\p{{N}}[.,\-/:])(?:{_NATIONAL})",
}
#: The others.
_PAREN = rf"\((?!(?:19|20)\d\d\))\d{{2,6}}\)(?={_GAP}*\d(?:{_GAP}{{0,2}}\d){{4,}})(?:{_GAP}{{0,2}}\d){{5,13}}{_MORE}"
_TITLED = rf"{_TITLE} {_INITIALS}{_NAME}(?: {_NAME})?"
_PLUS = rf"\+(?:\d{{1,3}}[^\w\n]{{1,5}}\d{{3}}[^\w\n]{{1,6}}\d{{3}}[^\w\n]{{1,4}}\d{{4}}(?!\d)|(?<!\p{{N}}\+)(?:{_GAP}{{0,3}}\d){{7,15}}(?!\d))"
#: What a word needs to be looked at: a digit or an @ near its start. ASCII letters are passed over first, as that is faster.
_GUARD = r"(?=[a-zA-Z]{0,30}+[^\s@\d]{0,100}+[@\d])(?=[\p{L}\p{N}._%+])"
#: One pass finds all. The first look behind is one range, which rules out most places.
ENTITY = rf"(?<![a-z])(?<![\p{{L}}\p{{N}}])(?:(?=[^ ]){_GUARD}(?:{'|'.join(PATTERNS.values())})|(?=[A-Z]){_TITLED}|(?=\()(?<!\p{{N}}[.,\-/:]){_PAREN})|{_PLUS}"
_WORD = rf"(?<!\p{{L}}){_NAME}"
#: What entities are marked with in a text; no character.
_MARK = "\ufdd0"
#: Consonants and vowels of the scripts that surrogates are written in.
SCRIPTS = {r"\p{IsCyrillic}": ("бвгдзклмнпрст", "аеиоу"), r"\p{IsGreek}": ("βγδζκλμνπρστ", "αειου"), r"\p{L}": ("bdfgklmnprstvz", "aeiou")}
#: Fixed value: how many characters a letter of a surrogate stands for, consonants and vowels in turn.
_CHOICES = (12 * 5) ** 0.5
#: Draws after which units are given up.
_DRAWS = 64


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """The check sum, modulo 10, of a string of digits."""
    figures = F.transform(_chars(F.reverse(digits)), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(figures, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10


def _mod97(iban: Column) -> Column:
    """The remainder that an IBAN without spaces has by 97; 1 where its check digits are right."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    worth = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int"))
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: (a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + worth(c)) % 97)


def _kind(raw: Column) -> Column:
    card = raw.rlike(r"^\d(?:[ \-]?\d){12,18}$")
    solid = F.translate(raw, " ", "")
    return (
        F.when(raw.contains("@"), "email").when(raw.startswith("+"), "phone").when(raw.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip").when(raw.contains(":"), "ipv6")
        .when(raw.rlike(rf"^{_SSN}$"), "ssn").when(raw.rlike("^[0-9A-Fa-f]{32,}$"), "secret")
        .when(solid.rlike(r"^[A-Z]{2}\d\d[A-Z0-9]{11,30}$") & (_mod97(solid) == 1), "iban").when(raw.rlike(r"^[A-Z]{2}\d\d "), "none")
        .when(card & (_luhn(_digits(raw)) == 0), "card").when(~raw.rlike(r"\p{L}") & (~card | raw.startswith("0")), "phone").when(card, "none")
        .when(~raw.rlike(r"\s"), "key").otherwise("name")
    )


def _unit(kind: Column | str, canon: Column, gender: Column | None = None) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), canon.alias("canon"), (F.lit("x") if gender is None else gender).alias("gender"))


def _units(raw: Column, kind: Column) -> Column:
    """The units of an entity, in order, with the gender that a title tells of a given name."""
    name = F.split(F.regexp_replace(raw, rf"^{_TITLE} {_INITIALS}", ""), " ")
    gender = F.lit("x")
    for g in ("m", "f"):
        gender = F.when(raw.rlike(rf"^(?:{'|'.join(TITLES[g])})\.? "), g).otherwise(gender)
    low = F.lower(raw)
    return (
        F.when(kind == "email", F.array(_unit("local", F.substring_index(low, "@", 1)), _unit("domain", F.substring_index(low, "@", -1))))
        .when((kind == "name") & (F.size(name) > 1), F.array(_unit("name", F.lower(F.get(name, F.lit(0))), gender), _unit("name", F.lower(F.get(name, F.lit(1))))))
        .when(kind == "name", F.array(_unit("name", F.lower(F.get(name, F.lit(0))))))
        .when(kind.isin("phone", "card", "ssn"), F.array(_unit(kind, _digits(raw)))).when(kind == "iban", F.array(_unit("iban", F.translate(raw, " ", ""))))
        .when(kind == "key", F.array(_unit("key", raw))).otherwise(F.array(_unit(kind, low)))
    )


def _label(kind: Column, canon: Column) -> Column:
    """The part of a unit that its surrogate draws anew: of a domain all but its last part."""
    return F.when(kind == "domain", F.regexp_extract(canon, r"^(.*)\.[^.]*$", 1)).otherwise(canon)


def _surrogate(key: str, draw: int) -> Column:
    """Of a unit (kind, canon, gender, extra) in a draw; later draws are longer where they can be."""
    kind, canon, gender = F.col("kind"), F.col("canon"), F.col("gender")
    grows = F.when(kind.isin("local", "name", "domain"), F.col("extra") + draw // 4).when(kind == "phone", max(0, draw // 4 - 3)).otherwise(0).cast("int")
    pad = F.when(canon.rlike(r"\p{IsCyrillic}"), "а").when(canon.rlike(r"\p{IsGreek}"), "α").when(kind == "phone", "0").otherwise("a")
    full = F.concat(_label(kind, canon), F.repeat(pad, grows))
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(full) / 32).cast("int")), lambda j: F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.lit(str(draw)), j.cast("string")).cast("binary"), 256)), "")
    byte = lambda i: F.conv(F.substr(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, i: F.substr(F.lit(letters), byte(i) % len(letters) + 1, F.lit(1))
    each = lambda f, s=full: F.array_join(F.transform(_chars(s), f), "")

    def letter(c, i):
        out = c
        for script, (consonants, vowels) in reversed(SCRIPTS.items()):
            out = F.when(c.rlike(script), F.when(i % 2 == 0, pick(consonants, i)).otherwise(pick(vowels, i))).otherwise(out)
        return F.when(c.rlike("[0-9]"), pick("0123456789", i)).otherwise(out)

    any_letter = "abcdefghijklmnopqrstuvwxyz"
    alike = lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(pick(any_letter, i))).when(c.rlike("[a-z]"), pick(any_letter, i)).when(c.rlike("[0-9]"), pick("0123456789", i)).otherwise(c)
    hexadecimal = lambda c, i: F.when(c.rlike("[0-9a-f]"), pick("0123456789abcdef", i)).otherwise(c)
    card = F.concat(F.left(canon, F.lit(1)), F.substr(each(letter), F.lit(2), F.length(canon) - 2))
    check = lambda body: ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    account = F.substr(each(alike), F.lit(5))
    country = F.left(canon, F.lit(2))
    # all but the last ten digits of a phone number stay, and zeros that it starts with
    stays = F.greatest(F.length(canon) - 10, F.length(F.regexp_extract(canon, "^0{0,2}", 0)))
    end = lambda n: F.when(canon.rlike(r"\p{IsCyrillic}"), ("а", "н")[n]).when(canon.rlike(r"\p{IsGreek}"), ("α", "ς")[n]).otherwise(("a", "n")[n])
    gendered = lambda n: F.concat(F.left(each(letter), F.length(full) - 1), end(n))
    return (
        F.when(kind == "ip", F.concat_ws(".", (byte(F.lit(0)) % 223 + 1).cast("string"), *[byte(F.lit(n)).cast("string") for n in (1, 2, 3)]))
        .when(kind.isin("secret", "ipv6"), each(hexadecimal)).when(kind == "card", F.concat(card, check(card)))
        .when(kind == "iban", F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account))
        .when(kind == "ssn", each(lambda c, i: F.when(i == 0, pick("12345", i)).when(i.isin(3, 5), pick("123456789", i)).otherwise(pick("0123456789", i))))
        .when(kind == "phone", F.concat(F.left(canon, stays), F.substr(each(letter), stays + 1))).when(kind == "key", each(alike))
        .when(kind == "domain", F.concat(each(letter), F.lit("."), F.substring_index(canon, ".", -1)))
        .when((kind == "name") & (gender == "f"), gendered(0)).when((kind == "name") & (gender == "m"), gendered(1)).otherwise(each(letter))
    )


def _named(units: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of all units (kind, canon, gender), without conflicts; written."""
    shape = ["kind", "gender", "size"]
    free = F.length(F.regexp_replace(_label(F.col("kind"), F.col("canon")), r"[^\p{L}\p{N}]", "")) - (F.col("gender") != "x").cast("int")
    sized = units.withColumn("size", F.least(free, F.lit(24)))
    counts = sized.groupBy(*shape).agg(F.count("*").alias("n"))  # at most 25 sizes, 3 genders and a dozen kinds
    # letters to add so that there are four times as many surrogates as units
    extra = F.greatest(F.lit(0), F.ceil(F.log(4.0 * F.col("n")) / log(_CHOICES)) - F.col("size")).cast("int")
    drawing = written(sized.join(F.broadcast(counts), shape).select("kind", "canon", "gender", extra.alias("extra")), "units")
    taken, settled = drawing.select("kind", F.col("canon").alias("surrogate")), None
    for draw in range(_DRAWS):
        drawn = written(drawing.withColumn("surrogate", _surrogate(key, draw)), "drawn")
        # of units that share a surrogate the least keeps it
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        # numbers of a fixed form may run out: late draws may be such as occur
        ok = first.join(taken, ["kind", "surrogate"], "left_anti") if draw < _DRAWS // 2 else first
        ok = ok.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti") if settled else ok
        now = written(ok.select("kind", "canon", "surrogate"), "settled")
        settled = settled.unionByName(now) if settled else now
        left = drawn.join(now.select("kind", "canon"), ["kind", "canon"], "left_anti").drop("surrogate")
        if left.isEmpty():
            return settled
        drawing = written(left, "units")
        drop_written(drawn)
    kinds = sorted(r[0] for r in drawing.select("kind").distinct().collect())
    raise ValueError(f"{_DRAWS} draws did not give every unit a surrogate of its own: {', '.join(kinds)}")


def _cased(like: Column, surrogate: Column) -> Column:
    """A word of a name in the case of what it replaces."""
    return F.when(like == F.upper(like), F.upper(surrogate)).otherwise(F.initcap(surrogate))


def _laid(raw: Column, kind: Column, surrogates: Column) -> Column:
    """The surrogates in the separators and the case of raw."""
    first, second = F.get(surrogates, F.lit(0)), F.get(surrogates, F.lit(1))
    # the n-th digit (of an IBAN also letter) of raw becomes the n-th of the surrogate; what that has more follows
    figures = lambda s: F.when(kind == "iban", F.translate(s, " ", "")).otherwise(_digits(s))
    placed = F.transform(_chars(raw), lambda c, i: F.when(figures(c) != "", F.substr(first, F.length(figures(F.left(raw, i + 1))), F.lit(1))).otherwise(c))
    numbers = F.concat(F.array_join(placed, ""), F.substr(first, F.length(figures(raw)) + 1))
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    title = F.regexp_extract(raw, rf"^{_TITLE} ", 0)
    # an initial follows the surrogate of the surname
    initials = F.regexp_replace(F.regexp_extract(raw, rf"^{_TITLE} ({_INITIALS})", 1), F.lit(r"\p{Lu}"), F.upper(F.left(F.coalesce(second, first), F.lit(1))))
    rest = F.regexp_replace(raw, rf"^{_TITLE} {_INITIALS}", "")
    same_case = lambda s: F.when(upper, F.upper(s)).otherwise(s)
    return (
        F.when(kind == "email", same_case(F.concat(first, F.lit("@"), second))).when(kind.isin("phone", "card", "ssn", "iban"), numbers).when(kind == "key", first)
        .when(kind == "name", F.concat(title, initials, _cased(rest, F.concat_ws(" ", first, second)))).otherwise(same_case(first))
    )


def _parts(text: Column) -> Column:
    """A text cut at its entities: what is between them at even places, they themselves at odd ones; one pass."""
    marked = F.split(F.regexp_replace(text, ENTITY, f"{_MARK}$0{_MARK}"), _MARK, -1)
    # a text that has the mark itself is cut and searched instead
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    slow = F.flatten(F.zip_with(F.split(text, ENTITY, -1), found, lambda s, e: F.array_compact(F.array(s, e))))
    return F.when(text.contains(_MARK), slow).otherwise(marked)


def _odd(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == 1)


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """(raw, kind, surrogate, words) of every distinct entity of found (raw); words: the words of a name and their
    surrogates. Written."""
    entities = found.select("raw").distinct().withColumn("kind", _kind(F.col("raw")))
    entities = written(entities.where("kind <> 'none'").withColumn("units", _units(F.col("raw"), F.col("kind"))), "entities")
    parts = entities.select("raw", F.posexplode("units").alias("at", "u")).select("raw", "at", "u.kind", "u.canon", "u.gender")
    genders = parts.groupBy("kind", "canon").agg(F.max(F.col("gender") == "m").alias("m"), F.max(F.col("gender") == "f").alias("f"))
    units = genders.select("kind", "canon", F.when(F.col("m") == F.col("f"), "x").when(F.col("m"), "m").otherwise("f").alias("gender"))
    named = _named(units, key)
    whole = parts.join(named, ["kind", "canon"]).groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("at", "canon", "surrogate"))).alias("s"))
    words = F.when(F.col("kind") == "name", F.transform("s", lambda x: F.struct(x["canon"].alias("word"), x["surrogate"].alias("surrogate")))).otherwise(F.array())
    table = entities.join(whole, "raw").select("raw", "kind", _laid(F.col("raw"), F.col("kind"), F.transform("s", lambda x: x["surrogate"])).alias("surrogate"), words.alias("words"))
    table = written(table, "surrogates")
    drop_written(entities)
    return table


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with all their columns, their texts with surrogates, and n_replaced, the occurrences replaced in each.

    Null texts stay null, texts without entities stay as they are. Rows that repeat a doc_id are replaced each, and so
    are rows without one; equal texts are replaced alike. The same key gives the same surrogates for the same corpus.
    An empty table gives no rows. A column of docs named n_replaced is left out."""
    row, cut, by_raw, by_word, text = (unused(docs, n) for n in ("row", "cut", "by_raw", "by_word", "text_"))
    kept = [c for c in docs.columns if c != "n_replaced"]
    rows = docs.select(*kept, _parts(F.col("text").cast("string")).alias(cut))
    # a text is kept whole or cut, not both
    rows = rows.select(*[F.when(F.size(cut) > 1, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "text" else F.col(c) for c in kept], F.when(F.size(cut) > 1, F.col(cut)).alias(cut), F.monotonically_increasing_id().alias(row))
    rows = written(rows, "cut")
    with_entities = rows.where(F.col(cut).isNotNull())
    found = with_entities.select(F.col(row).alias("row"), F.explode(F.array_distinct(_odd(F.col(cut)))).alias("raw"))
    table = surrogate_table(found, key)
    words = F.array_distinct(F.flatten(F.collect_list("words")))
    maps = found.join(table, "raw").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("raw", "surrogate"))).alias(by_raw), F.map_from_entries(words).alias(by_word)).withColumnRenamed("row", row)
    done = with_entities.join(maps, row, "left")

    def again(s: Column) -> Column:
        """Text between entities, with the words of the document's titled names replaced."""
        between, met = F.split(s, _WORD, -1), F.regexp_extract_all(s, F.lit(_WORD), F.lit(0))
        new = F.zip_with(between, met, lambda b, w: F.concat(b, F.coalesce(_cased(w, F.col(by_word)[F.lower(w)]), w, F.lit(""))))
        return F.array_join(new, "")

    has_names = F.coalesce(F.size(by_word), F.lit(0)) > 0
    pieces = F.transform(cut, lambda s, i: F.when(i % 2 == 1, F.coalesce(F.col(by_raw)[s], s)).when(has_names, again(s)).otherwise(s))
    recur = lambda s: F.size(F.filter(F.regexp_extract_all(s, F.lit(_WORD), F.lit(0)), lambda w: F.map_contains_key(by_word, F.lower(w))))
    count = F.size(F.filter(_odd(F.col(cut)), lambda e: F.coalesce(F.map_contains_key(by_raw, e), F.lit(False))))
    count = count + F.when(has_names, F.aggregate(F.filter(cut, lambda _, i: i % 2 == 0), F.lit(0), lambda a, s: a + recur(s))).otherwise(0)
    done = done.select(*[F.array_join(pieces, "").alias(text) if c == "text" else F.col(c) for c in kept], count.cast("long").alias("n_replaced"))
    plain = rows.where(F.col(cut).isNull()).select(*kept, F.lit(0).cast("long").alias("n_replaced"))
    return plain.unionByName(done.withColumnRenamed(text, "text"))

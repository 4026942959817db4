"""Surrogates for personal data (operator 3), in DataFrame functions only.

Entities (mail addresses, names after a form of address, IP and hardware addresses, telephone, card, account and social-security
numbers, access keys, labelled secrets) are found by one pattern. A surname found after a form of address is looked for in
the rest of its document too, alone or after a first name. An entity is made of parts, and each distinct part of the corpus gets
one keyed surrogate, so that the same part has the same surrogate everywhere, in whatever case or grouping it is written:
a name's surname, a mail address's domain. A surrogate has the part's type and format: digits for digits, letters for
letters of the same case, hexadecimal for hexadecimal, a card number keeps its first digit and is right by its check digit, as only
such numbers are taken for cards; an account number keeps its country and whether its check digits are right. A first name has one surrogate whatever form of address it stands after; its
gender is that of the forms of address it is seen with anywhere, neutral if they tell none or both; names keep the script.

Collision check: candidates of all parts of a type are compared corpus-wide. A candidate that two parts share,
that is taken, or that is itself a part found in the corpus is drawn again for all parts but one (the smallest), until
none is left. Late draws get longer; where the format has a fixed length, private IP addresses move to the largest
private block, and card, social-security and public IP numbers have so many values that draws end. If DRAWS are not enough
after all, ValueError says so; no entity is left in clear.

Entities have no largest length but that of their format (35 characters of an account number, 19 digits of a card). Parts of more
than LONG characters get a hexadecimal surrogate of their length.

Scale: texts are read twice, once for rows that have entities, which are few and checkpointed, once for those that pass
straight through; only the former are split, exploded and joined. A part or entity common to a third of all rows is one
row a task after map-side aggregation, and its rows meet one surrogate row in a join that adaptive execution can split
(both sides have exchanges of their own, as tables are checkpointed).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Forms of address by gender, where they tell one (fixed values).
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
NEUTRAL = ["Dr", "Prof"]
#: Parts of surrogate names by script (fixed values).
FIRST = {
    "m": ["Adam", "Boris", "Cedric", "Darius", "Emil", "Felix", "Gustav", "Hugo", "Ivo", "Jonas", "Karl", "Leon", "Marius", "Nils", "Oscar", "Pavel"],
    "f": ["Alma", "Bella", "Clara", "Dora", "Elsa", "Freya", "Greta", "Hanna", "Ida", "Julia", "Karin", "Lena", "Mira", "Nora", "Olga", "Petra"],
    "n": ["Alex", "Bo", "Charlie", "Dana", "Eli", "Finley", "Gale", "Harper", "Indigo", "Jules", "Kim", "Lee", "Morgan", "Noel", "Ollie", "Perry"],
}
FIRST_CYRILLIC = {
    "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семен", "Тимур"],
    "f": ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"],
}
SYLLABLES = ["ba", "den", "for", "gal", "hol", "kem", "lin", "mar", "nor", "pel", "ras", "sol", "tam", "vel", "win", "zan"]
SYLLABLES_CYRILLIC = ["ба", "ден", "фор", "гал", "хол", "кем", "лин", "мар", "нор", "пел", "рас", "сол", "там", "вел", "вин", "зан"]
ENDINGS = ["by", "er", "ley", "man", "ow", "sen", "ton", "well"]
ENDINGS_CYRILLIC = ["аев", "ев", "енко", "ин", "ов", "ский", "ук", "ян"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LABEL = r"(?i:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|client[_-]?secret)"
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=lambda t: (-len(t), t)))
PATTERNS = {
    "secret": rf"(?<![A-Za-z0-9]){_LABEL}\s{{0,3}}[=:]\s{{0,3}}[\"']?[!#$%()*+./0-9:=?@A-Z\[\\\]^_`a-z{{|}}~-]{{6,}}+[\"']?",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'-]++(?: \p{{Lu}}[\p{{L}}'-]++)?",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "mac": r"(?<![0-9A-Za-z:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
}
#: One pattern for all; the first alternative that fits at a place counts.
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A surname without a form of address, perhaps with a first name, which a sentence doesn't begin with.
BARE = r"(?<![\p{L}])(?:(?<=[\p{Ll},;:] )\p{Lu}[\p{L}'-]++ )?(?:SURNAMES)(?![\p{L}])"
_BARE_NAME = r"^(?:\p{Lu}[\p{L}'-]+ )?\p{Lu}[\p{L}'-]+$"
#: Shorter surnames are not looked for alone.
LEAST_SURNAME = 3
#: What entities but names hold; a cheap test before the full pattern. Names hold a form of address.
HINT = "[0-9@=:]"
DRAWS, LENGTHEN_FROM, LONG = 64, 8, 256


def _surnames(found: Column) -> Column:
    """Surnames of the names among entities, as written and in capitals."""
    last = F.transform(F.filter(found, lambda e: e.rlike(f"^(?:{PATTERNS['name']})$")), lambda e: F.regexp_extract(e, r"([\p{L}'-]+)$", 1))
    long = F.filter(last, lambda x: F.length(x) >= LEAST_SURNAME)
    return F.array_distinct(F.concat(long, F.transform(long, F.upper)))


def entity_pattern(text: Column) -> Column:
    """The pattern of a text's entities: ENTITY, with the surnames that the text has after a form of address."""
    surnames = _surnames(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    named = text.rlike(PATTERNS["name"])
    bare = F.replace(F.lit(BARE), F.lit("SURNAMES"), F.array_join(surnames, "|"))
    return F.when(named & (F.size(surnames) > 0), F.concat(F.lit(ENTITY + "|"), bare)).otherwise(F.lit(ENTITY))


def has_entities(text: Column) -> Column:
    """Whether a text has any; false for null. A cheap test goes first."""
    titles = sorted({t for t in MALE + FEMALE + NEUTRAL if not any(t != o and t.startswith(o) for o in MALE + FEMALE + NEUTRAL)})
    hint = reduce(lambda c, t: c | text.contains(t), titles, text.rlike(HINT))
    return F.coalesce(F.when(hint, text.rlike(ENTITY)), F.lit(False))


def _kind(raw: Column) -> Column:
    of = reduce(lambda c, k: c.when(raw.rlike(rf"^(?:{PATTERNS[k]})$"), F.lit(k)), PATTERNS, F)
    return of.when(raw.rlike(_BARE_NAME), F.lit("bare")).otherwise(F.lit("secret"))


def _parts(raw: Column, kind: Column) -> Column:
    """The entity as (kind, piece, gender) in order; literal pieces have the kind '', only first names a gender."""
    none = F.lit(None).cast("string")

    def part(k, piece, gender=none) -> Column:
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), piece.alias("piece"), gender.alias("gender"))

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract(raw, pattern, n)

    secret = r"(?s)^([^=:]*[=:]\s*[\"']?)(.*?)([\"']?)$"
    mail = r"(?s)^([^@]*)(@)(.*)(\.[^.]*)$"
    name = r"^(\p{L}+\.? )(\p{L}[\p{L}'-]*)(?:( )(\p{L}[\p{L}'-]*))?$"
    bare = r"^(?:(\p{L}[\p{L}'-]*)( ))?(\p{L}[\p{L}'-]*)$"
    title = F.regexp_extract(raw, r"^\p{L}+", 0)
    gender = F.when(title.isin(MALE), "m").when(title.isin(FEMALE), "f").otherwise("n")
    phone = r"^(\+\d{1,3}[ .-]?|)(.*)$"
    key = r"^(AKIA|ASIA|gh[pousr]_|sk-)(.*)$"
    return (
        F.when(kind == "secret", F.array(part("", group(secret, 1)), part("secret", group(secret, 2)), part("", group(secret, 3))))
        .when(kind == "mail", F.array(part("local", group(mail, 1)), part("", group(mail, 2)), part("domain", group(mail, 3)), part("", group(mail, 4))))
        .when((kind == "name") & (group(name, 3) != ""), F.array(part("", group(name, 1)), part("first", group(name, 2), gender), part("", group(name, 3)), part("last", group(name, 4))))
        .when(kind == "name", F.array(part("", group(name, 1)), part("last", group(name, 2))))
        .when((kind == "bare") & (group(bare, 2) != ""), F.array(part("first", group(bare, 1), F.lit("n")), part("", group(bare, 2)), part("last", group(bare, 3))))
        .when(kind == "bare", F.array(part("last", group(bare, 3))))
        .when(kind == "key", F.array(part("", group(key, 1)), part("key", group(key, 2))))
        .when((kind == "card") & ~_luhn_ok(F.regexp_replace(raw, "[^0-9]", "")), F.array(part("", raw)))
        .when(kind == "phone", F.array(part("", group(phone, 1)), part("phone", group(phone, 2))))
        .otherwise(F.array(part(kind, raw)))
    )


def _norm(kind: Column, piece: Column) -> Column:
    """What makes pieces one part: letters and digits without case or grouping; names keep their marks."""
    return F.when(kind == "ip", piece).when(kind.isin("first", "last"), F.lower(piece)).otherwise(F.lower(F.regexp_replace(piece, "[^A-Za-z0-9]", "")))


def _luhn_ok(digits: Column) -> Column:
    n = F.length(digits)
    doubled = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when(F.pmod(n - i, F.lit(2)) == 0, F.substring(digits, i, F.lit(1)).cast("int"))
        .otherwise(F.pmod(F.substring(digits, i, F.lit(1)).cast("int") * 2, F.lit(10)) + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return F.pmod(doubled, F.lit(10)) == 0


def _mod97(text: Column) -> Column:
    """The remainder of an account number's digits, letters counting from 10."""
    def step(acc: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 87, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def drawn_surrogates(parts: DataFrame, key: str, draw: int) -> DataFrame:
    """parts (kind, norm, gender) with the surrogate of each at a draw, in the form of norm: lower case, ungrouped.

    What several parts of the expression need is a column first, so that none is made twice and the generated code stays small.
    """
    kind, norm, gender = F.col("kind"), F.col("norm"), F.col("gender")
    digest, plain = F.col("digest"), F.col("plain")
    seed = F.concat_ws("|", F.lit(key), kind, F.lit(str(draw)), norm)
    rows = parts.select("kind", "norm", "gender", F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("|2")), 512)).alias("digest"))

    def byte(i: Column) -> Column:
        return F.conv(F.substring(digest, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    hexadecimal = norm.rlike("^[0-9a-f]+$") & norm.rlike("[a-f]")

    def char(i: Column) -> Column:
        c = F.substring(norm, i, F.lit(1))
        digit = F.when((i == 1) & (kind == "phone") & (c != "0"), F.pmod(byte(i), F.lit(8)) + 2).otherwise(F.pmod(byte(i), F.lit(10)))
        return (
            F.when(((kind == "card") & (i == 1)) | ((kind == "iban") & (i <= 2)), c)
            .when(c.rlike("[0-9]"), digit.cast("string"))
            .when(c.rlike("[a-z]"), F.substring(F.when(hexadecimal, F.lit("abcdef")).otherwise(F.lit("abcdefghijklmnopqrstuvwxyz")), (F.pmod(byte(i), F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26))) + 1).cast("int"), F.lit(1)))
            .otherwise(c)
        )

    n = F.length(norm)
    long = F.substring(F.repeat(digest, F.ceil(n / 256).cast("int")), F.lit(1), n)
    rows = rows.withColumn("plain", F.when(n > LONG, long).when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), char), "")).otherwise(F.lit("")))
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    rows = rows.withColumn("right", F.when(kind == "card", F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), _luhn_ok)[0]))
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), n)
    rows = rows.withColumn("check", F.when(kind == "iban", 98 - _mod97(F.concat(account, country, F.lit("00")))))
    check = F.col("check")
    was_right = _mod97(F.concat(F.substring(norm, F.lit(5), n), F.substring(norm, 1, 4))) == 1
    digits = F.when(was_right, check).when(check == 98, 50).otherwise(check + 1)
    iban = F.concat(country, F.lpad(digits.cast("string"), 2, "0"), account)
    octet = [F.substring_index(F.substring_index(norm, ".", k), ".", -1).cast("int") for k in range(1, 5)]
    private = (octet[0] == 10) | (octet[0] == 127) | ((octet[0] == 192) & (octet[1] == 168)) | ((octet[0] == 172) & octet[1].between(16, 31))
    late = private & (octet[0] != 127) & F.lit(draw >= LENGTHEN_FROM)
    octet[0] = F.when(late, 10).otherwise(octet[0])
    fixed = F.when(octet[0].isin(10, 127), 1).when(private, 2).otherwise(0)
    public_first = F.pmod(byte(F.lit(1)), F.lit(112)) + 11  # 11 to 122: neither private nor reserved as a first octet
    drawn = [F.when(F.lit(k) < fixed, octet[k]).otherwise(public_first if k == 0 else F.pmod(byte(F.lit(k + 1)) * 251 + byte(F.lit(k + 9)), F.lit(254)) + 1).cast("string") for k in range(4)]
    cyrillic = norm.rlike(r"\p{IsCyrillic}")
    first = {g: F.when(cyrillic, F.concat(_pick(FIRST_CYRILLIC.get(g, FIRST_CYRILLIC["m"]), byte(F.lit(1))), _pick(SYLLABLES_CYRILLIC, byte(F.lit(2))) if draw >= 4 else F.lit("")))
             .otherwise(F.concat(_pick(FIRST[g], byte(F.lit(1))), _pick(SYLLABLES, byte(F.lit(2))) if draw >= 4 else F.lit(""))) for g in ("m", "f", "n")}
    named = F.when(gender == "m", first["m"]).when(gender == "f", first["f"]).otherwise(first["n"])
    last = F.when(cyrillic, F.concat(*(_pick(SYLLABLES_CYRILLIC, byte(F.lit(k))) for k in (1, 2, 3)), _pick(ENDINGS_CYRILLIC, byte(F.lit(4))))).otherwise(
        F.concat(*(_pick(SYLLABLES, byte(F.lit(k))) for k in (1, 2, 3)), _pick(ENDINGS, byte(F.lit(4)))))
    tail = F.when(kind == "phone", F.translate(digest, "abcdef", "012345")).otherwise(F.translate(digest, "0123456789", "ghijklmnop"))
    more = F.when(kind.isin("ip", "card", "ssn", "iban", "mac", "ipv6"), "").otherwise(F.substring(tail, 200, max(0, draw - LENGTHEN_FROM + 1)))
    form = (
        F.when(kind == "ip", F.concat_ws(".", *drawn)).when(kind == "card", F.col("right")).when(kind == "iban", iban).when(kind == "first", F.lower(named))
        .when(kind == "last", last).otherwise(plain)
    )
    return rows.select("kind", "norm", "gender", F.concat(form, more).alias("surrogate"))


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, norm and perhaps gender) to (kind, norm, surrogate), distinct within each kind and different from every part of it.

    A part's gender is m or f if the other of the two is not seen with it.
    """
    parts = parts if "gender" in parts.columns else parts.withColumn("gender", F.lit(None).cast("string"))
    told = [F.max((F.col("gender") == g).cast("int")) for g in ("m", "f")]
    gender = F.when((F.col("m") == 1) & (F.coalesce("f", F.lit(0)) == 0), "m").when((F.col("f") == 1) & (F.coalesce("m", F.lit(0)) == 0), "f").otherwise("n")
    space = checkpointed(parts.groupBy("kind", "norm").agg(told[0].alias("m"), told[1].alias("f")).select("kind", "norm", gender.alias("gender")))
    pending, done, taken = space, [], space.select("kind", F.col("norm").alias("used"))
    for draw in range(DRAWS):
        drawn = checkpointed(drawn_surrogates(pending, key, draw))
        best = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        good = best.join(taken.withColumnRenamed("used", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = checkpointed(good.select("kind", "norm", "surrogate"))
        done.append(good)
        pending = checkpointed(drawn.select("kind", "norm", "gender").join(good.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if pending.isEmpty():
            break
        taken = taken.unionByName(good.select("kind", F.col("surrogate").alias("used")))
    else:
        raise ValueError(f"no free surrogates in {DRAWS} draws")
    return reduce(DataFrame.unionByName, done)


def _laid(kind: Column, piece: Column, surrogate: Column) -> Column:
    """The surrogate in the case and grouping of the piece."""
    named = kind.isin("first", "last")
    bare = F.regexp_replace(piece, "[^A-Za-z0-9]", "")
    cased = F.when(F.upper(piece) == piece, F.upper(surrogate)).otherwise(F.initcap(surrogate))

    def char(i: Column) -> Column:
        c = F.substring(piece, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(piece, F.lit(1), i), "[^A-Za-z0-9]", ""))
        s = F.substring(surrogate, at, F.lit(1))
        return F.when(c.rlike("[A-Z]"), F.upper(s)).when(c.rlike("[a-z0-9]"), s).otherwise(c)

    laid = F.when(F.length(bare) > LONG, F.substring(surrogate, F.lit(1), F.length(bare))).when(F.length(piece) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(piece)), char), "")).otherwise(F.lit(""))
    return F.when(kind == "ip", surrogate).when(named, cased).otherwise(F.concat(laid, F.substring(surrogate, F.length(bare) + 1, F.lit(64))))


def entity_map(found: DataFrame, key: str) -> DataFrame:
    """(raw) entities to (raw, replacement)."""
    raws = checkpointed(found.select("raw").distinct())
    pieces = raws.select("raw", F.posexplode(_parts(F.col("raw"), _kind(F.col("raw")))).alias("at", "p")).select("raw", "at", "p.*")
    pieces = checkpointed(pieces.withColumn("norm", F.when(F.col("kind") != "", _norm(F.col("kind"), F.col("piece")))))
    known = surrogates(pieces.filter("kind <> '' AND norm <> ''"), key)
    laid = pieces.join(known, ["kind", "norm"], "left").withColumn("out", F.when(F.col("surrogate").isNull(), F.col("piece")).otherwise(_laid(F.col("kind"), F.col("piece"), F.col("surrogate"))))
    return laid.groupBy("raw").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), "").alias("replacement"))


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every entity of the text replaced by its surrogate; all columns stay.

    A null text stays null. key makes surrogates unguessable and is the same wherever they have to agree. With count_col,
    a column of that name has the number of entities replaced (in place of one that docs has by that name). Rows are
    handled one by one, whatever their ids; an empty table, or one without entities, comes back as it is. Columns may
    have any names: they travel as one struct.
    """
    columns = docs.columns
    others = [F.col(f"`{c}`") for c in columns if c not in (text_col, count_col)]
    rows = docs.select(F.struct(*others, F.lit(None).cast("boolean").alias("")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    without = rows.filter(~has_entities(F.col("text"))).select("row", "text", F.lit(0).cast("long").alias("n"))
    having = rows.filter(has_entities(F.col("text"))).withColumn("pattern", entity_pattern(F.col("text")))
    having = having.select("row", "text", "pattern", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("found"))
    having = checkpointed(having.withColumn("at", F.monotonically_increasing_id()))
    occurrences = checkpointed(having.select("at", F.posexplode("found").alias("pos", "raw")))
    replaced = checkpointed(entity_map(occurrences, key))
    outs = occurrences.join(replaced, "raw").groupBy("at").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "replacement"))), lambda x: x["replacement"]).alias("outs"))
    joined = having.join(outs, "at").withColumn("gaps", F.split("text", F.col("pattern"), -1))
    whole = F.concat(F.transform("outs", lambda e, i: F.concat(F.get("gaps", i), e)), F.array(F.element_at("gaps", -1)))
    changed = F.size(F.filter(F.zip_with("found", "outs", lambda a, b: a != b), lambda x: x))
    joined = joined.select("row", F.array_join(whole, "").alias("text"), changed.cast("long").alias("n"))
    out = without.unionByName(joined)
    kept = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns if c != count_col]
    return out.select(*kept, *([F.col("n").alias(count_col)] if count_col else []))

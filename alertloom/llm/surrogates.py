"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Mentions are found by pattern and brought into a canonical form (digits of a number, lower-case address), so that
mentions of one entity in any spelling get one surrogate, in every document: coreference holds. A surrogate is derived
from SHA-256 over key, kind, canonical form and attempt. It keeps kind and format: separators, letter case, length,
a card's network digit and Luhn check, an address's being private (and its range, while that has free addresses), a name's gender (from its title) and script. It is
poured back into each mention's own spelling.

Distinctness is checked, not assumed: over all entities of the corpus, two of a kind with equal surrogates, or a
surrogate that equals some entity's own canonical form, send all but one of them into the next attempt, until none is left.
First attempts are computed in the row; only entities that needed more are joined to their documents.

Null text stays null, empty stays empty. Repeated rows are replaced alike. All columns are kept; n_chars, where there
is one, follows the new text. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.store import saved

KEY = "training-text-surrogates"
#: More would mean that a kind has fewer surrogates than the corpus has entities.
MOST_ATTEMPTS = 40
#: From this attempt on, a private address may come from the largest private network, whatever its own.
WIDER = 4

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MALE = "Mr|Mister|Herr|Señor|Sr|Monsieur|Господин|г-н"
_FEMALE = "Mrs|Ms|Miss|Frau|Señora|Señorita|Sra|Madame|Mademoiselle|Mme|Mlle|Госпожа|г-жа"
_SECRET = r"(?:[Pp]assword|[Pp]asswd|pwd|PASSWORD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API_KEY)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: Kind and pattern; the first that matches a mention names its kind.
KINDS = {
    "secret": _SECRET + r"(?=[^\s\"']{0,200}[0-9])[^\s\"']{6,}",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "access_key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "card": r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\(?[2-9][0-9]{2}\)?[ .-]{1,2}[2-9][0-9]{2}[ .-][0-9]{4})(?![0-9])",
    "name": rf"(?<![\p{{L}}-])(?:{_MALE}|{_FEMALE})\.? \p{{Lu}}[\p{{Ll}}]+(?:[ -]\p{{Lu}}[\p{{Ll}}]+){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without a digit, an @ or one of the titles has no mention.
_TITLES = [f"{t}{end}" for t in f"{_MALE}|{_FEMALE}".split("|") for end in (" ", ". ")]


def _searchable(text: Column) -> Column:
    out = text.rlike("[0-9@]")
    for title in _TITLES:
        out = out | text.contains(title)
    return out


_GENDER = rf"^(?:{_FEMALE})\.? "
_TITLE = rf"^(?:{_MALE}|{_FEMALE})\.? "

# Syllables of made-up names; a name's end tells its gender.
_LATIN = ["Al", "Be", "Ca", "Do", "Er", "Fa", "Gi", "Ha", "Jo", "Ka", "Le", "Ma", "Ne", "Ol", "Pe", "Ro"]
_MIDDLE = ["ba", "de", "li", "mo", "ra", "se", "ti", "vo", "na", "ke", "lu", "mi", "no", "re", "so", "ve"]
_LATIN_END = {"m": ["n", "rd", "s", "k"], "f": ["na", "lia", "tta", "ra"]}
_CYRILLIC = ["Ал", "Бо", "Ва", "Ге", "Да", "Ев", "За", "Ив", "Ка", "Ле", "Ма", "Ни", "Ол", "Па", "Ро", "Са"]
_CYRILLIC_MIDDLE = ["ба", "де", "ли", "мо", "ра", "се", "ти", "во", "на", "ке", "лу", "ми", "но", "ре", "со", "ве"]
_CYRILLIC_END = {"m": ["н", "р", "с", "к"], "f": ["на", "лия", "та", "ра"]}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def kind_of(mention: Column) -> Column:
    out = F
    for kind, pattern in KINDS.items():
        # the surroundings were checked where the mention was found
        out = out.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind))
    return out.otherwise(F.lit("phone"))


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity have in common; the space between kinds is kept apart by the kind itself."""
    gender = F.when(mention.rlike(_GENDER), "f:").otherwise("m:")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), _digits(mention)))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(mention, f"^{_SECRET}", ""))
        .when(kind == "name", F.concat(gender, F.lower(F.regexp_replace(mention, _TITLE, ""))))
        .otherwise(mention)
    )


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """256 hexadecimal digits."""
    base = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(base, F.lit(f"\x1f{k}")), 256) for k in range(4)])


def _number(stream: Column, at: Column) -> Column:
    """16 bits of the stream, from the at-th digit pair on, round and round."""
    return F.conv(F.substring(stream, at * 2 % 252 + 1, F.lit(4)), 16, 10).cast("int")


def _letters(stream: Column, value: Column) -> Column:
    """Every digit and ASCII letter for another of its class; hexadecimal strings stay hexadecimal."""
    hexadecimal = value.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$")

    def other(c, i):
        n = _number(stream, i)
        return (
            F.when(hexadecimal, F.substring(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(97 + n % 26))
            .when(c.rlike("[A-Z]"), F.char(65 + n % 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _fresh_digits(stream: Column, value: Column) -> Column:
    """Other digits; the first of them never 0 or 1."""
    pick = lambda c, i: F.when(i == 0, _number(stream, i) % 8 + 2).otherwise(_number(stream, i) % 10).cast("string")
    return F.array_join(F.transform(F.split(value, ""), pick), "")


def _card(stream: Column, value: Column) -> Column:
    """The network's digit is kept, the last digit is the Luhn check."""
    body = F.concat(F.substring(value, 1, 1), _fresh_digits(stream, F.substring(value, F.lit(2), F.length(value) - 2)))

    def weight(c, i):
        # counted from the right, the digit beside the check digit is doubled
        twice = c.cast("int") * 2
        odd = (F.length(value) - 2 - i) % 2 == 0
        return F.when(odd, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    total = F.aggregate(F.transform(F.split(body, ""), weight), F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _address(stream: Column, value: Column, attempt: Column) -> Column:
    octet = lambda k: (_number(stream, F.lit(2 * k)) % 254 + 1).cast("string")
    first = (_number(stream, F.lit(0)) % 100 + 20).cast("string")  # 20 to 119: public
    head = (
        F.when(value.rlike(r"^10\.") | ((attempt >= WIDER) & value.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")), F.concat_ws(".", F.lit("10"), octet(1)))
        .when(value.rlike(r"^192\.168\."), F.lit("192.168"))
        .when(value.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), (_number(stream, F.lit(1)) % 16 + 16).cast("string")))
        .when(value.rlike(r"^127\."), F.concat_ws(".", F.lit("127"), octet(1)))
        .otherwise(F.concat_ws(".", first, octet(1)))
    )
    return F.concat_ws(".", head, octet(2), octet(3))


def _name(stream: Column, value: Column) -> Column:
    """As many parts as the name has; script and gender as the name's."""
    female, cyrillic = value.startswith("f:"), value.rlike("[а-яё]")
    parts = F.split(F.substring(value, F.lit(3), F.length(value)), "[ -]")

    def choice(latin: list[str], other: list[str], n: Column) -> Column:
        at = lambda x: F.element_at(F.array(*map(F.lit, x)), n % len(x) + 1)
        return F.when(cyrillic, at(other)).otherwise(at(latin))

    def part(_, i):
        n = lambda k: _number(stream, i * 10 + 2 * k)
        end = F.when(female, choice(_LATIN_END["f"], _CYRILLIC_END["f"], n(4))).otherwise(choice(_LATIN_END["m"], _CYRILLIC_END["m"], n(4)))
        middle = [choice(_MIDDLE, _CYRILLIC_MIDDLE, n(k)) for k in (1, 2, 3)]
        return F.concat(choice(_LATIN, _CYRILLIC, n(0)), *middle, end)

    return F.concat(F.substring(value, 1, 2), F.array_join(F.transform(parts, part), " "))


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """A canonical form of the same kind."""

    def made(stream):
        domain = F.substring_index(value, "@", -1)
        of_domain = _stream(key, F.lit("domain"), domain, attempt)
        labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)))
        plus = F.regexp_extract(value, r"^(\+[0-9])?(.*)$", 1)
        return (
            F.when(kind == "email", F.concat(_letters(stream, F.substring_index(value, "@", 1)), F.lit("@"), _letters(of_domain, labels), F.substring_index(domain, ".", -1)))
            .when(kind == "ip", _address(stream, value, attempt))
            .when(kind == "card", _card(stream, value))
            .when(kind == "ssn", _fresh_digits(stream, value))
            .when(kind == "phone", F.concat(plus, _fresh_digits(stream, F.substring(value, F.length(plus) + 1, F.length(value)))))
            .when(kind == "name", _name(stream, value))
            .when(kind.isin("access_key", "iban"), F.concat(F.substring(value, F.lit(1), F.when(kind == "iban", 2).otherwise(4)), _letters(stream, F.substring(value, F.when(kind == "iban", 3).otherwise(5), F.length(value)))))
            .otherwise(_letters(stream, value))
        )

    # the stream is an argument of the lambda, so that it is computed once
    return F.transform(F.array(_stream(key, kind, value, attempt)), made)[0]


def poured(kind: Column, mention: Column, value: Column) -> Column:
    """The surrogate in the mention's own spelling."""
    letters = F.split(mention, "")
    # digits take the places of digits, whatever separates them
    spelled = F.array_join(
        F.transform(
            letters,
            lambda c, i: F.when(
                c.rlike("[0-9A-Z]"),
                F.substring(value, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9A-Z]", "")), F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )
    cased = F.array_join(F.zip_with(letters, F.split(value, ""), lambda c, x: F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(x)), "")
    return (
        F.when(kind == "email", cased)
        .when(kind.isin("card", "ssn", "iban"), spelled)
        .when(kind == "phone", F.when(mention.startswith("+"), F.concat(F.lit("+"), F.array_join(F.transform(
            F.split(F.substring(mention, F.lit(2), F.length(mention)), ""),
            lambda c, i: F.when(c.rlike("[0-9]"), F.substring(value, F.length(_digits(F.substring(mention, F.lit(1), i + 2))) + 1, F.lit(1))).otherwise(c)), ""))).otherwise(spelled))
        .when(kind == "secret", F.concat(F.regexp_extract(mention, f"^{_SECRET}", 0), value))
        .when(kind == "name", F.concat(F.regexp_extract(mention, _TITLE, 0), F.substring(value, F.lit(3), F.length(value))))
        .otherwise(value)
    )


def _entity(mention: Column) -> Column:
    kind = kind_of(mention)
    return F.transform(F.array(kind), lambda k: F.struct(k.alias("kind"), canonical(k, mention).alias("value"), mention.alias("mention")))[0]


def mentions(text: Column) -> Column:
    """Kind, canonical form and spelling of every mention, in order; only texts with a sign of one are searched."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    none = F.array().cast("array<struct<kind:string,value:string,mention:string>>")
    return F.when(_searchable(text), F.transform(found, _entity)).otherwise(none)


def resolved(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate, attempt of each distinct entity, without collisions."""
    first = entities.withColumn("attempt", F.lit(0))
    known = saved(first.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))))
    for attempt in range(1, MOST_ATTEMPTS):
        # the least value of those with one surrogate keeps it; none may keep what is some entity's own form
        least = known.groupBy("kind", "surrogate").agg(F.min("value").alias("keeper"), F.count("*").alias("n"))
        taken = known.select("kind", F.col("value").alias("surrogate")).withColumn("own", F.lit(True))
        clash = least.join(taken, ["kind", "surrogate"], "left").where("n > 1 OR own").select("kind", "surrogate", "keeper", "own")
        clash = saved(clash)
        if clash.isEmpty():
            return known
        again = known.join(clash, ["kind", "surrogate"], "left")
        move = F.col("keeper").isNotNull() & (F.col("own") | (F.col("value") != F.col("keeper")))
        again = again.select("kind", "value", F.when(move, attempt).otherwise(F.col("attempt")).alias("attempt"), "surrogate", F.coalesce(move, F.lit(False)).alias("move"))
        new = surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))
        known = saved(again.withColumn("surrogate", F.when(F.col("move"), new).otherwise(F.col("surrogate"))).drop("move"))
    raise ValueError("a kind of entity has too few surrogates")


def replace(docs: DataFrame, key: str = KEY, found: str = "__mentions") -> DataFrame:
    """The documents with surrogates in their text, and in column `found` their mentions' kinds."""
    held = docs.withColumn(found, mentions(F.col("text")))
    entities = held.select(F.explode(found).alias("e")).select("e.kind", "e.value").distinct()
    moved = resolved(entities, key).where("attempt > 0").select("kind", "value", "surrogate")
    ready = F.transform(found, lambda e: poured(e.kind, e.mention, surrogate(key, e.kind, e.value, F.lit(0))))
    if not moved.isEmpty():
        # Documents with an entity of a later attempt: its places and what goes there.
        at, late = "__at", "__late"
        own = F.xxhash64("doc_id", "text")
        places = held.select(own.alias(at), F.posexplode(found).alias("pos", "e")).select(at, "pos", "e.*").distinct()
        places = places.join(moved, ["kind", "value"]).withColumn("surrogate", poured(F.col("kind"), F.col("mention"), F.col("surrogate")))
        places = places.groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("pos", "surrogate"))).alias(late))
        held = held.withColumn(at, own).join(places, at, "left")
        ready = F.transform(ready, lambda x, i: F.coalesce(F.try_element_at(F.col(late), i), x))
    pieces = F.split("text", PATTERN, -1)
    new = F.array_join(F.zip_with(pieces, ready, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = held.withColumn("text", F.when(F.size(found) > 0, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, changed).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, F.transform(found, lambda e: e.kind).alias(found))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its new text and its number of mentions by kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = replace(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("__mentions", lambda x: x == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", "text", F.size("__mentions").cast("long").alias("n_entities"), *map(count, KINDS))

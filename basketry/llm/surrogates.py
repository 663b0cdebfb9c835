"""Personal data replaced by keyed surrogates of the same type and format.

One regular expression finds the mentions. A mention's canonical form (digits of a number, lower-cased mail address or
name) and a secret key decide its surrogate, so equal entities get equal surrogates everywhere without a join. The
distinct entities are checked: a surrogate that two entities share, or that is itself an entity of the data, is drawn
again for all but one of them, in the end with more characters; only these few attempts are joined back to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.winnowing import let
from basketry.session import stage

#: Patterns by type, in the order in which they are tried.
TITLE = r"(?:Mrs|Mr|Ms|Miss|Herr|Frau|Madame|Monsieur|Señora|Señor)\.? "
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,20}[_-]){0,3}(?i:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    # with a country's number, then as written within one, in groups or as ten digits
    "phone": r"(?<![\d+])(?:\+(?=(?:[ .()-]{0,2}\d){7,15}(?!\d))\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){2,5}|(?<![\d-])1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"
    r"|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|(?<![\d-])\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}|(?<![\d.,-])[2-9]\d{9}(?![.,]\d))(?![\d-])",
    "name": TITLE + r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
PATTERN = "|".join(PATTERNS.values())
#: Cheap test that spares most texts the search; every pattern needs one of these.
HINT = r"[0-9@]|(?i:passw|token|secret|key)|AKIA|ASIA|Mrs?\b|Ms\b|Miss\b|Herr\b|Frau\b|Madame\b|Monsieur\b|Señora?\b"
#: Letters by script: vowels give vowels, others others. A script not listed keeps its letters.
ALPHABETS = [("aeiou", "bcdfghklmnprstvz"), ("аеиоу", "бвгдклмнпрст"), ("αειου", "βγδκλμνπρστ")]
#: So many draws keep an entity's length; after every so many more its surrogate is a character longer, and there is room.
SAME_LENGTH, LONGER = 12, 4
#: Rounds of draws after which an entity that cannot grow (a network address) has no free surrogate, which is an error.
ROUNDS = 400
_PREFIX = r"^(.*?[=:]\s*[\"']?)"


def kind_of(mention: Column) -> Column:
    kind = None
    for name, pattern in PATTERNS.items():
        kind = (F if kind is None else kind).when(mention.rlike(f"^(?:{pattern})$"), F.lit(name))
    return kind


def canonical(kind: Column, mention: Column) -> Column:
    """What coreferent mentions share."""
    return (
        F.when(kind.isin("ssn", "phone", "card"), F.regexp_replace(mention, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "secret", F.regexp_replace(mention, _PREFIX, ""))
        .when(kind == "name", F.lower(F.regexp_replace(mention, "^" + TITLE, "")))
        .when(kind == "email", F.lower(mention))
        .otherwise(mention)
    )


def _draw(stream: Column, i: Column, n: int) -> Column:
    """A number below n from place i of a stream of hex digits, used in turn."""
    return F.pmod(F.conv(F.substr(stream, F.pmod((i - 1) * 3, F.lit(120)) + 1, F.lit(3)), 16, 10).cast("int"), F.lit(n))


def _letters(letters: str, at: Column) -> Column:
    return F.substr(F.lit(letters), at + 1, F.lit(1))


def _by_place(value: Column, stream: Column) -> Column:
    """Digits for digits, ASCII letters for letters of the same case; hexadecimal values stay hexadecimal."""
    hexadecimal = value.rlike("^[0-9a-f]+$")

    def one(i: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), _draw(stream, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), F.when(hexadecimal, _letters("abcdef", _draw(stream, i, 6))).otherwise(_letters("abcdefghijklmnopqrstuvwxyz", _draw(stream, i, 26))))
            .when(c.rlike("[A-Z]"), _letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _draw(stream, i, 26)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _name(value: Column, stream: Column) -> Column:
    """Letters of the same script, case and vowel or consonant nature; a word's last letter, which marks gender, stays."""

    def one(i: Column) -> Column:
        c, after = F.substr(value, i, F.lit(1)), F.substr(value, i + 1, F.lit(1))
        low = F.lower(c)
        out = low
        for vowels, others in ALPHABETS:
            accented = "àáâäãèéêëìíîïòóôöõùúûü" if vowels == "aeiou" else ""
            consonant = "[a-zçñßœæø]" if vowels == "aeiou" else "[а-яё]" if vowels[0] == "а" else "[α-ω]"
            out = (
                F.when(low.rlike(f"[{vowels}{accented}]"), _letters(vowels, _draw(stream, i, len(vowels))))
                .when(low.rlike(consonant), _letters(others, _draw(stream, i, len(others))))
                .otherwise(out)
            )
        kept = (after == "") | after.rlike("[^\\p{L}]")
        return F.when(kept, c).when(c != low, F.upper(out)).otherwise(out)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _digits_into(mention: Column, digits: Column) -> Column:
    """The mention with its digits replaced one by one."""

    def one(i: Column) -> Column:
        c = F.substr(mention, i, F.lit(1))
        nth = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), one), "")


def _extra(attempt: Column, stream: Column, letters: Column) -> Column:
    """Characters by which the surrogate of a late attempt is longer."""
    more = F.greatest(F.lit(0), F.ceil((attempt - (SAME_LENGTH - 1)) / F.lit(LONGER)).cast("int"))
    drawn = lambda i: F.substr(letters, F.pmod(F.conv(F.substr(stream, F.pmod(i * 3 + 61, F.lit(120)) + 1, F.lit(3)), 16, 10).cast("int"), F.length(letters)) + 1, F.lit(1))
    return F.when(more == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), drawn), ""))


def _alphabet(name: Column) -> Column:
    """Consonants of the script of a name."""
    return F.when(name.rlike("[а-яёА-ЯЁ]"), ALPHABETS[1][1]).when(name.rlike("[α-ωΑ-Ω]"), ALPHABETS[2][1]).otherwise(ALPHABETS[0][1])


def surrogate(kind: Column, mention: Column, attempt: Column, key: str) -> Column:
    """The replacement of a mention; equal for equal (kind, canonical form, attempt) but for the mention's format."""

    def of(entity: Column) -> Column:
        return let(F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 512), lambda stream: of_stream(entity, stream))

    def of_stream(entity: Column, stream: Column) -> Column:
        mapped = _by_place(entity, stream)
        # the first digit of a number stays in its range: no leading zero, and the network of a card
        number = F.concat(F.substr(entity, F.lit(1), F.lit(1)), F.substr(mapped, F.lit(2)))
        body = F.substr(number, F.lit(1), F.length(number) - 1)
        valid = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda x: F.call_function("luhn_check", x))[0]
        card = F.when(F.call_function("luhn_check", entity), valid).otherwise(number)
        ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(stream, i, 254) + 1).cast("string")), ".")
        domain = F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.substring_index(entity, "@", -1)), 256), F.lit(1), F.lit(8))
        local = F.substring_index(entity, "@", 1)
        digits = _extra(attempt, stream, F.lit("0123456789"))
        mail = F.concat(_by_place(local, stream), _extra(attempt, stream, F.lit("abcdef")), F.lit("@m"), domain, F.lit(".example.org"))
        compact = F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.substr(mapped, F.lit(3)))
        title = F.regexp_extract(mention, "^(" + TITLE + ")", 1)
        plain = F.regexp_replace(mention, "^" + TITLE, "")
        named = _name(plain, stream)
        # longer names grow before their last letter, which stays
        longer = F.concat(F.substr(named, F.lit(1), F.length(named) - 1), _extra(attempt, stream, _alphabet(plain)), F.substr(named, F.length(named)))
        return (
            F.when(kind == "email", mail)
            .when(kind == "ip", ip)
            .when(kind == "card", F.concat(_digits_into(mention, card), digits))
            .when(kind.isin("ssn", "phone"), F.concat(_digits_into(mention, number), digits))
            .when(kind == "iban", F.concat(compact, digits))
            .when(kind == "access_key", F.concat(F.substr(entity, F.lit(1), F.lit(4)), F.substr(mapped, F.lit(5)), digits))
            .when(kind == "secret", F.concat(F.regexp_extract(mention, _PREFIX, 1), mapped, digits))
            .otherwise(F.concat(title, longer))
        )

    return let(canonical(kind, mention), of)


def _mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def retries(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate is taken. ``entities``: distinct (kind, entity).

    Draws go on until every surrogate is free; late ones are longer, so that there is room for any number of entities.
    """
    current = stage(entities.withColumn("attempt", F.lit(0)), "entities")
    for _ in range(ROUNDS):
        # what is drawn is checked as a mention of its type, whatever its canonical form leaves out
        drawn = current.repartition("kind", "entity").withColumn("drawn", canonical(F.col("kind"), surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)))
        drawn = stage(drawn, "drawn")
        # the entity drawn earliest keeps it: lower attempt, then smaller name
        owner = drawn.groupBy("kind", "drawn").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "entity")).alias("owner")).where("n > 1")
        shared = drawn.join(owner, ["kind", "drawn"]).where(F.struct("attempt", "entity") != F.col("owner")).select("kind", "entity")
        real = drawn.join(entities.select("kind", F.col("entity").alias("drawn")), ["kind", "drawn"], "left_semi").select("kind", "entity")
        again = stage(shared.union(real).distinct(), "taken")
        if again.limit(1).count() == 0:
            return current.where("attempt > 0")
        more = current.join(again.withColumn("more", F.lit(1)), ["kind", "entity"], "left")
        current = stage(more.select("kind", "entity", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "entities")
    left = again.groupBy("kind").count().collect()
    raise RuntimeError("no free surrogates: " + ", ".join(f"{r['count']} of type {r.kind}" for r in left))


def _free(name: str, taken: list[str]) -> str:
    """A column name that the input does not have."""
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def pseudonymise(docs: DataFrame, key: str = "change this key", text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and the column n_entities (mentions replaced).

    Null texts stay null and empty ones empty, with no entities. Equal entities have equal surrogates in all rows,
    repeated rows too; different entities of a type differ, and no surrogate is an entity of the data. Other columns
    pass through, whatever their names, but for an own ``n_entities``, which is replaced.
    """
    value = F.col(text)
    found = docs.select(F.explode(_mentions(value)).alias("mention")).select(kind_of(F.col("mention")).alias("kind"), "mention")
    entities = found.where("kind is not null").select("kind", canonical(F.col("kind"), F.col("mention")).alias("entity")).distinct()
    entities = stage(entities, "entities")
    taken = stage(retries(entities, key), "retries")
    names = docs.columns
    attempts, hashed, new_text = (_free(c, names) for c in ("attempts", "hash", "new"))
    if taken.limit(1).count() == 0:
        marked = docs.withColumn(attempts, F.lit(None).cast("map<string,int>"))
    else:
        by_text = (
            docs.select(F.xxhash64(value).alias(hashed), F.explode(_mentions(value)).alias("mention"))
            .select(hashed, kind_of(F.col("mention")).alias("kind"), "mention")
            .withColumn("entity", canonical(F.col("kind"), F.col("mention")))
            .join(taken, ["kind", "entity"])
            .groupBy(hashed)
            .agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "entity"), "attempt"))).alias(attempts))
        )
        marked = docs.withColumn(hashed, F.xxhash64(value)).join(stage(by_text, "attempts"), hashed, "left")

    def replaced(mention: Column) -> Column:
        def of(kind: Column) -> Column:
            attempt = F.coalesce(F.element_at(F.col(attempts), F.concat_ws("|", kind, canonical(kind, mention))), F.lit(0))
            return F.coalesce(surrogate(kind, mention, attempt, key), mention)

        return let(kind_of(mention), of)

    def rebuilt(mentions: Column) -> Column:
        gaps = F.split(value, PATTERN, -1)
        filled = F.zip_with(gaps, F.transform(mentions, replaced), lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))
        joined = F.array_join(F.flatten(filled), "")
        return F.when(F.size(mentions) == 0, F.struct(value.alias("t"), F.lit(0).alias("n"))).otherwise(F.struct(joined.alias("t"), F.size(mentions).alias("n")))

    new = let(_mentions(value), rebuilt)
    out = marked.withColumn(new_text, new)
    columns = [F.col(new_text)["t"].alias(text) if c == text else F.col(f"`{c}`") for c in names if c != "n_entities"]
    return out.select(*columns, F.coalesce(F.col(new_text)["n"], F.lit(0)).cast("long").alias("n_entities"))

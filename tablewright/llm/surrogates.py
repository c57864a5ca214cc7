"""Surrogates for personal data: keyed, of the same kind and format, distinct, and the same for every mention.

Built from DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import read
from tablewright.sources.staging import stage

KEY = "surrogate-key"
#: Given names by gender and family names that surrogates are taken from first; invented ones follow where these run out.
FEMALE = "Alice Anna Carla Clara Diana Elena Emma Eva Helen Ines Irene Julia Laura Lena Lucia Maria Marta Nina Olga Paula Rosa Sara Sofia Vera".split()
MALE = "Adam Alan Boris Carl Daniel David Emil Erik Felix Hugo Ivan Jan John Leon Luis Marc Martin Oscar Pablo Paul Peter Simon Thomas Victor".split()
FAMILY = ("Abel Adler Bauer Becker Blanc Brown Campos Castro Clark Cruz Dubois Duran Evans Fischer Fontaine Garcia Girard Hill Huber Keller "
          "King Lambert Lopez Marin Martel Moreno Moser Navarro Olsen Parker Perez Reed Renard Rivera Roth Santos Schmidt Silva Stone Vidal Wagner Weber White Wolf").split()
HONORIFIC_F, HONORIFIC_M = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа", "Mr|Herr|Monsieur|Señor|Sr|Г-н"
_GIVEN = "|".join(FEMALE + MALE)
_GAP = r"[ \t\x{A0}]+"
_NAME = r"\p{Lu}(?:[\p{Ll}\p{M}]+|['’]\p{Lu}[\p{Ll}\p{M}]+)(?:['’-]?\p{Lu}[\p{Ll}\p{M}]+)*"
#: Small words and initials between the words of a name.
_LINK = r"(?:de(?: la| las| los| el)?|del|della|da|das|dos|di|du|van(?: der| den| de)?|von(?: der| den)?|vom|zu|zum|ter|bin|ibn|\p{Lu}\.)"
_NEXT = rf"{_GAP}(?:{_LINK}{_GAP})*{_NAME}"
_PERSON = rf"\b(?:{HONORIFIC_F}|{HONORIFIC_M})\.?(?:{_NEXT})+|\b(?:{_GIVEN})(?:-{_NAME})?(?:{_NEXT})+"
#: Words before a secret in any case, also as the end of a longer name, with optional quotes and blanks around the sign.
_SECRET = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key)"
_BEFORE = r"""(?i:[_-](?:access[_-])?key)?["']?[ \t]*[=:]{1,2}>?[ \t]*"""
_BARE = r"""[^\s"'`,;&|<>()\[\]{}]{5,}[\p{L}\p{N}_+/=$-]"""
_CARD = r"[0-9]{4}(?:[ -]?[0-9]{4}){3}(?!\p{N}|-[0-9])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\p{N}|-[0-9])"
#: A further group of a phone number; after a blank, not the start of a number with points, a card or an SSN.
_GROUP = rf"(?:-?| (?![0-9]+\.[0-9]|{_CARD}|{_SSN}))[0-9]{{2,4}}"
_PARTS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": rf"""(?<![\p{{L}}\p{{N}}]){_SECRET}{_BEFORE}(?:"[^"\n]{{4,}}"|'[^'\n]{{4,}}'|["'`]?{_BARE})""",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "hex": r"\b(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,}\b",
    "card": rf"(?<![\p{{N}}.-]){_CARD}",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}]|\.[0-9])",
    "phone": r"\+(?:1[ -]?\(?[0-9]{3}\)?|[0-9]{1,3}[ -]?\([0-9]{3}\))[ -]?[0-9]{3}[ -]?[0-9]{4}(?!\p{N}|-[0-9])"
             rf"|(?=\+(?:[ ()-]*[0-9]){{7}})\+[0-9]{{1,3}}[ -]?\(?[0-9]{{1,4}}\)?(?:{_GROUP}){{2,4}}(?!\p{{N}})"
             r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!\p{N})",
    "ssn": rf"(?<![\p{{N}}-]){_SSN}",
    "person": _PERSON,
}
PATTERN = "|".join(_PARTS.values())
#: Every mention has one of these signs or words; texts without them need no closer look.
HINT = rf"[0-9@]|AKIA|{_SECRET}|\b(?:{HONORIFIC_F}|{HONORIFIC_M})\b|\b(?:{_GIVEN})[ \t\x{{A0}}-]"
#: Tries with names of the lists; later ones invent a name of the same script and length or longer.
LISTED_TRIES = 3
MOST_TRIES = 64
BROADCAST_ROWS = 200_000


def mentions(texts: DataFrame) -> DataFrame:
    """k1, k2 (text), at, part, kind, value: what is replaced in each text, in order.

    A person's name is taken apart, so that a family name keeps one surrogate with and without the given name;
    parts of the kind `plain` stay (titles, initials and small words of names, and the signs around a secret).
    """
    found = texts.select("k1", "k2", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("at", "mention"))
    kind = F.coalesce(*[F.when(F.col("mention").rlike(rf"^(?:{p})$"), k) for k, p in _PARTS.items()])
    found = found.withColumn("kind", kind)
    words = F.regexp_extract_all("mention", F.lit(rf"{_GAP}|[^ \t\x{{A0}}]+"), F.lit(0))
    title = F.element_at(words, 1)
    titled = title.rlike(rf"^(?:{HONORIFIC_F}|{HONORIFIC_M})\.?$")
    female = title.rlike(rf"^(?:{HONORIFIC_F})\.?$") | F.substring_index(title, "-", 1).isin(FEMALE)
    person = F.transform(words, lambda w, i: F.struct(
        F.when(((i == 0) & titled) | w.rlike(rf"^(?:{_GAP}|{_LINK}|\p{{Ll}}+)$"), "plain").when(i == F.size(words) - 1, "family")
        .when(w.isin(FEMALE), "given_f").when(w.isin(MALE), "given_m").when(female, "given_f").otherwise("given_m").alias("kind"), w.alias("value")))
    prefix = F.regexp_extract("mention", rf"""^{_SECRET}{_BEFORE}["'`]?""", 0)
    rest = F.substr("mention", F.length(prefix) + 1)
    # Only a quoted secret ends with a quote.
    closing = F.regexp_extract(rest, "[\"']$", 0)
    value = F.substr(rest, F.lit(1), F.length(rest) - F.length(closing))
    # An address or key after such a word gets the surrogate it has elsewhere.
    inner = F.coalesce(*[F.when(value.rlike(rf"^(?:{p})$"), k) for k, p in _PARTS.items() if k not in ("secret", "person")], F.lit("secret"))
    secret = F.array(F.struct(F.lit("plain").alias("kind"), prefix.alias("value")), F.struct(inner.alias("kind"), value.alias("value")),
                     F.struct(F.lit("plain").alias("kind"), closing.alias("value")))
    whole = F.array(F.struct(F.col("kind").alias("kind"), F.col("mention").alias("value")))
    parts = F.when(F.col("kind") == "person", person).when(F.col("kind") == "secret", secret).otherwise(whole)
    return found.select("k1", "k2", "at", F.posexplode(parts).alias("part", "x")).select("k1", "k2", "at", "part", "x.*")


def stream(value: Column, attempt: int, key: str) -> Column:
    """512 hex digits that only the key's owner can tell from the value."""
    return F.concat(*[F.sha2(F.concat_ws("\x01", F.lit(key), F.col("kind"), value, F.lit(attempt), F.lit(i)), 256) for i in range(8)])


def like(value: Column, noise: Column) -> Column:
    """A text of the value's format: digits for digits, letters of the same case and script for letters, other signs kept."""

    def sign(c: Column, i: Column) -> Column:
        x = F.conv(F.substr(noise, i % 256 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return (F.when(c.rlike("[0-9]"), (x % 10).cast("string"))
                .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), F.substr(F.lit("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), x % 28 + 1, F.lit(1)))
                .when(c.rlike(r"\p{IsCyrillic}"), F.substr(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), x % 27 + 1, F.lit(1)))
                .when(c.rlike(r"\p{IsGreek}") & c.rlike(r"\p{Lu}"), F.substr(F.lit("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), x % 24 + 1, F.lit(1)))
                .when(c.rlike(r"\p{IsGreek}"), F.substr(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), x % 24 + 1, F.lit(1)))
                .when(c.rlike(r"\p{Lu}"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), x % 26 + 1, F.lit(1)))
                .when(c.rlike(r"\p{L}"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), x % 26 + 1, F.lit(1))).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), sign), "")


def number(noise: Column, at: int) -> Column:
    return F.conv(F.substr(noise, F.lit(at), F.lit(4)), 16, 10).cast("int")


def luhn(digits: Column) -> Column:
    """Sum of the checksum of card numbers over a text of digits, doubling every second digit from the last but one."""
    size = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def proposal(attempt: int, key: str) -> Column:
    """A surrogate for the row's `kind` and `value`."""
    value, noise = F.col("value"), F.col("noise")
    # A secret of few letters and digits has few of its format; later tries are longer.
    made = like(value if attempt < LISTED_TRIES else F.when(F.col("kind") == "secret", F.concat(value, F.lit("abcdefgh"[: attempt // LISTED_TRIES]))).otherwise(value), noise)
    host = F.regexp_extract(value, "@(.*)$", 1)
    # The same host gets the same surrogate in every address; its last label stays.
    host_noise = F.concat(*[F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("host"), F.lower(host), F.lit(i)), 256) for i in range(8)])
    email = F.concat(like(F.regexp_extract(value, "^[^@]*", 0), noise), F.lit("@"), like(F.regexp_extract(host, r"^(.*)\.", 1), host_noise),
                     F.regexp_extract(host, r"\.[^.]*$", 0))
    hexed = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[A-F]"), F.upper(F.substr(noise, i % 512 + 1, F.lit(1)))).otherwise(F.substr(noise, i % 512 + 1, F.lit(1)))), "")
    hexed = F.when(value.rlike("[A-F]") & ~value.rlike("[a-f]"), F.upper(hexed)).otherwise(hexed)
    body = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(made, F.lit(2), F.length(made) - 2))
    check = F.pmod(F.lit(10) - luhn(F.concat(F.regexp_replace(body, "[^0-9]", ""), F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.when(luhn(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0, F.concat(body, check)).otherwise(F.concat(body, F.substr(made, F.length(made), F.lit(1))))
    ip = F.concat_ws(".", number(noise, 1) % 223 + 1, number(noise, 5) % 256, number(noise, 9) % 256, number(noise, 13) % 254 + 1)
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ -(])", 0)
    phone = F.concat(code, F.substr(made, F.length(code) + 1, F.length(made)))
    access = F.concat(F.lit("AKIA"), F.substr(made, F.lit(5), F.length(made)))

    def listed(names: list[str]) -> Column:
        own = value if attempt < 2 * LISTED_TRIES else F.concat(value, F.lit("abcdefgh"[: attempt // LISTED_TRIES]))
        invented = like(own, noise)
        if attempt >= LISTED_TRIES:
            return invented
        return F.when(value.rlike(r"^[\p{IsLatin}-]+$"), F.element_at(F.array(*[F.lit(n) for n in names]), number(noise, 1) % len(names) + 1)).otherwise(invented)

    kind = F.col("kind")
    return (F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "key", access)
            .when((kind == "hex") | ((kind == "secret") & value.rlike("^([0-9a-f]+|[0-9A-F]+)$") & F.lit(attempt < LISTED_TRIES)), hexed)
            .when(kind == "given_f", listed(FEMALE)).when(kind == "given_m", listed(MALE)).when(kind == "family", listed(FAMILY)).otherwise(made))


def assign(values: DataFrame, key: str = KEY) -> DataFrame:
    """kind, value, surrogate of distinct `values` (kind, value): no two values of a kind share one, and none is itself a value.

    Proposals that collide are tried anew with the next attempt; of several values with one
    proposal the smallest keeps it.
    """
    originals = values.select("kind", F.col("value").alias("surrogate"))
    open_, done = values, None
    for attempt in range(MOST_TRIES):
        tried = open_.withColumn("noise", stream(F.col("value"), attempt, key)).select("kind", "value", proposal(attempt, key).alias("surrogate"))
        tried = stage(tried, "surrogate-tried")
        free = tried.join(originals, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = stage(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"), "surrogate-won")
        done = won if done is None else done.unionByName(won)
        open_ = stage(tried.select("kind", "value").join(won, ["kind", "value"], "left_anti"), "surrogate-open")
        if open_.isEmpty():
            return done
    raise ValueError(f"no distinct surrogates for some values after {MOST_TRIES} tries: too many values for their formats")


def replace_entities(documents: DataFrame, key: str = KEY) -> DataFrame:
    """`documents` (doc_id, text) with surrogates in place of addresses, numbers, secrets and names; doc_id, text, replaced.

    `replaced` counts the mentions. Every mention of a value gets the same surrogate in all documents, different values
    different ones. NULL and empty texts stay as they are; repeated rows give repeated rows; other columns
    are not kept.
    """
    docs = documents.select(F.col("doc_id").cast("long"), "text").withColumn("hinted", F.coalesce(F.col("text").rlike(HINT), F.lit(False)))
    keys = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    hinted = docs.where("hinted").select("doc_id", "text", *keys)
    found = stage(mentions(hinted).distinct(), "surrogate-mentions")
    values = stage(found.where("kind <> 'plain'").select("kind", "value").distinct(), "surrogate-values")
    surrogates = stage(assign(values, key), "surrogate-map")
    named = found.join(F.broadcast(surrogates) if surrogates.count() <= BROADCAST_ROWS else surrogates, ["kind", "value"], "left")
    made = (named.groupBy("k1", "k2", "at").agg(F.array_sort(F.collect_list(F.struct("part", "kind", F.coalesce("surrogate", "value").alias("new")))).alias("parts"))
            .select("k1", "k2", "at", F.array_join("parts.new", "").alias("new")))
    whole = stage(made.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("news")).select("k1", "k2", F.col("news.new").alias("news")), "surrogate-texts")
    gaps = F.split("text", PATTERN, -1)
    # A gap and the surrogate after it, in turn; the last gap has none.
    text = F.array_join(F.flatten(F.zip_with(gaps, "news", lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    dirty = hinted.join(whole, ["k1", "k2"], "left").select(
        "doc_id", F.when(F.col("news").isNull(), F.col("text")).otherwise(text).alias("text"), F.when(F.col("news").isNull(), 0).otherwise(F.size("news")).alias("replaced"))
    clean = docs.where(~F.col("hinted")).select("doc_id", "text", F.lit(0).alias("replaced"))
    return clean.unionByName(dirty)


def op4_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return replace_entities(read(spark, folder, "documents"))

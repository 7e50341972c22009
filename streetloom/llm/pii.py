"""Personal data replaced by surrogates, in DataFrame operations only.

Entities are found by one pattern, read once over each text: names after forms of address,
mail addresses, telephone numbers, bank cards and accounts, social security numbers, network
addresses and secrets. In a text with a name, the words of that name are looked for again
without the form of address.

Each entity gets a keyed surrogate of its own type, script and format: digits for digits and
letters for letters with all separators kept, the country code of a number, the check digits
of cards and accounts, an address for an address. What is one entity is decided on a
canonical form (addresses in lower case, numbers by their digits), so all its spellings
share a surrogate, each in its own format. Names are replaced word by word, so that a person
keeps one family name with and without the given name; given names, and Cyrillic family
names, get the gender of the forms of address that the corpus has for them.

Surrogates must keep entities apart: the distinct entities of the whole corpus are dealt
by their candidate surrogate, one entity keeps it, and the others draw again with a counter
in the key, as do those whose candidate is an entity of the corpus itself, until none is
left. Surrogates that many attempts find taken lengthen, names and addresses by syllables,
all others by digits behind their format, so that they cannot run out. What a document's
spans become then follows from a join on the entity.

Not looked for, so left in the text: names that no form of address introduces anywhere in
their text, initials, national numbers without separators, postal addresses, and secrets
that have none of the forms below.

The key of the HMAC is a parameter; `KEY_SETTING` names the session's setting that the
registered query takes it from. The default is public and protects nothing. Who has the key
and the entities can compute the surrogates, nobody else.

Defined cases: a null text stays null; an empty text and one without entities stay as they
are; an entity in many documents meets its surrogate in a join that adaptive execution
splits; null ids and repeated rows are rows like others; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

KEY = "streetloom"
KEY_SETTING = "spark.streetloom.pii.key"

# Patterns of entities, forms of address, country codes, and parts of surrogate names.
EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}-]+\.)+[\p{L}\p{N}-]+"
ACCESS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
TOKEN = r"\b(?:gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|xox[abprs]-[0-9A-Za-z-]{10,72})\b"
HEX = r"\b[0-9a-fA-F]{32,64}\b"
IP = r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"
IPV6 = r"(?<![\w:])(?=[0-9a-fA-F:]*\d)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\w:])"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"\b(?:\d{4}(?:[ -]?\d{4}){3}(?:[ -]?\d{1,3})?|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b(?:1[-.])?\d{3}([-.])\d{3}\1\d{4}\b|\b0\d{1,4}[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2}\b"
COUNTRY = r"^\+(?:1|7|2[07]|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MALE = r"Mr\.?|MR\.?|Herr|Señor|Sr\.|Monsieur|господин|г-н"
FEMALE = r"Mrs\.?|MRS\.?|Ms\.?|MS\.?|Miss|Frau|Señora|Señorita|Sra\.|Madame|Mademoiselle|Mme|Mlle|госпожа|г-жа"
NEUTRAL = r"Dr\.?|DR\.?|Prof\.?|Professor|Doctor"
TITLES = rf"(?:(?:{MALE}|{FEMALE}|{NEUTRAL}) )+(?:\p{{Lu}}\. ?)*"
NAME_WORD = r"\p{Lu}\p{L}+(?:['’]\p{L}+)*|\p{Lu}['’]\p{L}+"
NAME = rf"(?<![\p{{L}}\d]){TITLES}(?:{NAME_WORD})(?:[ -](?:{NAME_WORD})){{0,3}}"
ANY = "|".join([NAME, EMAIL, ACCESS_KEY, TOKEN, IBAN, HEX, IPV6, CARD, IP, SSN, PHONE.replace(r"\1", r"\k<sep>").replace("([-.])", "(?<sep>[-.])")])
ONSET = {"latin": "b c d f g h j k l m n p r s t v".split(), "cyrillic": "б в г д ж з к л м н п р с т ф х".split()}
VOWEL = {"latin": "a e i o".split(), "cyrillic": "а е и о".split()}
GIVEN_END = {("m", "latin"): "o us an rik".split(), ("f", "latin"): "a ina elle ia".split(), ("m", "cyrillic"): "ан ор ий ей".split(), ("f", "cyrillic"): "а ина ия елла".split()}
FAMILY_END = {("m", "cyrillic"): "ов ин".split(), ("f", "cyrillic"): "ова ина".split()}
#: Attempts at one length of surrogates.
LONGER = 10
#: Kinds whose canonical form has digits only.
DIGITS = ("card", "ssn", "phone")


def kind(value: Column) -> Column:
    whole = lambda p: value.rlike(rf"^(?:{p})$")
    cases = [("name", NAME.replace(r"(?<![\p{L}\d])", "")), ("email", EMAIL), ("access_key", ACCESS_KEY), ("token", TOKEN), ("iban", IBAN), ("hex", HEX), ("ipv6", IPV6), ("card", CARD), ("ip", IP), ("ssn", SSN)]
    out = F
    for name, pattern in cases:
        out = out.when(whole(pattern), F.lit(name))
    return out.when(value.rlike(r"\d"), F.lit("phone")).otherwise(F.lit("name"))


def canonical(kind_: Column, value: Column) -> Column:
    """What all spellings of an entity share."""
    digits = F.regexp_replace(value, r"\D+", "")
    return (
        F.when(kind_.isin("email", "hex", "ipv6", "family", "given"), F.lower(value))
        .when(kind_ == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits))
        .when(kind_.isin("card", "ssn"), digits)
        .when(kind_ == "iban", F.regexp_replace(value, " ", ""))
        .otherwise(value)
    )


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 as 128 hexadecimal digits."""
    import hashlib

    secret = key.encode()
    secret = (hashlib.sha512(secret).digest() if len(secret) > 128 else secret).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def _number(digest: Column, nth: Column | int, below: int) -> Column:
    """A number below a bound from four digits of the digest."""
    at = F.lit(nth) if isinstance(nth, int) else nth
    return (F.conv(digest.substr((at * 2 % 124 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") + (at * 7).cast("int")) % below


def _pick(items: list[str], digest: Column, nth: Column | int) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), _number(digest, nth, len(items)) + 1)


def candidate(kind_: Column, known: Column, gender: Column, digest: Column, attempt: int = 0) -> Column:
    """The surrogate of a canonical form; it is one step longer for every LONGER attempts before."""
    more = attempt // LONGER
    n = F.length(known)

    def scrambled(keep: Column | int = 0, short: int = 0) -> Column:
        """Each character for one of its class, digits behind the end."""

        def one(i: Column) -> Column:
            c = known.substr(i, F.lit(1))
            return (
                F.when(i <= keep, c)
                .when((kind_.isin("hex", "ipv6")) & c.rlike("[0-9a-f]"), _pick(list("0123456789abcdef"), digest, i))
                .when(c.rlike("[0-9]") | (i > n), _pick(list("0123456789"), digest, i))
                .when(c.rlike("[a-z]"), _pick(list("abcdefghijklmnopqrstuvwxyz"), digest, i))
                .when(c.rlike("[A-Z]"), _pick(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), digest, i))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n - short, F.lit(1)) + more), one), "")

    def syllables(script: str, n_syllables: int, first: int) -> Column:
        return F.concat(F.lit(""), *(x for k in range(n_syllables) for x in (_pick(ONSET[script], digest, first + 3 * k), _pick(VOWEL[script], digest, first + 3 * k + 1))))

    domain = F.concat(F.lit("mail"), _number(digest, 57, 1000).cast("string"), F.lit(".example.net"))
    email = F.concat(syllables("latin", 4 + more, 0), F.lit("."), F.lpad(_number(digest, 50, 100).cast("string"), 2, "0"), F.lit("@"), domain)
    ip = F.concat_ws(".", *((_number(digest, 9 * k, 254) + 1).cast("string") for k in range(4)))
    if more:  # as if with a port
        ip = F.concat(ip, F.lit(":"), *(_number(digest, 40 + k, 10).cast("string") for k in range(more)))
    body = scrambled(1, short=1)
    check = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(body, d))), 1)
    card = F.when(F.call_function("luhn_check", known), F.concat(body, check)).otherwise(scrambled(1))
    account = F.substring(scrambled(4), 5, 1000)
    moved = F.split(F.concat(account, F.substring(known, 1, 2), F.lit("00")), "")
    rest = F.aggregate(moved, F.lit(0), lambda m, c: F.when(c == "", m).when(c.rlike("[0-9]"), (m * 10 + c.cast("int")) % 97).otherwise((m * 100 + F.ascii(c) - 55) % 97))
    iban = F.concat(F.substring(known, 1, 2), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), account)
    kept = F.when(known.startswith("+"), F.length(F.regexp_extract(known, COUNTRY, 0))).when(known.startswith("0"), 1).otherwise(0)
    cyrillic, male = known.rlike(r"\p{IsCyrillic}"), F.when(gender.isNotNull(), gender == "m").otherwise(_number(digest, 60, 2) == 0)

    def word(script: str, ends: dict, n_syllables: int) -> Column:
        stem = syllables(script, n_syllables + more, 8)
        if ("m", script) not in ends:
            return stem
        return F.concat(stem, _pick(ONSET[script], digest, 55), F.when(male, _pick(ends["m", script], digest, 3)).otherwise(_pick(ends["f", script], digest, 3)))

    return (
        F.when(kind_ == "email", email)
        .when(kind_ == "ip", ip)
        .when(kind_ == "given", F.when(cyrillic, word("cyrillic", GIVEN_END, 1)).otherwise(word("latin", GIVEN_END, 1)))
        .when(kind_ == "family", F.when(cyrillic, word("cyrillic", FAMILY_END, 2)).otherwise(word("latin", FAMILY_END, 3)))
        .when(kind_ == "access_key", scrambled(4))
        .when(kind_ == "token", scrambled(4))
        .when(kind_ == "card", card)
        .when(kind_ == "iban", iban)
        .when(kind_ == "phone", scrambled(kept))
        .otherwise(scrambled())
    )


def formatted(kind_: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one spelling."""
    said = F.when(kind_ == "phone", F.regexp_replace(surrogate, r"^\+", "")).otherwise(surrogate)
    counts = F.when(kind_ == "iban", F.lit("[0-9A-Z]")).otherwise(F.lit("[0-9]"))
    before = lambda i: F.regexp_count(value.substr(F.lit(1), i), counts)
    spelled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(F.regexp_like(value.substr(i, F.lit(1)), counts), said.substr(before(i), F.lit(1))).otherwise(value.substr(i, F.lit(1)))), "")
    beyond = said.substr(before(F.length(value)) + 1, F.length(said))
    upper = value == F.upper(value)
    return (
        F.when(kind_.isin(*DIGITS, "iban"), F.concat(spelled, beyond))
        .when(kind_.isin("family", "given"), F.when(upper & (F.length(value) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate)))
        .when(kind_.isin("email", "hex", "ipv6") & upper & value.rlike("[A-Z]"), F.upper(surrogate))
        .otherwise(surrogate)
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """For distinct entities (kind, known, gender): their surrogate, different ones for different entities of a kind."""
    entities = checkpoint(entities)
    open_, given = entities, None
    for attempt in count():
        digest = hmac(key, F.concat_ws("\x01", "kind", "known", F.lit(str(attempt))))
        # a column of its own, as it is read many times
        drawn = open_.withColumn("digest", digest).repartition("kind", "known").withColumn("surrogate", candidate(F.col("kind"), F.col("known"), F.col("gender"), F.col("digest"), attempt))
        # of the entities with one candidate the smallest keeps it, unless it is taken or an entity itself
        first = drawn.groupBy("kind", "surrogate").agg(F.min("known").alias("known"))
        kept = first.join(entities.select("kind", F.col("known").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if given is not None:
            kept = kept.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        kept = checkpoint(kept.select("kind", "known", "surrogate"))
        given = kept if given is None else given.unionByName(kept)
        open_ = checkpoint(open_.join(kept.select("kind", "known"), ["kind", "known"], "left_anti"))
        if open_.isEmpty():
            return given


def _gender(value: Column) -> Column:
    titles = lambda p: value.rlike(rf"^(?:(?:{NEUTRAL}) )*(?:{p}) ")
    return F.when(titles(MALE), "m").when(titles(FEMALE), "f")


def _words(value: Column) -> Column:
    """The name in a mention: its words, without forms of address and initials."""
    return F.split(F.regexp_replace(value, rf"^{TITLES}", ""), "[ -]")


def _mentions(found: Column, families: Column) -> Column:
    """Each span with its kind and its parts: the entities that it mentions, as they are written.

    The last word of a titled name is a family name, and so is one that is the last word elsewhere in the text.
    """

    def parts(value: Column, kind_: Column) -> Column:
        words = _words(value)
        role = lambda w: F.when(F.array_contains(families, F.lower(w)), F.lit("family")).otherwise(F.lit("given"))
        one = lambda k, shown, g: F.struct(k.alias("kind"), canonical(k, shown).alias("known"), shown.alias("shown"), g.alias("gender"))
        return F.when(kind_ == "name", F.transform(words, lambda w: one(role(w), w, _gender(value)))).otherwise(F.array(one(kind_, value, F.lit(None).cast("string"))))

    kinds = F.transform(found, lambda v: F.struct(v.alias("value"), kind(v).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind"), parts(x["value"], x["kind"]).alias("parts")))


def spans(rows: DataFrame) -> DataFrame:
    """Of texts with entities (uid, text, found): what is between the spans (pieces), and the spans (mentions)."""
    titled = F.filter("found", lambda v: v.rlike(rf"^(?:{TITLES})(?:{NAME_WORD})"))
    rows = rows.withColumn("names", F.array_distinct(F.flatten(F.transform(titled, _words))))
    rows = rows.withColumn("families", F.array_distinct(F.transform(titled, lambda v: F.lower(F.element_at(_words(v), -1)))))
    # in a text with names, their words are spans without a form of address as well, the longest first
    longest = F.array_sort("names", lambda a, b: F.length(b) - F.length(a))
    either = F.concat(F.lit("(?:"), F.array_join(longest, "|"), F.lit(")"))
    bare = F.concat(F.lit(rf"(?:{ANY})|(?<![\p{{L}}\d])"), either, F.lit("(?:[ -]"), either, F.lit(r")*(?![\p{L}\d])"))
    pattern = F.when(F.size("names") > 0, bare).otherwise(F.lit(ANY))
    rows = rows.withColumn("pattern", pattern)
    rows = rows.withColumn("found", F.when(F.size("names") > 0, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
    return rows.select("uid", F.split("text", F.col("pattern"), -1).alias("pieces"), _mentions(F.col("found"), F.col("families")).alias("mentions"))


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities."""
    text = F.col("text").cast("string")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), F.lit(0))
    # written once, so that the pattern runs once; only documents with entities are dealt, the others pass by
    rows = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), found.alias("found"), F.monotonically_increasing_id().alias("uid")))
    clean = rows.filter(F.size("found") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    hit = rows.filter(F.size("found") > 0)
    spanned = checkpoint(spans(hit.select("uid", "text", "found")))
    each = spanned.select("uid", F.explode(F.flatten("mentions.parts")).alias("p")).select("uid", "p.kind", "p.known", "p.gender")
    # a name with forms of address of both genders has none
    entities = each.groupBy("kind", "known").agg(F.when(F.min("gender") == F.max("gender"), F.min("gender")).alias("gender"))
    told = surrogates(entities, key)
    mapped = each.select("uid", "kind", "known").distinct().join(told, ["kind", "known"]).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", "kind", "known"), "surrogate"))).alias("told"))

    def said(mention: Column) -> Column:
        part = lambda p: formatted(p["kind"], p["shown"], F.element_at(F.col("told"), F.concat_ws("\x01", p["kind"], p["known"])))
        words = F.transform(mention["parts"], part)
        before = F.regexp_extract(mention["value"], rf"^{TITLES}", 0)
        gaps = F.filter(F.split(F.substring(mention["value"], F.length(before) + 1, 100_000), r"[^ -]+"), lambda x: x != "")
        joined = F.array_join(F.transform(words, lambda w, i: F.concat(w, F.coalesce(F.get(gaps, i), F.lit("")))), "")
        return F.when(mention["kind"] == "name", F.concat(before, joined)).otherwise(F.element_at(words, 1))

    rebuilt = F.array_join(F.zip_with("pieces", F.transform("mentions", said), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = spanned.join(mapped, "uid").select("uid", rebuilt.alias("text"), F.size("mentions").cast("long").alias("n_entities"))
    return clean.unionByName(hit.select("uid", "doc_id").join(done, "uid").select("doc_id", "text", "n_entities"))

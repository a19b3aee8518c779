"""PII: detected entities get keyed surrogates of the same type, format, script and gender.

Detection is one ordered alternation of bounded or possessive patterns (no pattern can run over a long text twice): e-mail
addresses, hex secrets and access keys, card and account numbers, phone numbers, IPv4 and IPv6 addresses, social security numbers,
IBANs. 13 to 19 digits, in any grouping, are a card number if they satisfy the Luhn sum and nothing otherwise.

Names and passwords are known by what precedes them: a title (Mr, Frau, Señora, ...), an introduction (my name is, ich heiße,
contact ...: with two words), or `password=`. Up to four words are names then, each an entity, particles aside. Wherever a word
or password found so stands in the same text, with or without a title, it is that entity: what was detected once can't stay
readable elsewhere. Names that no text introduces aren't found.

An entity is known by its canonical form (digits alone, or lower case), so spellings of one entity corefer: they get the
same surrogate, each in its own format.

A surrogate is a keyed Feistel permutation of the canonical form's characters, each within its own class (digits, vowels,
consonants, hex digits, octets; Latin, Greek and Cyrillic letters), so entities of one format never meet and length,
separators, case and script stay. Country codes, top-level domains and the letter that ends a name (which carries gender, with the
title before it) stay too. Card numbers still satisfy the Luhn sum, and IBANs that satisfy theirs (mod 97) still do.
The key is required; whoever has it can invert the permutation.

Collision check, over the table of distinct entities: a surrogate that is itself an entity of the table, or that another entity
already has, is drawn again with the next tweak until none is left. Only those exceptions are joined back to the texts;
all other surrogates are computed in place. If a format has so few members that `max_tweaks` draws don't free an entity, all
entities of the format get one common tweak, so they stay distinct: names of such a format become two letters longer if that
frees them; of what is left, the tweak that reuses fewest real entities is taken, and n_reused counts, for each text, its
entities whose surrogate is a real entity of the table all the same.

All in Spark's own expressions; texts are not shuffled unless there are more exceptions than Spark broadcasts.

A null text stays null, with no entities. Texts are whole. Repeated rows and null ids keep their rows. Columns other than the
two named are ignored (with `columns`, handed through). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, drop_now, let, materialize, spread

ROUNDS, MAX_TWEAKS = 4, 24
COMMON_TWEAKS = 32  # that a format without free members chooses from
LONGER = 1 << 20  # tweaks from here on make names longer

#: Titles and introductions before names, particles within them, what precedes passwords. Fixed values.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Herrn", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame", "Mme", "Mlle", "Господин", "Госпожа")
INTRODUCTIONS = ("My name is", "my name is", "Mein Name ist", "mein Name ist", "Ich heiße", "ich heiße", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "Mi nombre es", "mi nombre es", "Меня зовут", "меня зовут", "Signed by", "signed by", "Contact person", "Ansprechpartner")
CONTACTS = ("Contact", "Kontakt", "Contacto", "Contactez")  # these need two words after them
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "el", "al", "bin", "zu")
PASSWORDS = ("password", "passwd", "pwd", "passwort", "api_key", "apikey", "api-key", "secret", "token")
WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++"
_TITLE = rf"(?:{'|'.join(TITLES)})\.? "
NAMED = rf"(?<!\p{{L}})(?:(?:{_TITLE})++|(?:{'|'.join(INTRODUCTIONS)}):? (?:{_TITLE})*+|(?:{'|'.join(CONTACTS)}):? (?={WORD} {WORD}))({WORD}(?:(?:-| (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}){WORD}){{0,3}})"
KEYED = rf"(?i)(?<![a-z0-9])(?:{'|'.join(PASSWORDS)})['\"]? ?[=:] ?['\"]?((?=[^\s'\"]{{0,200}}[0-9])[^\s'\"<>\\,;]{{6,}}+)"
#: (type, pattern), in order of priority. Every repetition is bounded or possessive.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![A-Za-z0-9.])(?:[0-9]{13,19}+|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{3})?|[0-9]{4}(?:-[0-9]{4}){3}(?:-[0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])"),
    ("ssn", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"),
    ("phone", r"(?<![A-Za-z0-9.+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9.+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![A-Za-z0-9])|(?<![A-Za-z0-9./+-])0[0-9]{2,4}/[0-9]{5,8}(?![A-Za-z0-9./-])|(?<![A-Za-z0-9.+-])0[1-9](?:[ .][0-9]{2}){4}(?![A-Za-z0-9]|[ .-]?[0-9])"),
    ("ip", r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![A-Za-z0-9]|\.[0-9])"),
    ("ipv6", r"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![A-Za-z0-9:])"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: 13 to 19 digits in any grouping, looked for between the entities of the other patterns; the Luhn sum alone decides.
GROUPED = r"(?<![A-Za-z0-9.])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
#: Classes of characters that replace one another, fixed values.
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "âêîôû", "äöü", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ")
HEX = "0123456789abcdef"
NONE = "none"
ENTITY = "struct<kind:string,entity:string,canon:string>"


def _integers(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def kind_of(entity: Column) -> Column:
    """The type of an entity that ANY detected: the first whose pattern it is. 13 to 19 digits without the Luhn sum are of type none."""
    out = F.lit(PATTERNS[-1][0])
    for name, pattern in reversed(PATTERNS[:-1]):
        out = F.when(F.regexp_like(entity, F.lit(f"^(?:{pattern})$")), F.lit(name)).otherwise(out)
    return let(out, lambda k: F.when((k == "card") & (_luhn(_integers(F.regexp_replace(entity, "[^0-9]", ""))) != 0), F.lit(NONE)).otherwise(k))


def canonical(kind: Column, entity: Column) -> Column:
    return F.when(kind.isin("card", "ssn"), F.regexp_replace(entity, "[^0-9]", "")).when(kind == "phone", F.regexp_replace(entity, "[^0-9+]", "")).when(kind == "iban", F.lower(F.replace(entity, F.lit(" "), F.lit("")))).when(kind == "ip", entity).otherwise(F.lower(entity))


def _feistel(values: Column, sizes: Column, secret: Column) -> Column:
    """Values below their sizes to values below their sizes: a permutation for each secret and list of sizes."""

    def turn(v: Column, z: Column, r: int) -> Column:
        others = F.array_join(F.filter(v, lambda x, i: i % 2 != r % 2), ",")
        digest = F.sha2(F.concat_ws("|", secret, F.lit(str(r)), others), 256)
        return let(digest, lambda h: F.transform(v, lambda x, i: F.when(i % 2 == r % 2, (x + F.conv(F.substring(h, (i * 3) % 60 + 1, F.lit(4)), 16, 10).cast("int")) % F.get(z, i)).otherwise(x)))

    def run(z: Column) -> Column:
        out = lambda v, r: v if r == ROUNDS else let(turn(v, z, r), lambda x: out(x, r + 1))
        return out(values, 0)

    return let(sizes, run)


def _class_of(kind: Column, c: Column) -> Column:
    out = F.lit("")
    for alphabet in reversed(CLASSES):
        out = F.when(F.contains(F.lit(alphabet), c), F.lit(alphabet)).otherwise(out)
    return F.when(kind.isin("secret", "ipv6") & F.contains(F.lit(HEX), c), F.lit(HEX)).otherwise(out)


def _fixed(kind: Column, canon: Column, i: Column) -> Column:
    """Whether the character at i of the canonical form stays."""
    last = F.length(canon) - 1
    return (
        ((kind == "email") & (i >= F.length(canon) - F.length(F.substring_index(canon, ".", -1))))
        | ((kind == "name") & (i == last))
        | ((kind == "card") & (i == last))
        | ((kind == "iban") & (i < 4))
        | ((kind == "phone") & F.startswith(canon, F.lit("+")) & (i <= 1))
    )


def _luhn(digits: Column) -> Column:
    """The Luhn sum of an array of digits modulo 10."""
    n = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda a, x: a + x) % 10


def _mod97(chars: Column) -> Column:
    """The number that an array of digits and letters (a: 10, ..., z: 35) spells, modulo 97."""
    return F.aggregate(chars, F.lit(0), lambda a, c: let(F.when(c.rlike("[a-z]"), F.ascii(c) - 87).otherwise(c.cast("int")), lambda v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97))


def _iban_check(chars: Column) -> Column:
    """The check digits that an IBAN (an array of characters) needs, 2 to 98."""
    country, account = F.slice(chars, 1, 2), F.slice(chars, F.lit(5), F.greatest(F.lit(0), F.size(chars) - 4))
    return 98 - _mod97(F.concat(account, country, F.array(F.lit("0"), F.lit("0"))))


def permuted(kind: Column, canon: Column, tweak: Column, key: str) -> Column:
    """The surrogate's canonical form."""
    secret = F.concat_ws("|", F.lit(key), kind, tweak.cast("string"))

    def letters(chars: Column) -> Column:
        def coded(alphabets: Column) -> Column:
            values = F.zip_with(chars, alphabets, lambda c, a: F.greatest(F.lit(0), F.instr(a, c) - 1))
            sizes = F.transform(alphabets, lambda a: F.greatest(F.lit(1), F.length(a)))
            return let(_feistel(values, sizes, secret), lambda v: F.zip_with(F.zip_with(v, alphabets, lambda x, a: F.struct(x.alias("x"), a.alias("a"))), chars, lambda p, c: F.when(p["a"] == "", c).otherwise(F.substring(p["a"], p["x"] + 1, F.lit(1)))))

        own = F.transform(chars, lambda c, i: F.when(_fixed(kind, canon, i), F.lit("")).otherwise(_class_of(kind, c)))
        return let(own, coded)

    def checked(chars: Column, new: Column) -> Column:
        """Cards: the last digit keeps the Luhn sum. IBANs: the check digits stay as far from the right ones as they were."""
        digits = lambda a: F.transform(a, lambda c: c.cast("int"))
        body = F.slice(new, F.lit(1), F.size(new) - 1)
        last = F.pmod(_luhn(digits(chars)) - _luhn(digits(F.concat(body, F.array(F.lit("0"))))), F.lit(10))
        off = F.array_join(F.slice(chars, 3, 2), "").cast("int") - _iban_check(chars)
        check = F.split(F.lpad(F.pmod(_iban_check(new) + off, F.lit(100)).cast("string"), 2, "0"), "")
        iban = F.concat(F.slice(new, 1, 2), check, F.slice(new, F.lit(5), F.greatest(F.lit(0), F.size(new) - 4)))
        return F.when(kind == "card", F.concat(body, F.array(last.cast("string")))).when(kind == "iban", iban).otherwise(new)

    text = let(F.split(canon, ""), lambda chars: let(letters(chars), lambda new: F.array_join(checked(chars, new), "")))
    octets = F.transform(F.split(canon, r"\."), lambda x: x.cast("int"))
    address = F.array_join(let(octets, lambda o: _feistel(o, F.transform(o, lambda x: F.lit(256)), secret)), ".")
    longer = lambda t: F.when(tweak >= LONGER, F.concat(F.substring(t, 1, 2), t)).otherwise(t)
    return F.when(kind == "ip", address).otherwise(let(text, longer))


def restored(kind: Column, entity: Column, canon: Column) -> Column:
    """A canonical form in the format of an entity: its separators and case (secrets without lower-case letters have none)."""
    canon = F.when((kind == "secret") & (entity == F.upper(entity)), F.upper(canon)).otherwise(canon)
    skips = F.when(kind.isin("card", "ssn"), F.lit("[^0-9]")).when(kind == "phone", F.lit("[^0-9+]")).when(kind == "iban", F.lit(" ")).otherwise(F.lit("$^"))
    walk = F.aggregate(
        F.split(entity, ""),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda a, c: F.when(F.regexp_like(c, skips), F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out"))).otherwise(
            F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], let(F.substring(canon, a["at"], F.lit(1)), lambda x: F.when(c != F.lower(c), F.upper(x)).otherwise(x))).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(canon, a["at"], F.length(canon))),  # of a longer name, its end
    )
    return F.when(kind == "ip", canon).otherwise(walk)


def _known(kind: Column, entity: Column) -> Column:
    return F.struct(kind.alias("kind"), entity.alias("entity"), canonical(kind, entity).alias("canon"))


def _detected(text: Column) -> Column:
    """Entities of ANY in a text, in order; empty if there is none."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    known = F.transform(found, lambda e: let(kind_of(e), lambda k: _known(k, e)))
    likely = F.regexp_like(text, F.lit("[0-9@]")) | F.regexp_like(text, F.lit("(?<![A-Za-z0-9])[A-Za-z0-9]{20}"))  # each entity holds one
    return F.coalesce(F.when(likely, known), F.array().cast(f"array<{ENTITY}>"))


def _literals(text: Column) -> Column:
    """(names, passwords): the words of a text that stand for entities wherever they are in it."""
    none = F.array().cast("array<string>")
    starts = "".join(sorted({x[0] for x in (*TITLES, *INTRODUCTIONS, *CONTACTS)}))
    likely = F.regexp_like(text, F.lit(rf"(?=[{starts}])(?:{'|'.join((*TITLES, *INTRODUCTIONS, *CONTACTS))})[.:]? \p{{Lu}}"))
    names = F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(NAMED), F.lit(1)), lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))), lambda w: ~w.isin(*TITLES))
    passwords = F.when(F.regexp_like(text, F.lit("[=:] ?['\"]?[^ ]{6}")), F.regexp_extract_all(text, F.lit(KEYED), F.lit(1)))
    return F.struct(F.coalesce(F.when(likely, F.array_distinct(names)), none).alias("names"), F.coalesce(F.array_distinct(passwords), none).alias("passwords"))


def _between(literals: Column) -> Column:
    """The pattern of what is looked for between the entities of ANY: digits in any grouping, and the text's own literals."""
    name = F.concat(F.lit(r"(?<![\p{L}])(?:"), F.array_join(literals["names"], "|"), F.lit(r")(?!\p{L})"))
    quoted = F.transform(literals["passwords"], lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    password = F.concat(F.lit("(?<![A-Za-z0-9])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9])"))
    return F.concat_ws("|", F.when(F.size(literals["passwords"]) > 0, password), F.lit(GROUPED), F.when(F.size(literals["names"]) > 0, name))


def format_of(kind: Column, canon: Column) -> Column:
    """What a surrogate keeps: the classes of the characters that change, and the others. Each tweak permutes a format's members."""

    def part(c: Column, i: Column) -> Column:
        stays = _fixed(kind, canon, i) & (kind != "card")  # a card's last digit follows the others
        return let(_class_of(kind, c), lambda a: F.when(stays | (a == ""), F.concat(F.lit("="), c)).otherwise(F.substring(a, 1, 2)))

    return F.when(kind == "ip", F.lit("ip")).otherwise(F.concat(kind, F.lit("|"), F.array_join(F.transform(F.split(canon, ""), part), "")))


def _common(now: DataFrame, bad: DataFrame, draw, first: int) -> DataFrame:
    """(kind, canon, tweak, reused) of all entities, with one tweak for all of each format that has a bad one.

    A tweak that makes names longer is open to a format if no surrogate is one that another entity has or may get.
    """
    shaped = now.withColumn("format", format_of(F.col("kind"), F.col("canon")))
    full = materialize(shaped.join(bad, ["kind", "canon"], "left_semi").select("format").distinct(), "full-formats")
    members = materialize(shaped.join(full, "format", "left_semi").select("format", "kind", "canon"), "full-members")
    rest = now.join(members, ["kind", "canon"], "left_anti")
    choices = F.sequence(F.lit(first), F.lit(first + COMMON_TWEAKS - 1))
    longer = F.when(F.col("kind") == "name", F.transform(choices, lambda t: t + LONGER)).otherwise(F.array().cast("array<int>"))
    tries = materialize(draw(members.withColumn("tweak", F.explode(F.concat(choices, longer)))), "full-tries")
    real = now.select("kind", F.col("canon").alias("surrogate"), F.lit(1).alias("real"))
    taken = rest.select("kind", "surrogate").distinct().withColumn("taken", F.lit(1))
    into = full.select(F.col("format").alias("into"), F.lit(1).alias("open"))
    met = tries.join(real, ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left")
    met = met.withColumn("into", F.when(F.col("tweak") >= LONGER, format_of(F.col("kind"), F.col("surrogate")))).join(into, "into", "left")
    one = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    scores = met.groupBy("format", "tweak").agg(F.greatest(F.max("taken"), F.max("open")).alias("clash"), one("real").alias("reused")).where("clash IS NULL")
    best = scores.groupBy("format").agg(F.min(F.struct("reused", "tweak")).alias("best")).select("format", F.col("best.tweak").alias("tweak"))
    again = met.join(best, ["format", "tweak"], "left_semi").select("kind", "canon", "tweak", F.col("real").isNotNull().alias("reused"))
    return rest.select("kind", "canon", "tweak", F.lit(False).alias("reused")).unionByName(again)


def exceptions(entities: DataFrame, key: str, max_tweaks: int = MAX_TWEAKS) -> DataFrame:
    """entities: distinct (kind, canon). Returns (kind, canon, tweak, reused) for those whose first surrogate collides."""
    draw = lambda d: d.withColumn("surrogate", permuted(F.col("kind"), F.col("canon"), F.col("tweak"), key))
    now = materialize(draw(entities.select("kind", "canon", F.lit(0).alias("tweak"))), "surrogates")
    real = now.select("kind", F.col("canon").alias("surrogate"))
    tried = 0
    while True:
        met = now.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon")
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("tweak", "canon")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = now.join(first, ["kind", "surrogate"]).where("canon <> first.canon").select("kind", "canon")
        bad = materialize(met.unionByName(twice).distinct(), "collisions")
        if bad.isEmpty():
            drop_now(bad)
            return now.where("tweak > 0").select("kind", "canon", "tweak", F.lit(False).alias("reused"))
        if tried == max_tweaks:
            return _common(now, bad, draw, max_tweaks + 1).where("tweak > 0")
        tried += 1
        again = draw(now.join(bad, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("tweak") + 1).alias("tweak")))
        now = materialize(now.join(bad, ["kind", "canon"], "left_anti").unionByName(again.select(now.columns)), "surrogates")


def scanned(text: Column) -> Column:
    """A struct: found (the entities of ANY), pattern (of what else to look for), and rest: for each gap, what that finds.

    rest is null for a text without literals and groups of digits.
    """

    def with_literals(literals: Column) -> Column:
        def other(e: Column) -> Column:
            digits = F.regexp_replace(e, "[^0-9]", "")
            card = F.struct(F.when(_luhn(_integers(digits)) == 0, F.lit("card")).otherwise(F.lit(NONE)).alias("kind"), e.alias("entity"), digits.alias("canon"))
            named = F.when(F.array_contains(literals["passwords"], e), _known(F.lit("password"), e)).when(F.regexp_like(e, F.lit("^[0-9]")), card)
            return named.otherwise(_known(F.lit("name"), e))

        def rest(pattern: Column) -> Column:
            return F.transform(F.split(text, ANY, -1), lambda g: F.transform(F.regexp_extract_all(g, pattern, F.lit(0)), other))

        some = (F.size(literals["names"]) > 0) | (F.size(literals["passwords"]) > 0) | F.regexp_like(text, F.lit(GROUPED))
        return let(_between(literals), lambda p: F.struct(_detected(text).alias("found"), p.alias("pattern"), F.when(some, rest(p)).alias("rest")))

    return let(_literals(text), with_literals)


def entities_of(scan: Column) -> Column:
    """All entities of scanned()."""
    every = F.when(scan["rest"].isNull(), scan["found"]).otherwise(F.concat(scan["found"], F.flatten(scan["rest"])))
    return F.filter(every, lambda e: e["kind"] != NONE)


def surrogates(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text", columns: bool = False, max_tweaks: int = MAX_TWEAKS) -> DataFrame:
    """doc_id, n_entities, kinds (distinct, sorted, comma-joined), text, n_reused; with columns, the input's with text replaced."""
    rows, (doc_id, text), back = boxed(docs if columns else docs.select(*dict.fromkeys([id_col, text_col])), id_col, text_col)
    rows = spread(rows)
    every = rows.select("_rid", F.explode(let(scanned(text), entities_of)).alias("e")).select("_rid", "e.kind", "e.canon")
    seen = materialize(every.distinct(), "entities")
    odd = materialize(exceptions(seen.select("kind", "canon").distinct(), key, max_tweaks), "exceptions")
    name = lambda k, c: F.concat(k, F.lit("|"), c)
    if odd.isEmpty():
        joined = rows.withColumn("_odd", F.lit(None).cast("map<string,struct<tweak:int,reused:boolean>>"))
    else:
        of = F.struct(name(F.col("kind"), F.col("canon")), F.struct("tweak", "reused"))
        tweaks = seen.join(odd, ["kind", "canon"]).groupBy("_rid").agg(F.map_from_entries(F.collect_list(of)).alias("_odd"))
        joined = rows.join(tweaks, "_rid", "left")
    said = lambda e: F.try_element_at(F.col("_odd"), name(e["kind"], e["canon"]))

    def swapped(e: Column) -> Column:
        tweak = F.coalesce(said(e)["tweak"], F.lit(0))
        return F.when(e["kind"] == NONE, e["entity"]).otherwise(restored(e["kind"], e["entity"], permuted(e["kind"], e["canon"], tweak, key)))

    def woven(gaps: Column, found: Column) -> Column:
        """Gaps, and between them the surrogates of what stood there."""
        return F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.transform(found, swapped), F.array(F.lit(""))), lambda g, s: F.array(g, s))), "")

    def replaced(scan: Column) -> Column:
        gaps = F.split(text, ANY, -1)
        gaps = F.when(scan["rest"].isNull(), gaps).otherwise(F.zip_with(gaps, scan["rest"], lambda g, found: woven(F.split(g, scan["pattern"], F.lit(-1)), found)))
        new = F.when((F.size(scan["found"]) == 0) & scan["rest"].isNull(), text).otherwise(woven(gaps, scan["found"]))

        def struct(real: Column) -> Column:
            kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(real, lambda e: e["kind"]))), ",")
            reused = F.size(F.filter(real, lambda e: F.coalesce(said(e)["reused"], F.lit(False))))
            return F.struct(F.size(real).cast("long").alias("n"), kinds.alias("kinds"), new.alias("text"), reused.cast("long").alias("reused"))

        return let(entities_of(scan), struct)

    done = joined.withColumn("_new", let(scanned(text), replaced))
    if columns:
        return done.select(*[F.col("_new.text").alias(c) if c == text_col else b for c, b in zip(docs.columns, back, strict=True)])
    return done.select(doc_id.alias("doc_id"), F.col("_new.n").alias("n_entities"), F.col("_new.kinds").alias("kinds"), F.col("_new.text").alias("text"), F.col("_new.reused").alias("n_reused"))

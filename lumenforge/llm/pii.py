"""PII surrogates: keyed, type-consistent replacements that keep distinct entities apart and equal ones equal.

Everything is built from DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions.text import STOPWORDS
from lumenforge.plans.lineage import discard, materialize
from lumenforge.plans.skew import join_groups

#: Given names by gender, for surrogates and for detection behind nothing but themselves plus a family name. Fixed values.
MALE = ("Adam", "Albert", "Andreas", "Antoine", "Carlos", "Daniel", "David", "Diego", "Felix", "Fernando", "Frank", "George", "Hans", "Henri", "Hugo", "Jack", "James", "Javier", "Jean", "John", "Juan", "Karl", "Klaus", "Louis", "Lukas", "Luis", "Manuel", "Mark", "Martin", "Michael", "Miguel", "Otto", "Pablo", "Paul", "Peter", "Pierre", "Robert", "Stefan", "Thomas", "William")
FEMALE = ("Alice", "Amélie", "Ana", "Anna", "Barbara", "Carmen", "Chloé", "Claire", "Clara", "Elena", "Elizabeth", "Emma", "Eva", "Greta", "Hanna", "Heidi", "Ingrid", "Isabel", "Jane", "Jennifer", "Julia", "Karin", "Laura", "Linda", "Lucía", "Maria", "Marie", "Marta", "Mary", "Monika", "Olivia", "Patricia", "Petra", "Rosa", "Sabine", "Sarah", "Sofía", "Sophie", "Susan", "Ursula")
#: Family names for surrogates. Fixed values.
FAMILY = ("Albrecht", "Baker", "Bauer", "Becker", "Bernard", "Brown", "Castillo", "Clark", "Cooper", "Dubois", "Durand", "Evans", "Fischer", "Fontaine", "García", "Hartmann", "Herrera", "Hoffmann", "Hughes", "Jackson", "Keller", "Lambert", "Laurent", "Lopez", "Martin", "Mercier", "Meyer", "Morales", "Moreno", "Navarro", "Parker", "Richter", "Romero", "Rousseau", "Schmidt", "Taylor", "Turner", "Vogel", "Walker", "Weber")
#: Given names by gender and family names that don't tell one, for names in other scripts. Fixed values.
SCRIPTS = {
    "Cyrillic": {
        "m": ("Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Михаил", "Николай", "Павел", "Пётр", "Сергей"),
        "f": ("Анна", "Вера", "Галина", "Елена", "Ирина", "Людмила", "Мария", "Наталья", "Ольга", "Светлана", "Софья", "Татьяна"),
        "family": ("Бондаренко", "Гончаренко", "Коваль", "Кравчук", "Левченко", "Марченко", "Мельник", "Петренко", "Романюк", "Савчук", "Ткачук", "Шевченко"),
    },
    "Greek": {
        "m": ("Αλέξανδρος", "Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Μιχάλης", "Νίκος", "Παύλος", "Πέτρος", "Σπύρος", "Στέλιος", "Χρήστος"),
        "f": ("Αγγελική", "Αικατερίνη", "Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ειρήνη", "Ελένη", "Μαρία", "Σοφία", "Φωτεινή", "Χριστίνα"),
        "family": ("Αθανασίου", "Αντωνίου", "Βασιλείου", "Γεωργίου", "Δημητρίου", "Θεοδώρου", "Ιωάννου", "Κωνσταντίνου", "Νικολάου", "Οικονόμου", "Παπαγεωργίου", "Χρήστου"),
    },
}
GIVEN = {g: latin + tuple(n for s in SCRIPTS.values() for n in s[g]) for g, latin in (("m", MALE), ("f", FEMALE))}
#: Titles that tell a gender, and titles that don't. Fixed values.
TITLES = {"m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "Господин", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña", "Госпожа", "Κυρία"), "n": ("Dr", "Prof")}
#: Words before an assigned secret. Fixed values.
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key")

#: Words between the parts of a name. Fixed values.
PARTICLES = ("de", "del", "della", "di", "da", "dos", "la", "las", "los", "le", "du", "van", "von", "der", "den", "ter", "zu", "bin", "al", "y")
#: Words before a name whose parts need not be on a list. Fixed values.
CUES = ("my name is", "My name is", "Name:", "name:", "Dear", "signed,", "Regards,", "Contact:", "contact:")

_CAP = r"\p{Lu}[\p{L}'’-]+"
_GAP = "[ \u00A0]"
_ANY_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
# names of the lists, as they are and in capitals; a hyphen may join them to others
_GIVEN = "(?:" + "|".join(n for g in GIVEN.values() for n in g) + "|" + "|".join(n.upper() for g in GIVEN.values() for n in g) + r")(?:-\p{Lu}\p{L}+)*"
_PARTICLE = f"(?:(?:{'|'.join(PARTICLES)}){_GAP}){{0,3}}+"
_MIDDLE = rf"(?:{_GAP}{_PARTICLE}(?:{_GIVEN}|\p{{Lu}}\.)(?={_GAP})){{0,4}}"
#: Types in order of precedence; each pattern is one alternative and has no capturing group.
PATTERNS = (
    ("email", r"(?<![\w.+%-])[\w.+%-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w@-])"),
    ("secret", rf"(?<=[:=\"' \t])(?i:(?<=\b(?:{'|'.join(SECRET_WORDS)})[ \t]{{0,2}}[:=][ \t]{{0,2}}[\"']?))[A-Za-z0-9_+/=.-]{{8,}}+|\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b|\b(?:ghp|gho|ghs|sk|xox[abp])[_-][A-Za-z0-9_-]{{16,}}+|\beyJ[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?=[A-Fa-f:]{0,35}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])"),
    ("phone", r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w])|(?<![\w+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w])|(?<![\w+(.,-])\(?0[1-9][0-9]{1,4}\)?[ /-][0-9]{3,4}[ -]?[0-9]{3,5}(?![\w-]|[.,][0-9])"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("card", r"(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![\w-]|\.[0-9])"),
    ("name", rf"(?=\p{{Lu}})(?<![\p{{L}}])(?:{_ANY_TITLE})\.?{_GAP}{_CAP}{_MIDDLE}(?:{_GAP}{_PARTICLE}{_CAP})?"
             rf"|(?=\p{{Lu}})(?<![\p{{L}}]){_GIVEN}{_MIDDLE}{_GAP}{_PARTICLE}{_CAP}(?![\p{{L}}])"
             rf"|(?<=\b(?:{'|'.join(CUES)}){_GAP}){_CAP}{_GAP}{_CAP}(?![\\p{{L}}])"),
)
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A byte or letter that any entity holds: rows without one are passed through.
SUSPECT = r"[0-9@=:]|\beyJ|\b(?:AKIA|ASIA)|\b(?:ghp|gho|ghs|sk|xox[abp])[_-]|(?=\p{Lu})(?<!\p{L})(?:" + "|".join((*[t for ts in TITLES.values() for t in ts], *GIVEN["m"], *GIVEN["f"], *[n.upper() for g in GIVEN.values() for n in g])) + ")|\\b(?:" + "|".join(CUES) + ")"


#: What the beginning of a key says about its kind. Fixed values.
KEY_KIND = r"^(?:AKIA|ASIA|eyJ|(?:ghp|gho|ghs|sk|xox[abp])[_-](?:(?:live|test|proj)[_-])?)?"
#: The country code of a phone number by its digits alone, or the 0 before an area's.
COUNTRY = r"^(0|\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))?"
#: A name as title, given names with particles between them, gap, family name and a genitive or stray mark at its end.
NAME = rf"^((?:{_ANY_TITLE})\.?{_GAP})?(?:(.+?)({_GAP}))?([^ \u00A0]+?)(['’]s|['’-]+)?$"
#: Where given names part.
JOINT = r"[ \u00A0-]"


#: A whole entity that is a name; two capitalised words with a gap are found by a cue and are nothing else.
WHOLE_NAME = rf"^(?:{dict(PATTERNS)['name']}|{_CAP}{_GAP}{_CAP})$"


def entity_type(entity: Column) -> Column:
    """The type whose pattern fits the whole entity (an assigned secret has lost its word and is what is left)."""
    out = None
    for name, pattern in PATTERNS:
        if name == "secret":
            continue
        fits = entity.rlike(WHOLE_NAME if name == "name" else rf"^(?:{pattern})$")
        out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
    return out.otherwise(F.lit("secret"))


def canonical(kind: Column, entity: Column) -> Column:
    """What makes two mentions the same entity: mail addresses and parts of names regardless of case, numbers by their digits and plus."""
    return F.when(kind == "phone", F.regexp_replace(entity, "[^0-9+]", "")).when(kind.isin("card", "ssn"), F.regexp_replace(entity, "[^0-9]", "")).when(kind.isin("email", "given", "family"), F.lower(entity)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(entity)


def _name_part(entity: Column, n: int) -> Column:
    return F.regexp_extract(entity, NAME, n)


def _given_names(entity: Column) -> Column:
    """The lower-cased given names of a mention in order, without particles and initials."""
    whole = F.filter(F.split(F.lower(_name_part(entity, 2)), JOINT), lambda w: (F.length(w) > 1) & ~w.endswith(".") & ~w.isin(*PARTICLES))
    return F.when(_name_part(entity, 2) != "", whole).otherwise(F.array().cast("array<string>"))


def name_parts(names: DataFrame) -> DataFrame:
    """``kind, entity, part, canon``: the family name of each mention and its given names, each behind the mention's gender.

    The gender is that of the mention's title, else the only one that titles tell for the same first given and
    family name elsewhere, else the first given name's own, else n.
    """
    family, title = F.lower(_name_part(F.col("entity"), 4)), F.regexp_replace(_name_part(F.col("entity"), 1), r"[.\s\u00A0]", "")
    told = F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f")
    rows = names.select("kind", "entity", _given_names(F.col("entity")).alias("names"), family.alias("family"), told.alias("told")).withColumn("given", F.coalesce(F.get("names", F.lit(0)), F.lit("")))
    full = rows.filter("given <> ''").groupBy("given", "family").agg(F.min("told").alias("low"), F.max("told").alias("high"))
    full = full.select("given", "family", F.when(F.col("low") == F.col("high"), F.col("low")).alias("other"))
    own = F.when(F.col("given").isin(*map(str.lower, GIVEN["f"])), "f").when(F.col("given").isin(*map(str.lower, GIVEN["m"])), "m").otherwise("n")
    first = rows.join(full, ["given", "family"]).withColumn("gender", F.coalesce("told", "other", own))
    first = first.select("kind", "entity", "gender", F.explode(F.array_distinct("names")).alias("name")).select("kind", "entity", F.lit("given").alias("part"), F.concat_ws(" ", "gender", "name").alias("canon"))
    return first.unionByName(rows.select("kind", "entity", F.lit("family").alias("part"), F.col("family").alias("canon")))


def _digest(key: str, *parts: Column) -> Column:
    """128 hex digits keyed by ``key``."""
    inner = F.sha2(F.encode(F.concat_ws("\u0001", F.lit(key), *parts), "UTF-8"), 512)
    return F.sha2(F.encode(F.concat(F.lit(f"{key}\u0001"), inner), "UTF-8"), 512)


def _nibble(digest: Column, at: Column) -> Column:
    """A number of 0 to 65535 for each place of a text; the digest is reread shifted after its end."""
    return F.conv(F.substr(F.concat(digest, digest), F.pmod(at * 3, F.lit(128)) + 1, F.lit(4)), 16, 10).cast("int")


def _keep_shape(entity: Column, digest: Column, first: int | Column = 0) -> Column:
    """Every digit, small and capital letter of ``entity`` from place ``first`` on replaced by one of its kind and script."""
    chars = F.split(entity, "")
    greek = lambda c, low, high: (c >= low) & (c <= high)

    def swap(c: Column, i: Column) -> Column:
        n = _nibble(digest, i)
        pick = lambda letters: F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
        new = F.when(greek(c, "0", "9"), pick("0123456789")).when(greek(c, "a", "z"), pick("abcdefghijklmnopqrstuvwxyz")).when(greek(c, "A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        new = new.when(greek(c, "а", "я"), pick("абвгдежзийклмнопрстуфхцчшщъыьэюя")).when(greek(c, "А", "Я"), pick("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")).when(greek(c, "α", "ω"), pick("αβγδεζηθικλμνξοπρστυφχψω")).when(greek(c, "ß", "ÿ"), pick("äöüéèàáíóúñç"))
        return F.when(i < first, c).otherwise(new.otherwise(c))

    return F.array_join(F.transform(chars, swap), "")


def _hex_shape(entity: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), F.pmod(_nibble(digest, i), F.lit(16)) + 1, F.lit(1))).otherwise(c)), "")


def _longer(text: Column, digest: Column, attempt: Column, digits: bool = False) -> Column:
    """``text`` with one more place from the digest for each attempt after the fourth, so that no pool runs out."""
    tail = F.substr(digest, F.lit(33), F.greatest(attempt - 3, F.lit(0)))
    return F.concat(text, F.translate(tail, "abcdef", "012345") if digits else tail)


def _compose(names: tuple[str, ...], digest: Column, attempt: Column) -> Column:
    """One of ``names`` in the first two attempts, then as many as the attempt, joined by hyphens."""
    one = lambda i: F.element_at(F.array(*map(F.lit, names)), F.pmod(F.conv(F.substr(digest, i * 6 + 1, F.lit(6)), 16, 10).cast("int"), F.lit(len(names))) + 1)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.greatest(attempt, F.lit(1)), F.lit(21)) - 1), one), "-")


def surrogate(kind: Column, entity: Column, digest: Column, attempt: Column) -> Column:
    """A replacement of the same type and format.

    Mail keeps the shape of its local part and moves to example.net; phones keep their country code,
    cards their first digit and their spaces; addresses of the net stay inside 10.0.0.0/8 with equal
    widths given up; parts of names keep gender and script (Latin, Cyrillic or Greek). The pool grows with the
    attempt: names are composed, addresses move to 240.0.0.0/4 and then fd00::/8, the rest gets longer.
    """
    local, octet = F.substring_index(entity, "@", 1), lambda at: F.pmod(F.conv(F.substring(digest, at, 6), 16, 10).cast("int"), F.lit(256)).cast("string")
    mail = F.concat(_keep_shape(F.lower(local), digest), F.substr(digest, F.lit(97), F.least(attempt + 6, F.lit(32))), F.lit("@example.net"))
    country = F.regexp_extract(entity, COUNTRY, 1)
    rest = F.substr(entity, F.length(country) + 1)
    phone = _longer(F.concat(country, _keep_shape(rest, digest)), digest, attempt, digits=True)
    word = F.substr(entity, F.lit(3))

    def by_script(text: Column, latin: tuple[str, ...], *lists: str) -> Column:
        cyrillic, greek = (sum((SCRIPTS[x][k] for k in lists), ()) for x in ("Cyrillic", "Greek"))
        return F.when(text.rlike(r"\p{IsCyrillic}"), _compose(cyrillic, digest, attempt)).when(text.rlike(r"\p{IsGreek}"), _compose(greek, digest, attempt)).otherwise(_compose(latin, digest, attempt))

    gender = F.substr(entity, F.lit(1), F.lit(1))
    given = F.when(gender == "f", by_script(word, FEMALE, "f")).when(gender == "m", by_script(word, MALE, "m")).otherwise(by_script(word, MALE + FEMALE, "m", "f"))
    secret = F.when(entity.rlike("^[0-9a-f]+$"), _hex_shape(entity, digest)).otherwise(_keep_shape(entity, digest, F.length(F.regexp_extract(entity, KEY_KIND, 0))))
    # marks without letter or digit have no shape to keep
    secret = _longer(F.when(entity.rlike("[A-Za-z0-9]"), secret).otherwise(F.substring(digest, 1, 16)), digest, attempt)
    reserved = F.concat_ws(".", (F.pmod(F.conv(F.substring(digest, 25, 6), 16, 10).cast("int"), F.lit(15)) + 240).cast("string"), octet(1), octet(9), octet(17))
    ipv6 = F.concat(F.lit("fd"), F.regexp_replace(F.substring(digest, 1, 30), "^(..)|(.{4})(?=.)", "$1$2:"))
    ip = F.when(attempt < 4, F.concat_ws(".", F.lit("10"), octet(1), octet(9), octet(17))).when(attempt < 12, reserved).otherwise(ipv6)
    number = lambda first: _longer(_keep_shape(entity, digest, first), digest, attempt, digits=True)
    return (
        F.when(kind == "email", mail).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "phone", phone)
        .when(kind == "given", given).when(kind == "family", by_script(entity, FAMILY, "family")).when(kind == "card", number(1)).when(kind == "iban", number(2)).when(kind == "ssn", number(0)).otherwise(secret)
    )


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, surrogate, parts`` for distinct mentions ``kind, entity``: a checked one-to-one map of entities; ``parts``
    has of a name the surrogates of its words: ``word, place, new``, the family name at place 0.

    Mentions with one canonical form get one digest; given and family names are drawn by themselves, so that
    a person is the same with and without title or given name. All entities are drawn together; where two of them
    share a surrogate, or one's surrogate is itself some entity of the corpus, all but the one with
    the smallest digest draw again with the next attempt. Pools grow with the attempt; rounds end when none collides.
    """
    table = entities.select("kind", "entity").distinct()
    whole = table.filter("kind <> 'name'").select("kind", "entity", F.col("kind").alias("part"), canonical(F.col("kind"), F.col("entity")).alias("canon"))
    forms = materialize(whole.unionByName(name_parts(table.filter("kind = 'name'"))), "pii-forms")
    taken = forms.select(F.col("part").alias("kind"), "canon").distinct()
    open_ = taken.withColumn("attempt", F.lit(0))
    done = None
    while True:
        digest = _digest(key, F.col("kind"), F.col("canon"), F.col("attempt").cast("string"))
        drawn = open_.withColumn("digest", digest).withColumn("mark", canonical(F.col("kind"), surrogate(F.col("kind"), F.col("canon"), F.col("digest"), F.col("attempt"))))
        drawn = materialize(drawn, "pii-drawn")
        real = taken.select("kind", F.col("canon").alias("mark"))
        # given names may swap among themselves, as no surrogate of a family name is a real one
        clean = drawn.filter((F.col("kind") != "given") | (F.substr("canon", F.lit(3)) != F.col("mark"))).join(real, ["kind", "mark"], "left_anti")
        if done is not None:
            clean = clean.join(done.select("kind", "mark"), ["kind", "mark"], "left_anti")
        first = clean.groupBy("kind", "mark").agg(F.min_by("canon", F.struct("digest", "canon")).alias("canon"))
        won = materialize(clean.join(first, ["kind", "mark", "canon"], "left_semi").select("kind", "canon", "attempt", "digest", "mark"), "pii-won")
        if done is None:
            done = won
        else:
            every = materialize(done.unionByName(won), "pii-done")
            discard(done)
            done = every
        rest = drawn.join(won, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if rest.isEmpty():
            break
        open_ = materialize(rest, "pii-open")
    chosen = forms.join(done.withColumnRenamed("kind", "part"), ["part", "canon"])
    shaped = surrogate(F.col("part"), F.when(F.col("part").isin("email", "given", "family"), F.col("canon")).otherwise(F.col("entity")), F.col("digest"), F.col("attempt"))
    # digits of a number follow its canonical form, laid into the mention's own punctuation
    numeric = _laid(F.col("entity"), F.regexp_replace("mark", "[^0-9A-Z]", ""))
    chosen = chosen.select("kind", "entity", "part", "canon", F.when(F.col("part").isin("phone", "card", "ssn", "iban"), numeric).otherwise(shaped).alias("surrogate"))
    at = lambda n: _name_part(F.col("entity"), n)
    word = F.struct(F.when(F.col("part") == "family", F.col("canon")).otherwise(F.substr("canon", F.lit(3))).alias("word"), (F.col("part") != "family").cast("int").alias("place"), F.col("surrogate").alias("new"))
    names = chosen.filter("kind = 'name'").groupBy("kind", "entity").agg(F.array_sort(F.collect_list(word)).alias("parts"))
    of = lambda w, place: F.get(F.filter("parts", lambda p: (p["word"] == F.lower(w)) & (p["place"] == place)), F.lit(0))["new"]
    given = F.transform(F.split(at(2), JOINT), lambda w: F.coalesce(_cased(of(w, 1), w), w))
    joints = F.regexp_extract_all(at(2), F.lit(JOINT), F.lit(0))
    given = F.array_join(F.flatten(F.zip_with(given, joints, lambda w, j: F.array(w, F.coalesce(j, F.lit(""))))), "")
    names = names.select("kind", "entity", F.concat(at(1), given, at(3), _cased(of(at(4), 0), at(4)), at(5)).alias("surrogate"), "parts")
    rest = chosen.filter("kind <> 'name'").select("kind", "entity", "surrogate", F.lit(None).cast(names.schema["parts"].dataType).alias("parts"))
    return rest.unionByName(names)


def _cased(new: Column, old: Column) -> Column:
    """``new`` in capitals if ``old`` is."""
    return F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(new)).otherwise(new)


def lone_mentions(entities: Column) -> Column:
    """A regex for the names' words among ``entities`` where they stand alone; null without a name."""
    names = F.filter(entities, lambda e: e.rlike(WHOLE_NAME))
    words = F.flatten(F.transform(names, lambda e: F.concat(F.split(_name_part(e, 2), JOINT), F.array(_name_part(e, 4)))))
    words = F.filter(F.array_distinct(words), lambda w: w.rlike(r"^\p{Lu}\p{L}['’\p{L}-]*$") & ~F.lower(w).isin(*STOPWORDS))
    # the longest first, as a name may begin with another
    words = F.array_sort(words, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).otherwise(F.when(x < y, -1).when(x > y, 1).otherwise(0)))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])")))


def _laid(entity: Column, mark: Column) -> Column:
    """``mark`` with the other characters of ``entity`` back in their places, and what ``mark`` has more at the end."""
    step = lambda acc, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(acc["text"], F.substr(mark, acc["n"], F.lit(1))).alias("text"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["text"], c).alias("text"), acc["n"].alias("n")))
    return F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("n")), step, lambda acc: F.concat(acc["text"], F.substr(mark, acc["n"], F.length(mark))))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, text, n_entities, kinds``, the text with every entity replaced.

    Entities are searched once, and in rows with a name its words where they stand alone: those follow the person of that row with this
    word, the family name before given names. Each row is written with its entities and, where it has any, the gaps between them in
    place of its text. Distinct entities get checked surrogates (``replacements``), which meet their rows again through
    the (row, entity) table, entities that stand in many rows by broadcast. Rows without one are not
    shuffled. An entity has the same surrogate in all rows, and different ones differ. Initials and particles of a name stay.

    Null texts stay null with 0 entities; ids may be null or repeat; other columns are ignored; an
    empty table gives no rows.
    """
    none = F.array().cast("array<string>")
    found = F.coalesce(F.when(F.col("text").rlike(SUSPECT), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))), none)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("found", found).withColumn("some", F.size("found") > 0)
    rows = rows.withColumn("lone", F.when(F.col("some"), lone_mentions(F.col("found")))).withColumn("gaps", F.when(F.col("some"), F.split("text", ENTITY, -1)))
    mention = lambda e, lone: F.struct(e.alias("entity"), F.lit(lone).alias("lone"))
    plain = F.transform("found", lambda e: mention(e, False))
    inner = F.transform("gaps", lambda g: F.transform(F.regexp_extract_all(g, F.col("lone"), F.lit(0)), lambda e: mention(e, True)))
    mixed = F.flatten(F.zip_with(inner, plain, lambda i, e: F.when(e.isNull(), i).otherwise(F.concat(i, F.array(e)))))
    gaps = F.when(F.col("lone").isNull(), F.col("gaps")).otherwise(F.flatten(F.transform("gaps", lambda g: F.split(g, F.col("lone"), -1))))
    rows = rows.select("id", F.when(~F.col("some"), F.col("text")).alias("text"), F.when(F.col("lone").isNull(), plain).otherwise(mixed).alias("entities"), gaps.alias("gaps"), "some", F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "pii-rows")
    held = materialize(rows.filter("some").select("_row", F.explode(F.array_distinct(F.transform(F.filter("entities", lambda e: ~e["lone"]), lambda e: e["entity"]))).alias("entity")), "pii-held")
    mentions = materialize(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", entity_type(F.col("entity"))), "pii-mentions")
    table = materialize(replacements(mentions, key).join(mentions, ["kind", "entity"]), "pii-table")
    met = join_groups(held, table, ["entity"], "n", held.count())
    lists = met.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("surrogate", "kind", "parts")))).alias("_map"))
    clean = rows.filter("not some").select("id", "text", F.lit(0).alias("n_entities"), none.alias("kinds"))
    dirty = rows.filter("some").join(lists, "_row").withColumn("_parts", F.array_sort(F.flatten(F.filter(F.transform(F.map_values("_map"), lambda m: m["parts"]), lambda p: p.isNotNull()))))
    alone = lambda e: _cased(F.get(F.filter("_parts", lambda p: p["word"] == F.lower(e)), F.lit(0))["new"], e)
    new = F.transform("entities", lambda e: F.when(e["lone"], alone(e["entity"])).otherwise(F.try_element_at("_map", e["entity"])["surrogate"]))
    text = F.array_join(F.flatten(F.zip_with("gaps", new, lambda g, e: F.array(F.coalesce(g, F.lit("")), F.coalesce(e, F.lit(""))))), "")
    kinds = F.array_sort(F.array_distinct(F.transform(F.map_values("_map"), lambda m: m["kind"])))
    out = clean.unionByName(dirty.select("id", text.alias("text"), F.size("entities").alias("n_entities"), kinds.alias("kinds")))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities", "kinds")

"""Personal data: detected entities get keyed surrogates of the same type, script, gender and format.

Detected are mail addresses, telephone numbers, IPv4 addresses, payment cards (valid check digit), social
security numbers, credentials, and names of persons (after a title, or with a known given name). The
surrogate is a function of a secret key and of the entity in its normal form, so an entity has the same
surrogate everywhere, however it is written. A person is named by given name and surname; the gender is the one
that the given name or the titles of all mentions in the corpus tell, if they tell one. Digits fill the format of the place, names keep their case,
given names their gender and script, cards a valid check digit, private addresses stay private. Later
mentions of a detected surname alone, in the same text, get that surname's surrogate.

Distinct entities must not meet: all entities of the corpus are listed once, with their surrogates, and those
whose surrogate is taken by another entity, or is itself an entity of the corpus, are drawn again until none
is left; from the fourth draw on the forms grow (syllables, letters, digits, wider address ranges), so there is
always room for all. Only the entities that were drawn again, and persons whose mentions tell their gender
differently, are joined back to their texts; if there are none, no text moves.

Null texts stay null, empty ones empty. A row is rewritten by itself, so repeated rows are rewritten alike; a
null key is a key. An empty table gives an empty result. Of surnames that overlap, the one that starts first is replaced. Very long texts are
handled whole, in the row. ``protect`` replaces the text column and keeps all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.registry import query, table
from webloom.runtime import cut

QUERY_SECRET = "key of the registered query"  # an application has its own, which it tells nobody

FEW_ROWS, FEW_BYTES = 100_000, 16 << 20  # (text, entity drawn again) pairs that may be broadcast: some 100 bytes each beside the entity

# Titles and given names tell a person; fixed values, by gender.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа", "Κυρία"),
          "n": ("Dr", "Prof", "Доктор")}
GIVEN = {("latin", "m"): "Adam Bruno Carlos David Erik Felix Georg Henri Ivan James John Lucas Martin Oscar Paul Robert Simon Thomas Victor William".split(),
         ("latin", "f"): "Alice Anna Beatrice Clara Diana Elena Emma Frida Greta Helen Irene Julia Karen Laura Maria Nora Olivia Paula Rosa Sofia".split(),
         ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Иван Кирилл Максим Николай Олег Павел Сергей".split(),
         ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Ирина Ксения Лариса Мария Нина Ольга Татьяна".split(),
         ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σταύρος Χρήστος".split(),
         ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα Βασιλική".split()}
SYLLABLES = {"latin": "bar bel cor dan del fen gar hal jen kel lam mer nor pel ros sal tam ven wil zan".split(),
             "cyrillic": "бар вел гор дан жер зим кал лом мин нар пол рос сам тер фил хор чер шал".split(),
             "greek": "βαρ γελ δαν ζερ καλ λαμ μιν νορ παλ ροσ σαλ ταμ φιλ χορ".split()}
ENDING = {("latin", "n"): ("er", "ley", "son", "mann"), ("cyrillic", "m"): ("ов", "ин"), ("cyrillic", "f"): ("ова", "ина"), ("greek", "n"): ("ίδης", "όπουλος")}

# a domain name has 127 labels at most; a repeated group without a bound would take a stack frame for each
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
ADDRESS = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
CARD = r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])" \
        r"|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])"
ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
CREDENTIAL = rf"""{ASSIGNED}(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{{6,}}|AKIA[A-Z0-9]{{16,}}|(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{{32,}}(?![A-Za-z0-9])"""
WORD = r"\p{Lu}[\p{L}'’-]+"
PERSON = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? {WORD}(?: {WORD}){{0,2}}" \
         rf"|(?:{'|'.join(n for g in GIVEN.values() for n in g)}) {WORD})"
ENTITY = "|".join((MAIL, CREDENTIAL, ADDRESS, CARD, SOCIAL, PHONE, PERSON))
TITLE = {g: rf"^(?:{'|'.join(t)})\.? " for g, t in TITLES.items()}
ANY_TITLE = rf"^(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? "


def may_hold_entity(text: Column) -> Column:
    """What every text with an entity has; most texts have none of it and are not searched further."""
    return text.contains("@") | text.contains("AKIA") | text.rlike("[0-9]") | text.rlike(PERSON)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Check sum of a digit string, the last digit counted once."""
    value = lambda c, i: F.when(i % 2 == 0, c).otherwise(F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2))
    return F.aggregate(F.transform(F.split(F.reverse(number), ""), lambda c, i: value(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def entity(raw: Column) -> Column:
    """Kind and normal form of a match; null where it is not an entity after all."""
    make = lambda kind, norm: F.struct(F.lit(kind).alias("kind"), norm.alias("norm"))
    number = digits(raw)
    is_card = raw.rlike(rf"^{CARD}$") & (luhn_sum(number) % 10 == 0) & ~raw.rlike("^0")

    def person_of(bare: Column) -> Column:
        given = lambda g: bare.rlike(rf"^(?:{'|'.join(n for (_, x), ns in GIVEN.items() if x == g for n in ns)}) ")
        gender = F.when(given("m"), "person_m").when(given("f"), "person_f").when(raw.rlike(TITLE["m"]), "person_m").when(raw.rlike(TITLE["f"]), "person_f")
        return F.struct(gender.otherwise("person_n").alias("kind"), F.lower(bare).alias("norm"))

    person = let(F.regexp_replace(raw, ANY_TITLE, ""), person_of)
    return (F.when(raw.rlike(rf"^{MAIL}$"), make("email", F.lower(raw))).when(raw.rlike(rf"^(?:{CREDENTIAL})$"), make("credential", F.regexp_replace(raw, f"^{ASSIGNED}", "")))
            .when(raw.rlike(rf"^{ADDRESS}$"), make("ip", raw)).when(is_card, make("card", number))
            .when(raw.rlike(rf"^{SOCIAL}$"), make("ssn", number)).when(raw.rlike(rf"^(?:{PHONE})$"), make("phone", F.right(number, F.lit(10))))
            .when(raw.rlike(rf"^(?:{PERSON})$"), person))


def sort_of(kind: Column) -> Column:
    """The kind that is part of an entity's identity: a person's gender is not."""
    return F.when(kind.startswith("person"), "person").otherwise(kind)


def seed(secret: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 keyed bytes as hexadecimal digits."""
    part = lambda i: F.sha2(F.concat_ws("|", F.lit(secret), sort_of(kind), norm, attempt.cast("string"), F.lit(str(i))), 256)
    return F.concat(*[part(i) for i in range(4)])


def number_at(stream: Column, i: Column, n: int) -> Column:
    """A keyed number below n; two bytes of the stream at place i."""
    return F.conv(F.substring(stream, (i * 2) % 252 + 1, F.lit(4)), 16, 10).cast("int") % n


def pick(stream: Column, i: int, choices) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), number_at(stream, F.lit(i), len(choices)))


def same_shape(text: Column, stream: Column) -> Column:
    """Each ASCII letter and digit replaced by a keyed one of its class."""
    at = lambda i, choices: F.substring(F.lit(choices), number_at(stream, i, len(choices)) + 1, F.lit(1))
    one = lambda c, i: (F.when(c.between("0", "9"), at(i, "0123456789")).when(c.between("a", "z"), at(i, "abcdefghijklmnopqrstuvwxyz"))
                        .when(c.between("A", "Z"), at(i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def grown(attempt: Column) -> Column:
    """By how much a form is longer than the plain one: from the fourth draw on, one more with each draw."""
    return F.greatest(attempt - 3, F.lit(0))


def syllables(stream: Column, s: str, more: Column) -> Column:
    """Three syllables and ``more``, as a name."""
    choices = F.array(*[F.lit(c) for c in SYLLABLES[s]])
    further = F.transform(F.slice(F.sequence(F.lit(4), more + 4), F.lit(2), more), lambda i: F.get(choices, number_at(stream, i, len(SYLLABLES[s]))))
    return F.initcap(F.concat(*[pick(stream, i, SYLLABLES[s]) for i in range(3)], F.array_join(further, "")))


def surname_of(stream: Column, norm: Column, attempt: Column) -> Column:
    """Three syllables, more after some draws, and an ending in the script of the name; Cyrillic endings keep the gender of the form."""
    made = lambda s, g: F.concat(syllables(stream, s, grown(attempt)), pick(stream, 3, ENDING[s, g]))
    kind = script(norm)
    return (F.when((kind == "cyrillic") & norm.rlike("[ая]$"), made("cyrillic", "f")).when(kind == "cyrillic", made("cyrillic", "m"))
            .when(kind == "greek", made("greek", "n")).otherwise(made("latin", "n")))


def given_of(stream: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    """A listed given name of the gender and script; from the fourth draw on a made one that grows, so that names never run out."""
    rule, sort = F, script(norm)
    for s in ("cyrillic", "greek", "latin"):
        made = syllables(stream, s, F.greatest(grown(attempt) - 1, F.lit(0)))
        for g in ("m", "f", "n"):
            names = GIVEN[s, g] if g != "n" else GIVEN[s, "m"] + GIVEN[s, "f"]
            rule = rule.when((sort == s) & (kind == f"person_{g}"), F.when(attempt >= 4, made).otherwise(pick(stream, 4, names)))
    return rule


def surrogates(needs: Column, secret: str) -> Column:
    """(kind, norm, made) for (kind, norm, attempt): the surrogate in normal form."""
    streams = F.transform(needs, lambda r: F.struct(
        r["kind"].alias("kind"), r["norm"].alias("norm"), r["attempt"].alias("attempt"), F.char_length(r["norm"]).alias("n"),
        seed(secret, r["kind"], r["norm"], r["attempt"]).alias("stream"),
        seed(secret, F.lit("domain"), F.substring_index(r["norm"], "@", -1), F.lit(0)).alias("domain")))
    shaped = F.transform(streams, lambda r: F.struct(r.alias("of"), same_shape(r["norm"], r["stream"]).alias("shaped")))
    return F.transform(shaped, lambda r: F.struct(r["of"]["kind"].alias("kind"), r["of"]["norm"].alias("norm"), made_of(r["of"], r["shaped"]).alias("made")))


def made_of(r: Column, shaped: Column) -> Column:
    kind, norm, attempt, n, stream = (r[c] for c in ("kind", "norm", "attempt", "n", "stream"))
    top = F.when(norm.rlike(r"\.(?:com|net|org)$"), F.substring_index(norm, ".", -1)).otherwise("org")
    more = grown(attempt)
    further = lambda letters, size: same_shape(F.repeat(F.lit(letters), more * size), F.substring(stream, 101, 100))
    mail = F.concat(F.substring_index(shaped, "@", 1), further("a", 8), F.lit("@"), same_shape(F.lit("aaaaaa"), r["domain"]), F.lit(".example."), top)
    octet = lambda i, size, low: (number_at(stream, F.lit(i), size) + low).cast("string")
    tail = lambda k: [octet(i, 256, 0) for i in range(k)]
    # a range that is full gives way to a wider one of its sort; the last resort are local and documentation addresses of IPv6
    groups = [F.substring(stream, 129 + 4 * i, 4) for i in range(8)]
    wide = (F.when(norm.rlike(r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."), F.concat(F.lit("fd"), F.substring(stream, 161, 2), F.lit(":"), F.concat_ws(":", *groups[:7])))
            .otherwise(F.concat(F.lit("2001:db8:"), F.concat_ws(":", *groups[:6]))))
    address = (F.when(attempt >= 8, wide).when((attempt >= 4) & norm.rlike(r"^(?:192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."), F.concat_ws(".", F.lit("10"), *tail(3)))
               .when(norm.rlike(r"^(?:10|127)\."), F.concat_ws(".", F.substring_index(norm, ".", 1), *tail(3)))
               .when(norm.rlike(r"^(?:192\.168|169\.254)\."), F.concat_ws(".", F.substring_index(norm, ".", 2), *tail(2)))
               .when(norm.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), octet(5, 16, 16), *tail(2)))
               .otherwise(F.concat_ws(".", octet(7, 89, 11), *tail(3))))
    checked = lambda body: F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    card = let(F.concat(F.substring(norm, 1, 1), F.substring(shaped, F.lit(2), n - 2)), checked)
    phone = F.concat((number_at(stream, F.lit(60), 8) + 2).cast("string"), F.substring(shaped, F.lit(2), F.lit(2)),
                     (number_at(stream, F.lit(61), 8) + 2).cast("string"), F.substring(shaped, F.lit(5), F.lit(6)), further("0", 2))
    size = n + more * 4
    hexadecimal = F.substring(F.concat(stream, F.repeat(stream, F.floor(size / 256).cast("int"))), F.lit(1), size)
    credential = (F.when(norm.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substring(shaped, F.lit(5), n), further("A", 4)))
                  .when(norm.rlike("^[0-9a-f]+$"), hexadecimal).otherwise(F.concat(shaped, further("a", 4))))
    person = F.concat(given_of(stream, kind, norm, attempt), F.lit(" "), F.substring_index(norm, " ", -1))
    return (F.when(kind == "email", mail).when(kind == "credential", credential).when(kind == "ip", address).when(kind == "card", card)
            .when(kind == "ssn", F.concat(F.lit("9"), F.substring(shaped, F.lit(2), F.lit(8)), further("0", 2))).when(kind == "phone", phone)
            .when(kind == "surname", surname_of(stream, norm, attempt)).otherwise(person))


def entities_of(found: Column) -> Column:
    """The entities to be listed: a person counts by surname and, where a given name is there, as a whole."""
    is_person = lambda e: e["kind"].startswith("person")
    named = F.transform(F.filter(found, is_person), lambda e: F.struct(F.lit("surname").alias("kind"), F.substring_index(e["norm"], " ", -1).alias("norm")))
    kept = F.filter(found, lambda e: ~is_person(e) | e["norm"].contains(" "))
    return F.array_distinct(F.concat(kept, named))


def matched(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), entity)


def drawn_again(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogates were not free."""
    def draw(df: DataFrame, k: int) -> DataFrame:
        made = surrogates(F.array(F.struct("kind", "norm", F.lit(k).alias("attempt"))), secret)
        return df.select("kind", "norm", F.lit(k).alias("attempt"), F.lower(F.get(made, F.lit(0))["made"]).alias("made"))

    taken = cut(draw(entities, 0))
    real = entities.select(sort_of(F.col("kind")).alias("sort"), F.lower("norm").alias("made")).distinct()
    k = 0
    while True:
        sorted_ = taken.withColumn("sort", sort_of(F.col("kind")))
        first = sorted_.groupBy("sort", "made").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count(F.lit(1)).alias("n"))
        first = first.join(real.withColumn("real", F.lit(True)), ["sort", "made"], "left")
        clash = first.where("n > 1 or real")
        # the one that had it first keeps it, unless it is an entity of the corpus
        loser = sorted_.join(clash, ["sort", "made"]).where(~((F.col("attempt") == F.col("first.attempt")) & (F.col("norm") == F.col("first.norm"))) | F.col("real"))
        loser = cut(loser.select("kind", "norm"))
        if loser.isEmpty():
            return taken.where("attempt > 0").select("kind", "norm", "attempt")
        k += 1
        taken = cut(taken.join(loser, ["kind", "norm"], "left_anti").unionByName(draw(loser, k)))


def once_each(mentions: DataFrame) -> DataFrame:
    """(kind, norm, mixed) for mentions (kind, norm): a person is of the one gender that mentions tell, else of none.

    ``mixed`` marks persons whose mentions do not all tell the same; their texts need to be told.
    """
    told = F.collect_set(F.when(F.col("kind") != "person_n", F.col("kind")))
    each = mentions.groupBy(sort_of(F.col("kind")).alias("sort"), "norm").agg(told.alias("told"), F.count_distinct("kind").alias("kinds"))
    return each.select(F.when(F.size("told") == 1, F.get("told", F.lit(0))).otherwise("person_n").alias("kind"), "norm", (F.col("kinds") > 1).alias("mixed"))


def filled(raw: Column, number: Column) -> Column:
    """The digits of ``raw`` replaced, from the right, by those of ``number``; what stands left of them stays.

    A number with more digits than ``raw`` has puts those it has more in the place of the first.
    """
    start = F.struct(F.lit("").alias("out"), (F.char_length(number) - F.char_length(digits(raw)) + 1).alias("i"),
                     (F.char_length(number) > F.char_length(digits(raw))).alias("first"))
    step = lambda a, c: F.when(
        c.between("0", "9"), F.struct(F.concat(a["out"], F.when(a["i"] >= 1, F.substring(number, F.when(a["first"], F.lit(1)).otherwise(a["i"]), F.when(a["first"], a["i"]).otherwise(F.lit(1)))).otherwise(c)).alias("out"), (a["i"] + 1).alias("i"), F.lit(False).alias("first"))
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"), a["first"].alias("first")))
    return F.aggregate(F.split(raw, ""), start, step, lambda a: a["out"])


def cased(raw: Column, made: Column) -> Column:
    return F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(made)).otherwise(made)


def protect(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """The input with its entities replaced; columns and their order are kept. ``secret`` decides all surrogates."""
    body = docs[text]
    found = docs.where(may_hold_entity(body)).select(F.filter(matched(body), lambda e: e.isNotNull()).alias("found"))
    entities = cut(once_each(found.select(F.explode(entities_of(F.col("found"))).alias("e")).select("e.kind", "e.norm").distinct()))
    again = drawn_again(entities.select("kind", "norm"), secret)
    mixed = entities.where("mixed").select("kind", "norm")
    again = again.unionByName(mixed.join(again, ["kind", "norm"], "left_anti").withColumn("attempt", F.lit(0)))
    again = cut(again.select(sort_of(F.col("kind")).alias("sort"), "norm", "kind", "attempt"))
    if again.isEmpty():
        return rewritten(docs, text, secret, None)
    # which texts hold an entity that was drawn again, or a person told elsewhere: short lists, by text
    hold = docs.where(may_hold_entity(body)).select(F.xxhash64(body).alias("h"), F.md5(body.cast("binary")).alias("m"), F.filter(matched(body), lambda e: e.isNotNull()).alias("found"))
    hold = hold.select("h", "m", F.explode(entities_of(F.col("found"))).alias("e")).select("h", "m", sort_of(F.col("e.kind")).alias("sort"), "e.norm").join(again, ["sort", "norm"])
    hold = cut(hold)
    rows, size = hold.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("norm")), F.lit(0))).first()
    hold = hold.groupBy("h", "m").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "sort", "norm"), F.struct("kind", "attempt")))).alias("told"))
    if rows <= FEW_ROWS and size <= FEW_BYTES:
        hold = F.broadcast(hold)  # the texts stay where they are
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(text)}"
    joined = renamed.withColumns({"h": F.xxhash64(own), "m": F.md5(F.col(own).cast("binary"))}).join(hold, ["h", "m"], "left")
    return rewritten(joined, own, secret, F.col("told")).select(*renamed.columns).toDF(*names)


def rewritten(docs: DataFrame, text: str, secret: str, told: Column | None) -> DataFrame:
    body = docs[text]
    name = lambda e: F.concat_ws("|", sort_of(e["kind"]), e["norm"])

    def need(e: Column) -> Column:
        """(kind, norm, attempt) as the whole corpus has it."""
        kind, attempt = e["kind"], F.lit(0)
        if told is not None:
            known = F.element_at(told, name(e))
            kind, attempt = F.coalesce(known["kind"], kind), F.coalesce(known["attempt"], attempt)
        return F.struct(kind.alias("kind"), e["norm"].alias("norm"), attempt.alias("attempt"))

    def replaced(m: Column, book: Column) -> Column:
        """A match by the book of surrogates (kind|norm to surrogate) of its text."""
        raw, kind, norm = m["raw"], m["e"]["kind"], m["e"]["norm"]
        title = F.regexp_extract(raw, ANY_TITLE, 0)
        given = F.when(norm.contains(" "), F.concat(F.substring_index(F.element_at(book, name(m["e"])), " ", 1), F.lit(" "))).otherwise("")
        last = F.element_at(book, F.concat(F.lit("surname|"), F.substring_index(norm, " ", -1)))
        return (F.when(kind.isNull(), raw).when(kind == "email", cased(raw, F.element_at(book, name(m["e"]))))
                .when(kind == "ip", F.element_at(book, name(m["e"])))
                .when(kind == "credential", F.concat(F.regexp_extract(raw, f"^(?:{ASSIGNED})?", 0), F.element_at(book, name(m["e"]))))
                .when(kind.isin("card", "ssn", "phone"), filled(raw, F.element_at(book, name(m["e"]))))
                .otherwise(F.concat(title, cased(raw, F.concat(given, last)))))

    def rebuilt(found: Column) -> Column:
        listed = entities_of(F.filter(F.transform(found, lambda m: m["e"]), lambda e: e.isNotNull()))
        needs = F.array_distinct(F.transform(listed, need))
        book = F.map_from_entries(F.transform(surrogates(needs, secret), lambda r: F.struct(name(r), r["made"])))
        last = F.array_distinct(F.transform(F.filter(found, lambda m: m["e"]["kind"].startswith("person")), lambda m: F.substring_index(m["raw"], " ", -1)))
        return let(F.struct(book.alias("book"), last.alias("last")), lambda known: joined(found, known["book"], known["last"]))

    def joined(found: Column, book: Column, last: Column) -> Column:
        mention = F.concat(F.lit(r"(?<!\p{L})(?:\Q"), F.array_join(last, r"\E|\Q"), F.lit(r"\E)(?!\p{L})"))
        surname = lambda x: cased(x, F.element_at(book, F.concat(F.lit("surname|"), F.lower(x))))
        between = lambda gap: let(mention, lambda p: F.array_join(F.zip_with(  # noqa: E731  a surname alone
            F.split(gap, p, -1), F.transform(F.regexp_extract_all(gap, p, F.lit(0)), surname), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), ""))
        gaps = F.split(body, ENTITY, -1)
        gaps = F.when(F.size(last) > 0, F.transform(gaps, between)).otherwise(gaps)
        return F.array_join(F.zip_with(gaps, F.transform(found, lambda m: replaced(m, book)), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")

    whole = let(F.regexp_extract_all(body, F.lit(ENTITY), F.lit(0)), lambda raws: F.when(
        F.size(raws) > 0, let(F.transform(raws, lambda r: F.struct(r.alias("raw"), entity(r).alias("e"))), rebuilt)).otherwise(body))
    return docs.withColumn(text, F.when(may_hold_entity(body), whole).otherwise(body))


@query("op4_surrogates")
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protect(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_SECRET)

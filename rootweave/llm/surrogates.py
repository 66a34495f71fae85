"""Surrogates for personal data: keyed, consistent replacements of the same type and format.

One pattern finds all entities: by their form, by titles, lists of first names, and what introduces or follows a name; a
name found once in a text is also found where the text repeats it or its family name alone. Distinct entities (by type
and canonical form) get one surrogate each. What has a format (numbers, addresses, secrets) goes through a keyed
permutation of its own format: a Feistel network over its letters and digits, which keeps different entities different.
Names are replaced part by part, so that a family name is the same in every mention: first names by ones of the same
gender and script, family names by ones made of syllables of the script. Surrogates that another entity also has, or
that are themselves entities of the corpus, are drawn again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.llm.session import spread_join, stored

# First names by gender (u: either) and script, titles by gender, words that lead to a name or follow it.
FIRST_NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carmen Caroline Charlotte Claire Claudia Daniela Elena Elizabeth Emily Emma Eva Helena Isabel Jennifer Jessica Julia Karen Katharina Laura Linda Lucia Margaret Maria Martina Mary Monika Nancy Olivia Patricia Petra Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria",
    ("m", "latin"): "Alexander Andreas Anthony Carlos Charles Christian Christopher Daniel David Diego Edward Fernando Francisco Frank George Henry Jack James Javier John Jorge Joseph Karl Kevin Klaus Manuel Mark Martin Matthew Michael Miguel Nicolas Oliver Pablo Patrick Paul Peter Philippe Pierre Richard Robert Stefan Thomas William Wolfgang",
    ("f", "cyrillic"): "Александра Анна Валентина Вера Галина Екатерина Елена Ирина Любовь Мария Надежда Наталья Ольга Светлана Татьяна Юлия",
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Владимир Виктор Дмитрий Евгений Иван Игорь Михаил Николай Олег Павел Сергей Юрий",
    ("f", "greek"): "Αικατερίνη Άννα Γεωργία Δήμητρα Ελένη Ιωάννα Κωνσταντίνα Μαρία Σοφία Χριστίνα",
    ("m", "greek"): "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Μιχαήλ Νικόλαος Παναγιώτης Χρήστος",
    ("u", "latin"): "Alex Andrea Ariel Charlie Dominique Jamie Jules Kim Morgan Noor Robin Sam Sasha Taylor Toni",
    ("u", "cyrillic"): "Женя Саша Шура Валя",
    ("u", "greek"): "Αλέξις Άρη Χρύσα",
}
SYLLABLES = {
    "latin": "an bar ber cor dal del el fen gar hal hol im jen kar lan lin lor mar men mor nel nor os per quin ral ran ros sal sten tam tor ul van ver wen wil yor zan zel",
    "cyrillic": "бар бел вер вол гор гур дар дол жур зим кал кор лар лес мал мир нов пав рад сав сем тар фил чер",
    "greek": "αλ βασ γερ δημ καλ κων λαμ μαν μιχ νικ παν παπ πετ σαμ σταυ τσα φιλ χατζ",
}
#: What a family name ends with, by script and gender (Greek and Cyrillic ones follow the gender).
ENDINGS = {("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов", ("greek", "f"): "ίδου", ("greek", "m"): "ίδης"}
TITLES = {
    "f": "Mrs Ms Miss Madame Lady Frau Señora Sra Госпожа Κυρία",
    "m": "Mr Sir Lord Monsieur Herr Señor Sr Господин Κύριος",
    "u": "Dr Prof Professor Doctor Doktor Mx Rev Hon Доктор Профессор Δρ",
}
LEADS = "my name is|name is|name:|contact:|contact person:|author:|signed by|signed,|sincerely,|regards,|attn:|attn|dear"
FOLLOWS = "said|says|wrote|writes|told|asked|replied|called|emailed|signed"
# What introduces a secret, and what an entity of each type looks like.
INTRODUCED = r"(?i:(?:api[_-]?key|token|secret|password|passwd)['\"]?\s{0,3}[:=]\s{0,3}['\"]?)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![\p{L}\p{N}])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
TYPES = {
    # of any length, with dots and padding inside; a dot at its end is the sentence's
    "secret": rf"{INTRODUCED}(?!{EMAIL}|{IP})[A-Za-z0-9+/_-][A-Za-z0-9+/_.=-]{{10,}}[A-Za-z0-9+/_=-]",
    "email": EMAIL,
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": IP,
    "ipv6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?:[0-9]{0,3})(?![0-9.-]?[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9][ .-]|[0-9])[0-9]{3} [0-9]{3} [0-9]{4}(?![ .-]?[0-9])",
}
#: Characters one of which an entity of each type begins with, so that most places of a text are passed over at once.
BEGINS = {"secret": "[aAtTsSpP]", "ipv6": "[0-9A-Fa-f]{1,4}:", "iban": "[A-Z]{2}[0-9]", **dict.fromkeys(("ip", "ssn", "card", "phone"), "[0-9+(]")}
NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?"
PARTICLES = "al bin da de del della den der di dos du el la le ten ter van von y zu"
#: A further part of a name, with what may stand before it.
PART = rf"(?: (?:{'|'.join(PARTICLES.split())})){{0,3}} {NAME}"
#: Places and institutions begin with these; before a verb of speech they are no first names.
NO_NAMES = "Associated Bank Black Blue British Central City Court East Federal General Grand Great Green High Los National New North Red Royal Saint San Santa South State Supreme The This That United Universal University West White"
TITLE = rf"(?:{'|'.join(sorted(' '.join(TITLES.values()).split()))})\.?"
MARK, ESCAPE = "﷐", "﷑"  # noncharacters; texts that hold them are escaped meanwhile
#: The key's setting. The value that stands here is public: with it, formats can be turned back by anybody.
SETTING, KEY = "spark.rootweave.surrogates.key", "rootweave-demo-key"
#: Letters beyond a to z that are moved within their own alphabet; others stay.
ALPHABETS = ("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
#: How often a surrogate is drawn before a format counts as exhausted.
DRAWS = 6
FEISTEL = 4


def name_pattern() -> str:
    listed = {n for names in FIRST_NAMES.values() for n in names.split()}
    firsts = "|".join(sorted(listed | {n.upper() for n in listed}))
    places = "|".join(NO_NAMES.split())
    return (
        rf"(?=\p{{Lu}})\b(?:{TITLE}(?: {TITLE})? {NAME}(?:{PART}){{0,3}}|(?:{firsts})(?:-{NAME})?(?:{PART}){{1,3}}"
        rf"|(?<=\b(?i:{LEADS})\s{{1,3}}){NAME}(?:{PART}){{1,3}}|(?!(?:{places})\b){NAME} {NAME}(?= (?:{FOLLOWS})\b))"
    )


def entity_pattern(emails: bool = True) -> str:
    kinds = [k for k in TYPES if emails or k != "email"]
    return "|".join([*(f"(?:(?={BEGINS[k]}){TYPES[k]})" if k in BEGINS else f"(?:{TYPES[k]})" for k in kinds), f"(?:{name_pattern()})"])


def kind_of(entity: Column) -> Column:
    """The first type whose pattern the whole entity has; names are what remains."""
    return reduce(lambda rest, t: F.when(entity.rlike(f"^(?:{TYPES[t]})$"), t).otherwise(rest), reversed(TYPES), F.lit("name"))


def canonical(kind: Column, entity: Column) -> Column:
    """What makes two spellings one entity: case and separators don't count, nor what introduces a secret."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    secret = F.regexp_extract(entity, rf"^{INTRODUCED}(.+)$", 1)
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "secret", F.lower(secret)).when(kind == "iban", F.lower(F.replace(entity, F.lit(" ")))).otherwise(F.lower(entity))


def bare_name(entity: Column) -> Column:
    return F.regexp_replace(entity, rf"^(?:{TITLE} )+", "")


def gender_of(entity: Column) -> Column:
    """f or m by title, else by the list of first names; null if neither tells."""
    titled = {g: rf"^(?:{TITLE} )?(?:{'|'.join(TITLES[g].split())})\b" for g in "fm"}
    listed = {g: [n for (x, _), names in FIRST_NAMES.items() if x == g for n in names.split()] for g in "fm"}
    first = F.initcap(F.substring_index(F.substring_index(bare_name(entity), " ", 1), "-", 1))
    return F.when(first.isin(listed["f"]), "f").when(first.isin(listed["m"]), "m").when(entity.rlike(titled["f"]), "f").when(entity.rlike(titled["m"]), "m")


def script_of(entity: Column) -> Column:
    return F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda it would be taken anew for each element."""
    return F.transform(F.array(value), body)[0]


def stream_of(key: str, *parts: Column) -> Column:
    """Hexadecimal digits of 128 pseudo-random bytes (for longer texts repeated)."""
    text = F.concat_ws("|", F.lit(key), *parts)
    return bound(text, lambda t: F.concat(*[F.sha2(F.concat(t, F.lit(f"|{i}")), 256) for i in range(4)]))


def byte_at(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (2 * F.pmod(i, F.lit(128)) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def number_at(stream: Column, place: int) -> Column:
    return F.conv(F.substring(stream, 12 * place + 1, 12), 16, 10).cast("long")


def shifted(text: Column, stream: Column, letters: Column) -> Column:
    """Every digit and letter moved on within its kind; ``letters``: how many the text's letters are."""

    def other(c: Column, i: Column) -> Column:
        digit, letter = c.rlike("[0-9]"), c.rlike("[a-z]")
        b = byte_at(stream, i)
        moved = F.chr(97 + F.pmod(F.ascii(c) - 97 + b, letters))
        own = c
        for alphabet in ALPHABETS:
            at = F.instr(F.lit(alphabet), c)
            own = F.when(at > 0, F.substr(F.lit(alphabet), F.pmod(at - 1 + b, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(own)
        return F.when(digit, F.pmod(F.ascii(c) - 48 + b, F.lit(10)).cast("string")).when(letter, moved).when(c < "\x80", c).otherwise(own)

    return F.array_join(F.transform(F.split(text, ""), other), "")


def permuted(text: Column, letters: Column, key: str, *tweak: Column) -> Column:
    """A keyed permutation of all texts with the same digits and letters in the same places."""
    half = F.floor(F.length(text) / 2).cast("int")
    state = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))

    def step(s: Column, i: Column) -> Column:
        mixed = bound(stream_of(key, *tweak, i.cast("string"), s["r"]), lambda stream: shifted(s["l"], stream, letters))
        return F.struct(s["r"].alias("l"), mixed.alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(FEISTEL))), state, step, lambda s: F.concat(s["l"], s["r"]))


def permuted_ip(ip: Column, key: str, *tweak: Column) -> Column:
    """A keyed permutation of all addresses with as many digits in each place."""
    octets = F.split(ip, r"\.")
    least = lambda o: F.when(F.length(o) == 3, 100).when(F.length(o) == 2, 10).otherwise(0)
    many = lambda o: F.when(F.length(o) == 3, 156).when(F.length(o) == 2, 90).otherwise(10).cast("long")
    half = lambda a, b: (octets[a].cast("long") - least(octets[a])) * many(octets[b]) + octets[b].cast("long") - least(octets[b])
    sizes = [many(octets[0]) * many(octets[1]), many(octets[2]) * many(octets[3])]
    state = F.struct(half(0, 1).alias("l"), sizes[0].alias("nl"), half(2, 3).alias("r"), sizes[1].alias("nr"))

    def step(s: Column, i: Column) -> Column:
        moved = F.pmod(s["l"] + number_at(stream_of(key, *tweak, i.cast("string"), s["r"].cast("string")), 0), s["nl"])
        return F.struct(s["r"].alias("l"), s["nr"].alias("nl"), moved.alias("r"), s["nl"].alias("nr"))

    def written(s: Column) -> Column:
        pair = lambda x, a, b: [F.floor(x / many(octets[b])).cast("long") + least(octets[a]), F.pmod(x, many(octets[b])) + least(octets[b])]
        return F.concat_ws(".", *[o.cast("string") for o in (*pair(s["l"], 0, 1), *pair(s["r"], 2, 3))])

    return F.aggregate(F.array(*map(F.lit, range(FEISTEL))), state, step, written)


def check_digit(digits: Column) -> Column:
    """What makes the digits before it a valid card number."""
    count = F.length(digits)

    def weighed(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when((count - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.transform(F.split(digits, ""), weighed), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10))


def permuted_card(digits: Column, key: str, *tweak: Column) -> Column:
    """All digits but the last are permuted; the last is as far from the check digit as it was."""
    front = F.substr(digits, F.lit(1), F.length(digits) - 1)
    off = F.right(digits, F.lit(1)).cast("int") - check_digit(front)
    return bound(permuted(front, F.lit(26), key, *tweak), lambda new: F.concat(new, F.pmod(check_digit(new) + off, F.lit(10)).cast("string")))


def drawn(kind: Column, canon: Column, gender: Column, script: Column, draw: int, key: str) -> Column:
    """A candidate for a canonical entity: same type, length and kinds of characters; for a part of a name same gender and script."""
    tweak = (kind, F.lit(str(draw)))
    plain = permuted(canon, F.lit(26), key, *tweak)
    secret = permuted(canon, F.when((kind == "ipv6") | canon.rlike("^[0-9a-f]+$"), 6).otherwise(26), key, *tweak)
    top = F.concat(F.lit("."), F.substring_index(canon, ".", -1))
    email = F.concat(permuted(F.substr(canon, F.lit(1), F.length(canon) - F.length(top)), F.lit(26), key, *tweak), top)
    iban = F.concat(F.substring(canon, 1, 2), permuted(F.substr(canon, F.lit(3)), F.lit(26), key, *tweak))
    name = bound(stream_of(key, *tweak, canon), lambda stream: F.when(kind == "first", first_name(stream, gender, script, draw)).otherwise(family_name(stream, canon, gender, script, draw)))
    return (
        F.when(kind.isin("first", "family"), name)
        .when(kind == "ip", permuted_ip(canon, key, *tweak))
        .when(kind == "card", permuted_card(canon, key, *tweak))
        .when(kind == "email", email)
        .when(kind.isin("secret", "ipv6"), secret)
        .when(kind == "iban", iban)
        .otherwise(plain)
    )


def chosen(stream: Column, names: str, place: int) -> Column:
    """One of the names, by the number at a place of the stream."""
    return F.element_at(F.array(*map(F.lit, names.lower().split())), (number_at(stream, place) % len(names.split()) + 1).cast("int"))


def first_name(stream: Column, gender: Column, script: Column, draw: int) -> Column:
    """One name of the pool; with more draws two, three and so on: the pools are finite, these aren't."""
    parts = 1 + draw // 3
    pool = lambda k: F.concat_ws("-", *[chosen(stream, FIRST_NAMES[k], i) for i in range(parts)])
    return reduce(lambda rest, k: F.when((gender == k[0]) & (script == k[1]), pool(k)).otherwise(rest), FIRST_NAMES, pool(("u", "latin")))


def family_name(stream: Column, canon: Column, gender: Column, script: Column, draw: int) -> Column:
    """Three syllables and the ending of the gender that the name itself shows; with more draws more syllables."""
    stem = lambda s: F.concat(*[chosen(stream, SYLLABLES[s], i) for i in range(3 + draw // 3)])
    female = canon.rlike("(?:ова|ева|ина|ая)$|(?:ου|ά|ή)$")
    ended = lambda s: F.concat(stem(s), F.when(female, ENDINGS[s, "f"]).otherwise(ENDINGS[s, "m"]))
    return F.when(script == "cyrillic", ended("cyrillic")).when(script == "greek", ended("greek")).otherwise(stem("latin"))


def dressed(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate as its entity is written: separators, introduction and case."""
    # digits go into the places of the entity's digits
    places = F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(surrogate, F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c))
    grouped = F.transform(F.split(entity, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(F.upper(surrogate), F.length(F.replace(F.substr(entity, F.lit(1), i + 1), F.lit(" "))), F.lit(1))))
    upper, lower = entity == F.upper(entity), entity == F.lower(entity)
    secret = F.regexp_extract(entity, rf"^{INTRODUCED}(.+)$", 1)
    introduced = F.concat(F.substr(entity, F.lit(1), F.length(entity) - F.length(secret)), F.when(secret == F.upper(secret), F.upper(surrogate)).otherwise(surrogate))
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.array_join(places, ""))
        .when(kind == "iban", F.array_join(grouped, ""))
        .when(kind == "secret", introduced)
        .when(upper & ~lower, F.upper(surrogate))
        .otherwise(surrogate)
    )


def capitalised(part: Column, surrogate: Column) -> Column:
    """A part of a name in the case in which it is written."""
    title = F.regexp_replace(F.initcap(F.replace(surrogate, F.lit("-"), F.lit("- "))), "- ", "-")
    return F.when((part == F.upper(part)) & (F.length(part) > 1), F.upper(surrogate)).otherwise(title)


def shape_of(kind: Column, canon: Column) -> Column:
    """What a permutation leaves as it is."""
    return F.concat_ws("|", kind, F.when(kind == "secret", canon.rlike("^[0-9a-f]+$").cast("string")), F.regexp_replace(F.regexp_replace(canon, "[0-9]", "0"), "[a-z]", "a"))


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon and surrogate for each distinct (kind, canon) of ``entities`` (kind, canon, gender, script).

    Collision checks: a candidate is kept by the entity that alone has it (of several the smallest canonical form) if no
    entity of the corpus is written like it; all others draw again. Names have ever more room with every draw. A format of
    which an entity is still without surrogate after DRAWS draws is exhausted: its entities fill its space, so that
    surrogates must be such that also occur in the corpus. All of that format then take one permutation's values, which
    are different for different entities.
    """
    real = entities.select(F.col("kind").alias("real_kind"), F.col("canon").alias("real")).distinct()
    open_, done, draw = stored(entities, "entities"), None, 0
    columns = [F.col(c) for c in ("kind", "canon", "gender", "script")]
    while True:
        some = open_.withColumn("surrogate", drawn(*columns, draw, key))
        some = some.join(real, (F.col("kind") == F.col("real_kind")) & (F.col("surrogate") == F.col("real")), "left").drop("real_kind")
        claims = some.where("real is null").select("kind", "canon", "surrogate", F.lit(1).alias("order"))
        if done is not None:
            claims = claims.unionByName(done.select("kind", "canon", "surrogate", F.lit(0).alias("order")))
        winner = claims.groupBy("kind", "surrogate").agg(F.min(F.struct("order", "canon")).alias("winner"))
        won = F.col("real").isNull() & (F.col("winner.order") == 1) & (F.col("winner.canon") == F.col("canon"))
        some = stored(some.join(winner, ["kind", "surrogate"], "left").withColumn("won", F.coalesce(won, F.lit(False))).drop("real", "winner"), "drawn")
        kept = some.where("won").drop("won")
        done = kept if done is None else done.unionByName(kept)
        open_ = some.where("not won").drop("won", "surrogate")
        draw += 1
        if draw == DRAWS:
            full = stored(open_.where("kind not in ('first', 'family')").select(shape_of(*columns[:2]).alias("full")).distinct(), "exhausted")
            if not full.isEmpty():
                again = entities.join(full, shape_of(*columns[:2]) == F.col("full"), "left_semi").withColumn("surrogate", drawn(*columns, 0, key))
                done = stored(done.join(full, shape_of(*columns[:2]) == F.col("full"), "left_anti").unionByName(again.select(done.columns)), "placed")
                open_ = open_.where("kind in ('first', 'family')")
        if open_.isEmpty():
            return done


def replace_entities(docs: DataFrame, key: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Texts with every detected entity replaced by its surrogate.

    Returns one row for each row of ``docs``: doc_id, text, n_entities (places replaced) and the columns named in
    ``carry``; others are left out, so that they can't clash. Equal entities get equal surrogates all over the corpus,
    different ones of a type different ones; a first or family name is replaced alike wherever it is part of a name (of a
    name of more parts the first is the first name; all others but particles are family names). ``key`` is that of the
    session's setting spark.rootweave.surrogates.key where none is given. A
    null text stays null, an empty one empty; doc_id may be null or repeat, and rows may. An empty table has no rows.
    """
    key = key or docs.sparkSession.conf.get(SETTING, KEY)
    carried = F.struct(F.lit(0).alias("none"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), carried.alias("carried"))
    escaped = F.col("text").contains(MARK) | F.col("text").contains(ESCAPE)
    safe = F.replace(F.replace("text", F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(MARK), F.lit(ESCAPE + "a"))
    text = F.when(escaped, safe).otherwise(F.col("text"))
    marked = [F.regexp_replace(text, entity_pattern(emails), f"{MARK}$0{MARK}") for emails in (True, False)]
    parts = F.split(F.when(F.col("text").contains("@"), marked[0]).otherwise(marked[1]), MARK)
    # written once with a number for each row: no copy of a text, and no repeated id, meets another in one task
    rows = stored(plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "carried", escaped.alias("escaped"), with_repeats(parts).alias("parts")), "marked")
    unread, read = rows.where("coalesce(size(parts), 0) <= 1"), rows.where("size(parts) > 1")
    found = read.select("row", F.posexplode(F.filter("parts", lambda x, i: i % 2 == 1)).alias("place", "entity"))
    entity, kind = F.col("entity"), F.col("kind")
    spelled = stored(found.select("entity").distinct().withColumn("kind", kind_of(entity)), "spelled")

    formed = spelled.where("kind <> 'name'").withColumn("canon", canonical(kind, entity))
    bare = bare_name(entity)
    people = spelled.where("kind = 'name'").select("entity", F.substr(entity, F.lit(1), F.length(entity) - F.length(bare)).alias("title"), bare.alias("bare"), gender_of(entity).alias("gender"), script_of(entity).alias("script"))
    particle = F.col("part").isin(PARTICLES.split())
    role = F.when(particle, "particle").when((F.col("at") == 0) & F.col("bare").contains(" "), "first").otherwise("family")
    people = people.select("entity", "title", "bare", "gender", "script", F.posexplode(F.split("bare", " ")).alias("at", "part")).withColumn("role", role)
    none = F.lit(None).cast("string")
    entities = formed.select("kind", "canon", none.alias("gender"), none.alias("script"))
    entities = entities.unionByName(people.where("role <> 'particle'").select(F.col("role").alias("kind"), F.lower("part").alias("canon"), "gender", "script"))
    entities = entities.groupBy("kind", "canon").agg(F.coalesce(F.min("gender"), F.lit("u")).alias("gender"), F.min("script").alias("script"))
    table = surrogate_table(stored(entities, "parts"), key).select("kind", "canon", "surrogate")

    replaced = formed.join(table, ["kind", "canon"]).select("entity", dressed(kind, entity, F.col("surrogate")).alias("surrogate"))
    parts_new = table.where("kind in ('first', 'family')").select(F.col("kind").alias("role"), F.col("canon").alias("low"), F.col("surrogate").alias("new"))
    named = people.withColumn("low", F.lower("part")).join(parts_new, ["role", "low"], "left")
    part = F.struct("at", F.coalesce(capitalised(F.col("part"), F.col("new")), "part").alias("new"))
    named = named.groupBy("entity", "title").agg(F.array_join(F.array_sort(F.collect_list(part))["new"], " ").alias("whole"))
    replaced = stored(replaced.unionByName(named.select("entity", F.concat("title", "whole").alias("surrogate"))), "surrogates")

    listed = spread_join(stored(found, "found"), replaced, "entity").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "surrogate"))).alias("new"))
    joined = F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 1, F.get(F.col("new.surrogate"), ((i - 1) / 2).cast("int"))).otherwise(x)), "")
    unmarked = lambda t: F.when(F.col("escaped"), F.replace(F.replace(t, F.lit(ESCAPE + "a"), F.lit(MARK)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))).otherwise(t)
    out = lambda t, n: ["doc_id", unmarked(t).alias("text"), n.alias("n_entities"), *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)]]
    return read.join(listed, "row").select(*out(joined, F.size("new"))).unionByName(unread.select(*out(F.get("parts", F.lit(0)), F.lit(0))))


def with_repeats(parts: Column) -> Column:
    """Marked parts (every second one an entity) in which names found once are also entities where they are repeated."""

    def again(p: Column) -> Column:
        names = F.filter(p, lambda x, i: (i % 2 == 1) & x.rlike(r"^[\p{L}.'’ -]+$"))
        bare = F.array_distinct(F.transform(names, bare_name))
        family = F.filter(F.transform(bare, lambda x: F.substring_index(x, " ", -1)), lambda x: F.length(x) > 2)
        # whole names before their family names, also in capitals
        listed = F.concat(bare, F.transform(bare, F.upper), family, F.transform(family, F.upper))
        pattern = F.concat(F.lit(r"(?<![\p{L}-])(?:"), F.array_join(F.array_distinct(listed), "|"), F.lit(r")(?![\p{L}-])"))
        more = bound(pattern, lambda q: F.flatten(F.transform(p, lambda x, i: F.when(i % 2 == 1, F.array(x)).otherwise(F.split(F.regexp_replace(x, q, F.lit(f"{MARK}$0{MARK}")), MARK)))))
        return F.when(F.size(names) > 0, more).otherwise(p)

    return bound(parts, again)

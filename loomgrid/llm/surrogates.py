"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, materialize, scoped

# Forms of entities (Java patterns), titles by gender, names by gender and script.
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+'-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:ghp|gho|sk|pk)_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_-]{20,}|AIza[0-9A-Za-z_-]{35}|xox[abps]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])"
IPV4 = r"(?<![\p{N}.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\p{N})"
IPV6 = r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f]{1,4}:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
CARD = r"(?<![\p{L}\p{N}-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\p{L}\p{N}-])"
SSN = r"(?<![\p{N}-])(?<!\p{N} )(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\p{N}-])(?! \p{N})"
CALLED, DIALLED = r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\p{N})|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\p{N})", r"(?<![\p{N}.-])(?<!\p{N} )\d{3}(?:[.-]\d{3}[.-]| \d{3} )\d{4}(?![\p{N}.-])(?! \p{N})"
#: A number that begins with a trunk zero or 00 and a country code, in groups, of 9 to 15 digits.
TRUNK = r"(?<![\p{N}.-])(?<!\p{N} )(?=0(?:[ -]?\d){8,14}(?![ -]?\p{N}))0\d{1,4}(?:[ -]\d{2,4}){2,4}(?![\p{N}.-])(?! \p{N})"
PHONE = f"{CALLED}|{DIALLED}|{TRUNK}"
TITLES = {"m": "MR(?=\\.)|Mr|Herrn?|Monsieur|Señor|Sr|Signor|г-н|господин", "f": "MRS(?=\\.)|MS(?=\\.)|Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Signora|г-жа|госпожа", "n": "DR(?=\\.)|PROF(?=\\.)|Dr|Prof"}
BLANK = "[  ]{1,3}"
# A part of a name in mixed or in capital letters, with apostrophes but for a possessive s; an initial.
MIXED = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}[\p{L}-]*(?:['’](?!s(?!\p{L}))\p{L}[\p{L}-]*)*"
CAPITALS = r"(?:\p{Lu}['’])?\p{Lu}[\p{Lu}-]+(?:['’](?!S(?!\p{L}))\p{Lu}+)*(?!\p{Ll})"
INITIAL = r"\p{Lu}\."
PARTS = rf"(?:(?:{INITIAL} ){{1,3}}(?:{MIXED}|{CAPITALS})|{MIXED}(?:(?: {INITIAL}){{0,2}} {MIXED})?|{CAPITALS}(?:(?: {INITIAL}){{0,2}} {CAPITALS})?)"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(TITLES.values())})\.?{BLANK}{PARTS}"
# Names that are ordinary words in capitals too; alone they stay.
WORDS = "April August Bill Black Brown Day Faith Grace Green Hope Joy June King Long Mark May Rose White Will Young".split()
GIVEN = {
    ("m", "latin"): "Adam Arthur Bruno Daniel David Emil Felix Henry Hugo Jakob Jonas Julian Leon Louis Lucas Martin Oscar Paul Simon Thomas".split(),
    ("f", "latin"): "Alice Anna Clara Elena Emma Eva Hannah Helena Irene Julia Laura Lena Louise Maria Marta Nina Nora Olivia Rosa Sofia".split(),
    ("m", "cyrillic"): "Андрей Антон Борис Виктор Дмитрий Егор Иван Кирилл Максим Михаил Николай Олег Павел Роман Сергей Тимур".split(),
    ("f", "cyrillic"): "Алина Анна Вера Дарья Елена Ирина Ксения Лидия Мария Наталья Нина Ольга Полина Светлана Тамара Юлия".split(),
}
GIVEN |= {("n", script): GIVEN["m", script] + GIVEN["f", script] for script in ("latin", "cyrillic")}
SYLLABLES = {"latin": "ba ber da del fa fen ga ger ha hol ka ker la len ma mer na nor pa ren sa sel ta ten va vin wa wel ya zan".split(), "cyrillic": "ба бер да дел фа фен га гор ка кир ла лен ма мор на нов па рен са сел та тен ва вин за зар".split()}
#: Letters that a letter of an e-mail name or secret may become; a letter outside keeps its place as it is.
ACCENTED, CYRILLIC, GREEK = "àáâäçèéêëíîïñóôöùúûüß", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"

KINDS = [("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ip", IPV4), ("ip6", IPV6), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("name", NAME)]
#: All kinds in one pattern, in that order; what can begin an entity is looked at first, as most places of a text begin none.
PATTERN = rf"(?<![\p{{L}}\p{{N}}])(?:{EMAIL}|{SECRET}|{IBAN})|(?=\d)(?:{IPV4})|{IPV6}|(?=\d)(?:{SSN})|(?=[\d+(])(?:{CARD}|{CALLED}|{DIALLED}|{TRUNK})|(?=[{''.join(sorted({t[0] for x in TITLES.values() for t in x.split('|')}))}]){NAME}"
#: What a phone number or bank account keeps: its country code, its trunk zero.
KEPT = r"^(?:\+\d{1,3}(?=\D)|00\d{2}(?=\d{7,11}$)|0(?=\d{8,14}$)|[A-Z]{2}(?=\d{2}[ 0-9A-Z]{11,}$))"
#: Where a name found with its title stands again without it.
BARE = (r"(?<![\p{L}\p{N}])(?:", r")(?![\p{L}\p{N}])")


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(KINDS):
        out = F.when(entity.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that follow from the key, the entity and the attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|2")), 256))


def _nth(hexes: Column, i: Column, n: int) -> Column:
    """A number under n from the i-th place of the stream."""
    return F.pmod(F.conv(F.substring(hexes, F.pmod(i * 3, F.lit(120)).cast("int") + 1, 4), 16, 10).cast("int"), F.lit(n))


def _letters(char: Column, at: Column, hexes: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), _nth(hexes, at, len(alphabet)) + 1, 1)


def same_format(value: Column, hexes: Column, hexadecimal: Column | None = None) -> Column:
    """value with every digit and letter replaced by another of its kind, script and case; all else stays in place."""

    def one(c: Column, i: Column) -> Column:
        digit = F.when(c.rlike("[0-9]"), _nth(hexes, i, 10).cast("string"))
        low = _letters(c, i, hexes, LOWER)
        if hexadecimal is not None:
            low = F.when(hexadecimal, _letters(c, i, hexes, LOWER[:6])).otherwise(low)
        out = digit.when(c.rlike("[a-z]"), low).when(c.rlike("[A-Z]"), F.upper(low))
        for alphabet in (ACCENTED, CYRILLIC, GREEK):
            out = out.when(F.contains(F.lit(alphabet), c), _letters(c, i, hexes, alphabet)).when(F.contains(F.lit(alphabet.upper()), c), F.upper(_letters(c, i, hexes, alphabet.replace("ß", ""))))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(chars, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, b: a + b)


def _card(value: Column, hexes: Column) -> Column:
    """Same grouping, and a valid check digit if and only if the original has one."""
    raw = same_format(value, hexes)
    bare = lambda c: F.regexp_replace(c, "[^0-9]", "")
    wrong = F.pmod(F.lit(10) - luhn_sum(F.concat(F.left(bare(raw), F.char_length(bare(raw)) - 1), F.lit("0"))) % 10, F.lit(10))
    last = F.when(luhn_sum(bare(value)) % 10 == 0, wrong).otherwise(F.pmod(wrong + 1 + _nth(hexes, F.lit(39), 9), F.lit(10)))
    return F.concat(F.left(raw, F.char_length(raw) - 1), last.cast("string"))


def _ip(value: Column, hexes: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p, i: F.when((i == 0) & p.isin("10", "127", "192", "172"), p).otherwise((1 + _nth(hexes, i, 254)).cast("string")))
    return F.array_join(parts, ".")


def _email(value: Column, hexes: Column) -> Column:
    """A local part of the same make at a host under a reserved name; the last label's case tells the host's case."""
    host = F.concat(F.lit("m"), F.substring(hexes, 100, 6), F.lit(".example.net"))
    return F.concat(same_format(F.substring_index(value, "@", 1), hexes), F.lit("@"), F.when(F.substring_index(value, "@", -1).rlike(r"[a-z]"), host).otherwise(F.upper(host)))


def _pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(words)), " "), i + 1)


def name_part(part: Column, role: Column, hexes: Column, attempt: Column) -> Column:
    """A given name of the same gender and script (role m, f, or n after a title of either), or a family name of syllables (role s); longer if tried again."""
    cyrillic = part.rlike("\\p{IsCyrillic}")

    def made(script: str) -> Column:
        n = len(SYLLABLES[script])
        some = lambda *places: F.concat(*(_pick(SYLLABLES[script], _nth(hexes, F.lit(k), n)) for k in places))
        # two more, three more and so on, so that there are forms enough for any number of names
        more = lambda least, *places: F.when(attempt >= least, some(*places)).otherwise(F.lit(""))
        family = F.initcap(F.concat(some(1, 2, 3), more(1, 6, 7), more(2, 8, 9, 10), more(4, 11, 12, 13, 14)))
        given = lambda g, k: _pick(GIVEN[g, script], _nth(hexes, F.lit(k), len(GIVEN[g, script])))
        other = lambda g: _pick(GIVEN[g, script], F.pmod(_nth(hexes, F.lit(4), len(GIVEN[g, script])) + 1 + _nth(hexes, F.lit(5), len(GIVEN[g, script]) - 1), F.lit(len(GIVEN[g, script]))))

        def named(family: Column) -> Column:
            out = family
            for g in TITLES:
                longer = F.when(attempt > 0, F.concat(F.lit("-"), other(g), F.when(attempt > 1, F.concat(F.lit("-"), family)).otherwise(F.lit("")))).otherwise(F.lit(""))
                out = F.when(role == g, F.concat(given(g, 4), longer)).otherwise(out)
            return out

        return let(family, named)

    return F.when(cyrillic, made("cyrillic")).otherwise(made("latin"))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of one unit: an entity, or a part of a name (kinds name_m, name_f, name_n, name_s, and name_i, an initial, which needn't be distinct)."""

    def made(hexes: Column) -> Column:
        return (
            F.when(kind == "email", _email(value, hexes)).when(kind == "ip", _ip(value, hexes)).when(kind == "card", _card(value, hexes))
            .when(kind == "name_i", F.concat(F.upper(_letters(value, F.lit(7), hexes, LOWER)), F.lit(".")))
            .when(kind.startswith("name_"), name_part(value, F.right(kind, F.lit(1)), hexes, attempt))
            .otherwise(F.concat(F.regexp_extract(value, KEPT, 0), same_format(F.regexp_replace(value, KEPT, ""), hexes, (kind == "ip6") | value.rlike("^[0-9a-fA-F]{32,}$"))))
        )

    return let(stream(key, kind, value, attempt), made)


def canonical(kind: Column, entity: Column) -> Column:
    """What an entity is known by: the same for an address in any case, and for a number however its digits are grouped."""
    digits = F.regexp_replace(entity, "[^0-9A-Za-z]", "")
    code = F.regexp_extract(entity, r"^\+\d{1,3}(?=\D)", 0)
    number = F.when(code != "", F.concat(code, F.lit(" "), F.regexp_replace(F.regexp_replace(entity, r"^\+\d{1,3}", ""), "[^0-9]", ""))).otherwise(F.concat(F.regexp_extract(entity, r"^\+", 0), digits))
    return F.when(kind.isin("email", "ip6"), F.lower(entity)).when(kind.isin("card", "iban", "ssn"), digits).when(kind == "phone", number).otherwise(entity)


def as_written(kind: Column, entity: Column, made: Column) -> Column:
    """A surrogate of the canonical form, in the grouping or case that this mention has."""
    letters = "[^0-9A-Za-z]"
    bare = F.regexp_replace(made, letters, "")
    rank = lambda i: F.char_length(F.regexp_replace(F.left(entity, i + 1), letters, ""))
    grouped = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(bare, rank(i), 1)).otherwise(c)), "")
    case = lambda a, b: F.when((b != F.lower(b)) & (b == F.upper(b)), F.upper(a)).otherwise(a)
    part, host = F.substring_index(made, "@", 1), F.substring_index(made, "@", -1)
    local = F.array_join(F.zip_with(F.split(part, ""), F.split(F.substring_index(entity, "@", 1), ""), case), "")
    mail = F.concat(local, F.lit("@"), F.when(F.substring_index(entity, "@", -1).rlike("[a-z]"), host).otherwise(F.upper(host)))
    address = F.array_join(F.zip_with(F.split(made, ""), F.split(entity, ""), case), "")
    return F.when(kind.isin("card", "iban", "phone", "ssn"), grouped).when(kind == "email", F.when(entity == F.lower(entity), made).otherwise(mail)).when(kind == "ip6", address).otherwise(made)


def _title(titles: str) -> str:
    return rf"^(?:{titles})\.?{BLANK}"


ANY_TITLE = _title("|".join(TITLES.values()))


def units_of(entity: Column) -> Column:
    """The units of an entity: itself in canonical form, or the given and family part of a name with their roles."""
    unit = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))

    def names() -> Column:
        role = F.lit("name_n")
        for g in "fm":
            role = F.when(entity.rlike(_title(TITLES[g])), F.lit(f"name_{g}")).otherwise(role)
        parts = F.split(F.regexp_replace(entity, ANY_TITLE, ""), " ")
        kind = lambda p, i, n: F.when(i + 1 == n, "name_s").when(p.rlike(f"^{INITIAL}$"), "name_i").otherwise(role)
        return let(parts, lambda ps: F.transform(ps, lambda p, i: unit(kind(p, i, F.size(ps)), F.initcap(F.lower(p)))))

    return let(kind_of(entity), lambda kind: F.when(kind == "name", names()).otherwise(F.array(unit(kind, canonical(kind, entity)))))


def titled_names(found: Column, text: Column) -> Column:
    """From the entities of a text: (name, units) of every name that has a title, as a whole and its given and family part alone; longest first.

    A part alone is left out if it is one of WORDS or if the text has it as a word in small letters too.
    """
    names = F.filter(found, lambda e: e.rlike(ANY_TITLE))
    whole = F.transform(names, lambda e: F.struct(F.regexp_replace(e, ANY_TITLE, "").alias("name"), units_of(e).alias("units")))
    alone = lambda at: F.transform(whole, lambda w: F.struct(F.element_at(F.split(w["name"], " "), at).alias("name"), F.slice(w["units"], at, 1).alias("units")))
    used = lambda name: F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.lower(name), F.lit(r"(?![\p{L}\p{N}])")))
    parts = F.filter(F.array_distinct(F.concat(alone(-1), alone(1))), lambda x: ~x["name"].rlike(f"^{INITIAL}$") & ~F.initcap(F.lower(x["name"])).isin(*WORDS) & ~used(x["name"]))
    whole = F.filter(whole, lambda w: F.contains(w["name"], F.lit(" ")))
    return F.reverse(F.array_sort(F.transform(F.array_distinct(F.concat(whole, parts)), lambda x: F.struct(F.char_length(x["name"]).alias("n"), x["name"].alias("name"), x["units"].alias("units")))))


def given_roles(units: DataFrame) -> DataFrame:
    """(__id, value, role): for given names after a title of either gender the one gender that corpus-wide goes with them, if there is just one."""
    told = units.where("kind IN ('name_m', 'name_f')").select("kind", "value").distinct().groupBy("value").agg(F.max("kind").alias("role"), F.count("*").alias("n")).where("n = 1").drop("n")
    return units.where("kind = 'name_n' AND __id IS NOT NULL").select("__id", "value").distinct().join(told, "value")


@scoped
def surrogate_table(units: DataFrame, key: str, max_attempts: int = 40) -> DataFrame:
    """(kind, value, attempt, surrogate): one row per distinct unit; no two units of a kind share a surrogate, and none is a unit itself.

    All units start at attempt 0. Of those that share a surrogate the least value keeps it, the others try again, as do
    those whose surrogate is found among the units. Later rounds end as soon as no unit is left to change.
    """
    now = materialize(units.distinct().withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)))
    real = now.select(F.col("kind").alias("k"), F.col("value").alias("v"))
    for _ in range(max_attempts):
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "value"))
        met = now.withColumn("place", place).join(real, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v")), "left")
        again = (F.col("place") > 1) | F.col("v").isNotNull()
        checked = materialize(met.select("kind", "value", "attempt", "surrogate", again.alias("again")))
        if checked.where("again").isEmpty():
            return checked.drop("again")
        tried = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        now = checked.withColumn("attempt", tried).withColumn("surrogate", F.when(F.col("again"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("surrogate"))).drop("again")
    raise RuntimeError(f"surrogates still meet after {max_attempts} attempts")


@scoped
def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the entities of text_col replaced, and n_entities (long) beside it; other columns pass through.

    The same entity becomes the same surrogate in every document, different ones different surrogates: collisions are
    looked for among all distinct entities of docs. An address in another case and a number in another grouping are the same
    entity, written as the mention is. A name found with its title is also replaced where it, or its given or family part
    (see titled_names), stands without one in that text. After a title of either gender a given name has the gender that
    other titles of the corpus give it. Initials become others, not always distinct ones. A surrogate follows from the key, so rows need a lookup only for units
    that had to try again; those travel to their documents by id. A null text stays null, an empty one empty. Rows that
    repeat an id are handled by themselves. A row with a null id can't be looked up and so takes its units' first
    surrogates. A very long text is read as
    a whole. A column of docs named n_entities is replaced; an empty table gives an empty one.
    """
    docs = docs.drop("n_entities")
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    units = docs.select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(F.flatten(F.transform(found, units_of)))).alias("u")).select("__id", "u.kind", "u.value").where("kind IS NOT NULL")
    units = materialize(units.where("kind <> 'name_i'"))
    roles = materialize(given_roles(units))
    told = roles.withColumn("kind", F.lit("name_n"))
    units = units.join(told, ["__id", "kind", "value"], "left").select("__id", F.coalesce("role", "kind").alias("kind"), "value")
    table = surrogate_table(units.select("kind", "value"), key)
    moved = materialize(table.where("attempt > 0").select("kind", "value", "attempt"))
    tried = units.where("__id IS NOT NULL").join(moved, ["kind", "value"]).distinct().select("__id", F.concat_ws("|", "kind", "value").alias("k"), "attempt")
    tried = tried.unionByName(roles.select("__id", F.concat(F.lit("role|"), "value").alias("k"), (F.col("role") == "name_f").cast("int").alias("attempt")))
    tried = tried.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("__tried"))
    joined = docs.join(materialize(tried), docs[id_col] == F.col("__id"), "left").withColumn("__found", found)
    # of texts with a titled name, all mentions: the pattern then has the names themselves as well
    some_name = F.exists(F.col("__found"), lambda e: e.rlike(ANY_TITLE))
    joined = joined.withColumn("__names", F.when(some_name, titled_names(F.col("__found"), text)))
    joined = joined.withColumn("__names", F.when(F.size("__names") > 0, F.col("__names")))  # an empty alternation would match everywhere
    pattern = F.concat(F.lit(f"{PATTERN}|{BARE[0]}"), F.array_join(F.transform("__names", lambda x: x["name"]), "|"), F.lit(BARE[1]))
    joined = joined.withColumn("__pattern", F.when(F.col("__names").isNotNull(), pattern).otherwise(F.lit(PATTERN)))
    joined = joined.withColumn("__found", F.when(F.col("__names").isNotNull(), F.regexp_extract_all(text, F.col("__pattern"), F.lit(0))).otherwise(F.col("__found")))

    def spoken(entity: Column, kind: Column) -> Column:
        own = F.coalesce(F.when(kind.isNull(), F.get(F.filter("__names", lambda x: x["name"] == entity), F.lit(0))["units"]), units_of(entity))
        tried = lambda u: F.coalesce(F.try_element_at(F.col("__tried"), F.concat_ws("|", u["kind"], u["value"])), F.lit(0))
        role = lambda u: F.when(u["kind"] == "name_n", F.try_element_at(F.col("__tried"), F.concat(F.lit("role|"), u["value"])))
        own = F.transform(own, lambda u: F.struct(let(role(u), lambda f: F.when(f == 1, "name_f").when(f == 0, "name_m").otherwise(u["kind"])).alias("kind"), u["value"].alias("value")))
        made = F.transform(own, lambda u: let(tried(u), lambda n: surrogate(u["kind"], u["value"], n, key)))
        bare = F.regexp_replace(entity, ANY_TITLE, "")
        named = lambda m: F.when(F.coalesce(kind, F.lit("name")).eqNullSafe("name") & ~bare.rlike(r"\p{Ll}"), F.upper(m)).otherwise(m)
        title = F.when(kind == "name", F.regexp_extract(entity, ANY_TITLE, 0)).otherwise(F.lit(""))
        return F.concat(title, let(named(F.array_join(made, " ")), lambda m: as_written(F.coalesce(kind, F.lit("name")), entity, m)))

    new = F.array_join(F.flatten(F.zip_with(F.split(text, F.col("__pattern"), -1), F.concat(F.transform("__found", lambda e: let(kind_of(e), lambda kind: spoken(e, kind))), F.array(F.lit(""))), lambda gap, e: F.array(gap, e))), "")
    some = F.coalesce(F.size("__found"), F.lit(0)) > 0
    out = [F.when(some, new).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*out, F.when(some, F.size("__found")).otherwise(0).cast("long").alias("n_entities"))


def op4_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, key="example-key")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op4_pii_surrogates": op4_pii_surrogates}

"""Personal data replaced by surrogates, with DataFrame functions only.

1. Mentions (mail and IP addresses, phone, card, account and social security numbers, names after a title) are found by
   one pattern. A mention has a kind and a canonical form, so that one entity written in several ways stays one.
2. The distinct entities get surrogates from a keyed digest: of the same kind and format (letters stay letters of the
   same script and case, digits stay digits, valid card numbers stay valid); given names keep their gender, and given
   and family names are entities of their own, so that "Mr. Smith" and "John Smith" still agree.
3. Collision check: a surrogate that another entity has or that is itself an entity of the corpus is refused, and the
   next attempt is made for that entity only, until all are settled. Among entities that want the same surrogate the
   smallest wins.
4. Each distinct text gets the map of its mentions; texts are cut at their mentions and joined again.

Texts without mentions are not moved. Null and empty texts stay as they are. Repeated rows get equal results. Other
columns stay. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, save, table

# Titles and their gender.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Sra", "госпожа", "κυρία"),
    "u": ("Dr", "Prof"),
}
# Given names by gender and script, family names by script.
GIVEN = {
    ("m", "latin"): "Adrian Bruno Clemens Damian Edgar Fabian Gregor Henrik Ivan Jonas Konrad Lukas Marius Norman Oskar Patrick",
    ("f", "latin"): "Amelia Berta Clara Dorothea Elisa Flora Greta Helena Irene Judith Katrin Laura Marlene Nadia Olivia Paula",
    ("u", "latin"): "Alex Andrea Charlie Dominique Eden Finley Jamie Kim Morgan Noel Quinn Robin Sam Sascha Taylor Toni",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Леонид Максим Никита Павел",
    ("f", "cyrillic"): "Алина Вера Галина Дарья Елена Жанна Ирина Кира Лариса Марина Нина Полина",
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Κώστας Λευτέρης Μάνος Νίκος Πέτρος",
    ("f", "greek"): "Άννα Βάσω Γεωργία Δάφνη Ελένη Ζωή Κατερίνα Μαρία",
}
FAMILY = {
    "latin": "Ahlberg Bergmann Calder Dorsey Ellison Fairley Garland Hartwell Ingram Jarvis Kessler Lindqvist Merrick Norwood Ostrander Prescott",
    "cyrillic": "Андреев Белов Волков Громов Данилов Ершов Жуков Зимин Ильин Комаров Лебедев Морозов",
    "greek": "Αντωνίου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παπαδάκης",
}
ALPHABETS = (
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[0-9]", "0123456789"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{Ll}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
)
# Patterns of the kinds, tried in this order where a mention begins.
NAME_WORD = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)*"
PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}",
    "account": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": r"\b(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\b\.? " + NAME_WORD + "(?: " + NAME_WORD + "){0,2}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: From this attempt on, the surrogate may be longer than the lists and the format allow.
WIDE = 3
DIGEST = 128


def _kind(raw: Column) -> Column:
    out = F.lit("card")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _may_mention(text: Column) -> Column:
    """Cheap test that every text with a mention passes: a digit, an at sign or a title."""
    out = text.rlike("[0-9@]")
    for title in sorted({t for g in TITLES.values() for t in g}):
        out = out | text.contains(title)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def entities(kind: Column, raw: Column) -> Column:
    """Array of (kind, form, part): the entities a mention stands for; only names have more than one."""
    single = F.when(kind == "mail", F.lower(raw)).when(kind == "phone", F.right(_digits(raw), F.lit(10))).when(kind == "ip", raw).when(
        kind == "account", F.regexp_replace(raw, " ", "")
    ).otherwise(_digits(raw))
    title = F.regexp_extract(raw, r"^([\p{L}]+)", 1)
    gender = F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("u")
    tokens = F.slice(F.split(raw, " "), 2, 8)
    last = F.size(tokens) - 1
    named = F.transform(
        tokens,
        lambda w, i: F.struct(F.when(i == last, "family").otherwise(F.concat(F.lit("given_"), gender)).alias("kind"), w.alias("form")),
    )
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), single.alias("form"))))


def _number(digest: Column, i: Column) -> Column:
    """The i-th byte (from 0, cyclic) of a hexadecimal digest."""
    return F.conv(digest.substr((i % (DIGEST // 2)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _alike(x: Column, digest: Column) -> Column:
    """Each letter or digit of ``x`` replaced by one of its class."""

    def other(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(ALPHABETS):
            out = F.when(c.rlike(pattern), F.lit(letters).substr(_number(digest, i) % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(x), other), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    doubled = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10


def _from_list(names: str, digest: Column) -> Column:
    words = names.split(" ")
    return F.element_at(F.array(*map(F.lit, words)), F.conv(F.right(digest, F.lit(7)), 16, 10).cast("int") % len(words) + 1)


def surrogate(key: str, kind: Column, form: Column, attempt: int) -> Column:
    """The surrogate of an entity at an attempt; a pure function of key, entity and attempt."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, form, F.lit(str(attempt))), 512)
    wide = attempt >= WIDE
    alike = _alike(form, digest)
    more = F.concat(alike, _alike(F.lit("xxxxxx"), F.reverse(digest))) if wide else alike
    head = F.expr("substring(form, 1, length(form) - 1)")
    numbers = _alike(head, digest)
    check = (F.lit(10) - _luhn(F.concat(numbers, F.lit("0")))) % 10
    card = F.when(_luhn(form) == 0, F.concat(numbers, check.cast("string"))).otherwise(alike)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(digest, i) % 254 + 1).cast("string")), ".")
    local, host = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    top = F.substring_index(host, ".", -1)
    host = _alike(F.expr("substring(substring_index(form, '@', -1), 1, length(substring_index(form, '@', -1)) - length(substring_index(form, '.', -1)))"), F.reverse(digest))
    mail = F.concat(_alike(local, digest), _alike(F.lit("xxxxxx"), F.reverse(digest)) if wide else F.lit(""), F.lit("@"), host, top)
    script = _script(form)
    out = F.when(kind == "mail", mail).when(kind == "ip", ip).when(kind == "card", card)
    if wide:
        # Lists are used up: a made-up word of the script, with an ending of the gender.
        ending = F.when(kind == "given_f", "a").when(kind == "given_m", "o").otherwise("")
        ending = F.when(script == "cyrillic", F.translate(ending, "ao", "ао")).when(script == "greek", F.translate(ending, "ao", "αο")).otherwise(ending)
        return out.when(kind.startswith("given"), F.concat(more, ending)).when(kind == "family", more).otherwise(alike)
    for (gender, name), words in GIVEN.items():
        out = out.when((kind == f"given_{gender}") & (script == name), _from_list(words, digest))
    for name, words in FAMILY.items():
        out = out.when((kind == "family") & (script == name), _from_list(words, digest))
    return out.otherwise(alike)


def _space(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other."""
    return F.when(kind.startswith("given"), "given").otherwise(kind)


def settle(known: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for each distinct (kind, form): no two alike within a kind, none an entity itself."""
    real = save(known.select(_space(F.col("kind")).alias("space"), F.lower("form").alias("taken")).distinct())
    open_, done, attempt = known, None, 0
    while open_.limit(1).count():
        wanted = open_.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("form"), attempt))
        wanted = wanted.withColumns({"space": _space(F.col("kind")), "taken": F.lower("surrogate")})
        # The smallest entity of those that want the same; then none that is in use.
        first = wanted.groupBy("space", "taken").agg(F.min(F.struct("kind", "form", "surrogate")).alias("e"))
        taken = real if done is None else real.union(done.select(_space(F.col("kind")).alias("space"), F.lower("surrogate")))
        won = save(first.join(taken, ["space", "taken"], "left_anti").select("e.*"))
        done = won if done is None else save(done.union(won))
        open_ = save(open_.join(won, ["kind", "form"], "left_anti"))
        attempt += 1
    return known.withColumn("surrogate", F.lit("")) if done is None else done


def _rendered(kind: Column, raw: Column, found: Column) -> Column:
    """The mention with its entity's surrogate, in the mention's own format; ``found`` is the array of surrogates."""
    one = F.element_at(found, 1)
    symbol = "[A-Z0-9]"
    chars = _chars(raw)
    is_part = lambda c: F.when(kind == "account", c.rlike(symbol)).otherwise(c.rlike("[0-9]"))
    # Symbols are filled from the right: what the canonical form leaves out (a country code) stays.
    step = F.aggregate(
        F.reverse(chars),
        F.struct(F.lit("").alias("out"), F.length(one).alias("left")),
        lambda s, c: F.struct(
            F.concat(F.when(is_part(c) & (s["left"] > 0), one.substr(s["left"], F.lit(1))).otherwise(c), s["out"]).alias("out"),
            F.when(is_part(c), s["left"] - 1).otherwise(s["left"]).alias("left"),
        ),
    )["out"]
    title = F.substring_index(raw, " ", 1)
    mail = F.when(raw == F.upper(raw), F.upper(one)).otherwise(one)
    return F.when(kind == "name", F.concat_ws(" ", title, F.array_join(found, " "))).when(kind == "mail", mail).when(kind == "ip", one).otherwise(step)


def replace_personal_data(docs: DataFrame, key: str, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """``docs`` with the mentions in ``text`` replaced, and their number."""
    none = F.array().cast("array<string>")
    found = F.when(_may_mention(F.col(text)), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(none)
    names = ["__h1", "__h2"]
    keys = {"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(7), text)}
    marked = docs.withColumn("__found", found)
    some = marked.where(F.size("__found") > 0).withColumns(keys)
    texts = save(some.groupBy(*names).agg(F.first(F.array_distinct("__found")).alias("mentions")))
    raw = texts.select(*names, F.explode("mentions").alias("raw"))
    kinds = save(raw.select("raw").distinct().withColumn("kind", _kind(F.col("raw"))).withColumn("of", entities(F.col("kind"), F.col("raw"))))
    parts = kinds.select("raw", F.posexplode("of").alias("place", "e")).select("raw", "place", "e.kind", "e.form")
    settled = settle(save(parts.select("kind", "form").distinct()), key)
    # A mention has a handful of parts.
    put = parts.join(settled, ["kind", "form"]).groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("place", "surrogate"))).alias("put"))
    shown = kinds.join(put, "raw").select("raw", _rendered(F.col("kind"), F.col("raw"), F.col("put.surrogate")).alias("shown"))
    shown = save(shown)
    pairs = save(raw.join(shown, "raw"))
    maps = save(pairs.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("raw", "shown"))).alias("__map")))
    gaps = F.split(F.col(text), ANY, -1)
    mended = F.concat(F.array_join(F.zip_with(gaps, "__found", lambda g, m: F.concat(g, F.coalesce(F.col("__map")[m], F.lit("")))), ""))
    changed = some.join(maps, names).withColumn(text, mended).withColumn(count, F.size("__found").cast("long"))
    same = marked.where(F.size("__found") == 0).withColumn(count, F.lit(0).cast("long"))
    columns = [*docs.columns, *([count] if count not in docs.columns else [])]
    return changed.select(*columns).unionByName(same.select(*columns))


@query("op3_pii_surrogates")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return replace_personal_data(docs, key="tidemark").select("doc_id", "text", "n_replaced")

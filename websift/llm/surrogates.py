"""PII: detected entities are replaced by keyed surrogates of the same type and form.

An entity's canonical form (lower-case e-mail, digits of a phone number or card ...) and a secret key give its surrogate by
SHA-256: letters become letters, digits digits, hexadecimal digits hexadecimal digits; addresses, cards and bank accounts (with valid
check digits) and personal names (same title, gender, script and number of parts) have rules of their own. So one entity has one surrogate in the whole
corpus however it is written, and each place keeps its punctuation and case. Surrogates that two entities share, or that
are an entity themselves, are drawn again until all are distinct.

Native DataFrame operations only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.common import stored

# How entities are written, and what a name is replaced with.
_TITLE = r"(?:Mr|Mrs|Ms|Herr|Frau|Mme|Señor|Señora|Sra?|г-н|г-жа|κ|κα)\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "keyed": r"(?i:password|passwd|pwd|secret|api[_-]?key|token)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?=[^\s\"']*\d)[^\s\"']{6,}+",
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "access_key": r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex": r"[0-9a-f]{32,}+(?![0-9A-Za-z])",
    # accounts with a country's code; as many groups as follow
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z]{4})?(?: ?\d{4}){2,}(?: ?\d{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "card": r"\d{4}(?:[ -]?\d{4}){2,}[ -]?\d{1,4}(?![0-9A-Za-z])",
    # as many names as follow, with initials between them, up to another person's title
    "person": rf"{_TITLE} \p{{Lu}}[\p{{L}}'-]+(?:(?: \p{{Lu}}\.)*+ (?!{_TITLE} \p{{Lu}})\p{{Lu}}[\p{{L}}'-]+)*+",
}
ENTITY = r"(?<![0-9A-Za-z])(?:" + "|".join(PATTERNS.values()) + ")"
WOMEN = ("Mrs", "Ms", "Frau", "Mme", "Señora", "Sra", "г-жа", "κα")
GIVEN = {
    ("latin", "f"): "Alma Berta Clara Dora Edith Flora Greta Helga Ida Johanna Klara Lena Mira Nora Olga Paula".split(),
    ("latin", "m"): "Albert Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oskar Paul".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Жанна Зоя Ирина Лариса Мария Нина Ольга Полина Раиса София Тамара Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Ξένια Όλγα Σοφία".split(),
    ("greek", "m"): "Άγγελος Βασίλης Γιώργος Δημήτρης Ευάγγελος Ζήσης Ηλίας Θωμάς Ιάκωβος Κώστας Λουκάς Μιχάλης Νίκος Παύλος Σπύρος Φώτης".split(),
}
STEMS = {"latin": "bern dahl eck falk gold hart jung kern lind merk nord ost rein stern thal wald".split(),
         "cyrillic": "берез ветр горн дубр ельн жар зим игн кам лесн мор нов озер пол род снег".split(),
         "greek": "αλεξ βλαχ γαλα δαμα ευστ ζαχα θεοδ ιορδ καρα λαμπ μακρ νικο παπα ραλλ σταμ φωτι".split()}
ENDS = {("latin", "f"): "er mann berg feld stein bach hoff au".split(), ("latin", "m"): "er mann berg feld stein bach hoff au".split(),
        ("cyrillic", "f"): "ова ина ская ева".split(), ("cyrillic", "m"): "ов ин ский ев".split(),
        ("greek", "f"): "ίδου άκη οπούλου έλλη".split(), ("greek", "m"): "ίδης άκης όπουλος έλλης".split()}
ROUNDS = 64


def entity_type(value: Column) -> Column:
    """The first pattern that is the whole value."""
    out = F.lit("keyed")
    for name in reversed(list(PATTERNS)):
        out = F.when(value.rlike(rf"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _own_part() -> str:
    """What is replaced of ``value``: all, but the value alone of a keyed secret and the names without their title."""
    return r"""case kind when 'keyed' then regexp_extract(value, '[=:]\\s{0,3}["\']?([^\\s"\']+)$', 1)
               when 'person' then regexp_extract(value, '^\\S+ (.*)$', 1) else value end"""


def _canonical() -> str:
    """The form that all spellings of an entity share. Secrets are told apart by case, all else is not."""
    return r"""case when kind in ('phone', 'card', 'ssn') then regexp_replace(part, '[^0-9]', '')
               when kind in ('keyed', 'access_key', 'hex') then part
               when kind = 'iban' then replace(part, ' ', '')
               when kind = 'ip' then array_join(transform(split(part, '\\.'), x -> cast(cast(x as int) as string)), '.')
               when kind = 'person' then concat(if(gender = 'f', 'f:', 'm:'), lower(part)) else lower(part) end"""


def _derived(key: str) -> str:
    """What the plan sees of the key."""
    if not key:
        raise ValueError("surrogates need a secret key")
    return hashlib.sha256(b"surrogates\0" + key.encode()).hexdigest()


def _draw(key: str) -> tuple[str, ...]:
    """SQL of the surrogate of ``canon`` in draw ``attempt``."""
    seed = "concat_ws('\\u0001', '%s', kind, canon, attempt, '{0}')" % _derived(key)
    first = f"sha2({seed.format(0)}, 256)"
    # two hexadecimal digits for each character; further hashes are of the first one, as entities can be long
    stream = f"""concat(first, sha2({seed.format(1)}, 256), if(length(canon) <= 64, '',
        array_join(transform(sequence(2, greatest(2, (length(canon) - 1) div 32)), j -> sha2(concat(first, ':', j), 256)), '')))"""
    pairs = "transform(regexp_extract_all(stream, '..', 0), x -> cast(conv(x, 16, 10) as int))"
    number = "element_at(pairs, i + 1)"
    chars = f"""array_join(transform(split(canon, ''), (c, i) -> case
        when (kind = 'phone' and i < length(canon) - 10) or (kind = 'card' and i = 0) or (kind = 'access_key' and i < 4) or (kind = 'iban' and i < 2) then c
        when kind = 'email' and i >= length(substring_index(canon, '.', size(split(canon, '\\\\.')) - 1)) then c
        when c between '0' and '9' then cast({number} % 10 as string)
        when c between 'a' and 'z' and is_hex then substr('abcdef', {number} % 6 + 1, 1)
        when c between 'a' and 'z' then substr('abcdefghijklmnopqrstuvwxyz', {number} % 26 + 1, 1)
        when c between 'A' and 'Z' then substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {number} % 26 + 1, 1)
        else c end), '')"""
    octets = f"array_join(transform(sequence(0, 3), i -> cast({number} % 254 + 1 as string)), '.')"
    # the check digit makes the doubled and single digits from the right a multiple of ten
    luhn = """concat(substr(chars, 1, length(chars) - 1), cast((10 - aggregate(sequence(1, length(chars) - 1), 0L, (s, j) -> s + case
        when j % 2 = 1 then (2 * cast(substr(chars, -1 - j, 1) as int)) div 10 + (2 * cast(substr(chars, -1 - j, 1) as int)) % 10
        else cast(substr(chars, -1 - j, 1) as int) end) % 10) % 10 as string))"""

    # the check digits make country and account, as a number, 1 more than a multiple of 97
    iban = """concat(substr(chars, 1, 2), lpad(cast(98 - aggregate(split(concat(substr(chars, 5), substr(chars, 1, 2), '00'), ''), 0, (r, c) -> case
        when c between '0' and '9' then (r * 10 + cast(c as int)) % 97 when c between 'A' and 'Z' then (r * 100 + ascii(c) - 55) % 97 else r end) as string), 2, '0'),
        substr(chars, 5))"""

    def pick(lists: dict, at: int | str) -> str:
        n = f"cast(conv(substr(stream, {at}, 4), 16, 10) as int)"      # ``at``: a place or SQL of one
        whens = " ".join("when script = '{}' and gender = '{}' then element_at(array({}), {} % {} + 1)".format(
            s, g, ", ".join(f"'{w}'" for w in words), n, len(words)) for (s, g), words in lists.items())
        return f"case {whens} end"
    stems = {(s, g): w for s, w in STEMS.items() for g in "fm"}
    surname = f"concat(initcap({pick(stems, 5)}), {pick(ENDS, 9)})"
    # later draws have double names, then triple ones, so names do not run out
    more = "array_join(transform(sequence(0, attempt div 4), k -> case when k = 0 then surname else initcap(concat(surname, substr(translate(stream, '0123456789abcdef', "
    more += "case script when 'cyrillic' then 'аеиоуырлнмсткдвб' when 'greek' then 'αεηιοωρλνμστκδβγ' else 'aeiouyrlnmstkdvb' end), 20 + 4 * k, 4))) end), '-')"
    middle = f"""array_join(transform(slice(split(canon, ' '), 2, size(split(canon, ' ')) - 2), (p, i) ->
        if(p like '%.', concat(substr({pick(GIVEN, "(85 + 4 * i) % 124 + 1")}, 1, 1), '. '), concat({pick(GIVEN, "(85 + 4 * i) % 124 + 1")}, ' '))), '')"""
    person = f"case when canon like '% % %' then concat({pick(GIVEN, 1)}, ' ', {middle}, {more}) when canon like '% %' then concat({pick(GIVEN, 1)}, ' ', {more}) else {more} end"
    return first, stream, pairs, chars, octets, luhn, iban, surname, person


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    first, stream, pairs, chars, octets, luhn, iban, surname, person = _draw(key)
    return (entities.withColumn("first", F.expr(first)).withColumn("stream", F.expr(stream)).withColumn("pairs", F.expr(pairs))
            .withColumn("is_hex", F.expr("canon rlike '^[0-9a-f]+$'")).withColumn("chars", F.expr(chars)).withColumn("surname", F.expr(surname))
            .withColumn("surrogate", F.expr(f"case kind when 'ip' then {octets} when 'card' then {luhn} when 'iban' then {iban} when 'person' then {person} else chars end"))
            .drop("first", "stream", "pairs", "is_hex", "chars", "surname"))


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon``, ``surrogate`` of distinct entities (``kind``, ``canon``, ``gender``, ``script``): all distinct, none an entity itself.

    Of entities that draw the same surrogate the smallest keeps it; the others, and whoever drew an existing entity, draw again.
    """
    known = entities.select(F.col("kind").alias("k"), F.regexp_replace("canon", "^[fm]:", "").alias("c")).distinct()
    done, open_ = None, _drawn(entities.withColumn("attempt", F.lit(0)), key)
    for n in range(ROUNDS):
        taken = open_.withColumn("old", F.lit(False))
        if done is not None:
            taken = taken.unionByName(done.withColumn("old", F.lit(True)))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy(F.desc("old"), "canon", "gender", "script"))
        judged = (taken.withColumn("place", first)
                  .join(known, (F.col("kind") == F.col("k")) & (F.lower("surrogate") == F.lower("c")), "left"))
        judged = stored(judged.withColumn("good", (F.col("place") == 1) & F.col("c").isNull()).drop("k", "c", "place", "old"), f"surrogates-{n}")
        done = judged.where("good").drop("good")
        if judged.where("not good").isEmpty():
            return done.select("kind", "canon", "surrogate")
        open_ = _drawn(judged.where("not good").drop("good", "surrogate").withColumn("attempt", F.col("attempt") + 1), key)
    raise ValueError("the surrogates of some kind are used up")


def _written() -> str:
    """SQL of ``surrogate`` written as ``part`` is: its punctuation, its capitals."""
    digits = """array_join(transform(split(part, ''), (c, i) -> case when c between '0' and '9'
        then substr(surrogate, 1 + length(regexp_replace(substr(part, 1, i), '[^0-9]', '')), 1) else c end), '')"""
    groups = "array_join(transform(split(part, ''), (c, i) -> if(c = ' ', c, substr(surrogate, 1 + length(replace(substr(part, 1, i), ' ', '')), 1))), '')"
    capitals = "array_join(transform(split(part, ''), (c, i) -> case when c between 'A' and 'Z' then upper(substr(surrogate, i + 1, 1)) else substr(surrogate, i + 1, 1) end), '')"
    return f"""concat(substr(value, 1, length(value) - length(part)), case when kind in ('phone', 'card', 'ssn') then {digits}
        when kind = 'iban' then {groups} when kind = 'email' then {capitals} when kind = 'person' and part = upper(part) then upper(surrogate) else surrogate end)"""


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text`` with surrogates, the ``carried`` columns, and ``n_entities`` (places replaced) of every row.

    Null texts stay null with 0 entities, empty ones empty; all else of a text stays as it is. Equal rows get equal results. Columns
    not named are left out; ``carried`` may not name an output column. The entities themselves are in no output. Long texts are searched
    whole; no rows give none.

    ``key`` is a secret: who has it can draw the same surrogates. Plans and logs show only a hash derived from it, which is as good for
    drawing, so keep these too. The same key gives the same surrogates in every run over the same entities.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried)
    # the texts are searched once; what has no entity goes on from here as it is
    scanned = stored(docs.withColumn("values", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))), "surrogates-scanned")
    hits = scanned.where("size(values) > 0").withColumn("row", F.sha2("text", 256))
    rest = scanned.where("values is null or size(values) <= 0").select("doc_id", "text", *carried, F.lit(0).alias("n_entities"))
    values = hits.select(F.explode("values").alias("value")).groupBy("value").agg(F.lit(1).alias("x")).select("value")
    title = F.regexp_extract("value", r"^([^. ]+)", 1)
    letters = F.regexp_replace("value", r"^\S+ ", "")
    values = (values.withColumn("kind", entity_type(F.col("value")))
              .withColumn("gender", F.when((F.col("kind") == "person") & title.isin(*WOMEN), "f").otherwise("m"))
              .withColumn("script", F.when(F.col("kind") != "person", "latin").when(letters.rlike(r"\p{IsCyrillic}"), "cyrillic")
                          .when(letters.rlike(r"\p{IsGreek}"), "greek").otherwise("latin"))
              .withColumn("part", F.expr(_own_part())).withColumn("canon", F.expr(_canonical())))
    values = stored(values, "surrogates-values")
    drawn = draw_surrogates(values.groupBy("kind", "canon").agg(F.min("gender").alias("gender"), F.min("script").alias("script")), key)
    written = values.join(drawn, ["kind", "canon"]).select("value", F.expr(_written()).alias("new"))
    # each text with entities once, its entities by place
    places = hits.groupBy("row").agg(F.first("values").alias("values")).select("row", F.posexplode("values").alias("pos", "value"))
    found = (places.join(written, "value").groupBy("row")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("new")))
    parts = F.split("text", ENTITY, -1)
    text = F.concat(F.element_at(parts, 1), F.array_join(F.zip_with("new", F.slice(parts, 2, F.size("new")), lambda n, p: F.concat(n, p)), ""))
    changed = hits.join(found, "row").select("doc_id", text.alias("text"), *carried, F.size("new").alias("n_entities"))
    return changed.unionByName(rest).select("doc_id", "text", *carried, "n_entities")

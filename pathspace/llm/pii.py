"""Surrogates for personal data, by DataFrame functions alone.

One pattern finds e-mail and IP addresses, phone, card, bank and social-security
numbers, secrets, and names with a title; in a text with such a name, later mentions of it
or of its surname alone are found too. An entity's canonical form (lower case for e-mails,
bare digits for numbers) is drawn a surrogate by a keyed digest (SHA-256, the key is
required), and each mention takes that surrogate in its own format and case, so all
mentions of an entity, however written, get the same surrogate.

Names are drawn word by word: a surname's surrogate depends on the surname alone, a
given name's on the name and its gender, so a bare surname keeps that of the full name
also after a collision. A name's gender is that of its own title, else that which the
corpus gives the name by its titles, else that of its ending. Surrogates keep the script
(Latin, Cyrillic and Greek; names in other scripts get Latin ones), country codes, key
prefixes, and valid card numbers (Luhn).

Collision check: a surrogate that is itself an entity of the corpus, or that two
entities share, is drawn anew (the least entity keeps it) until none is left, so
distinct entities stay distinct and no surrogate is someone else's data. Where short forms
run out, surrogates get longer.

Texts are split at entities in one pass, whose result is stored with a row number. Only rows
that hold some meet the surrogates of their entities, mention by mention (a hot entity is
split by Spark's skew join), and only their rows are shuffled.

Defined results: null and empty texts stay as they are; texts and entities of any length are
taken whole; rows with equal ids or texts are all returned; all columns are kept, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

# Titles by gender.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "господин", "Господин"]
OTHER_TITLES = ["Dr", "Prof"]
_TITLE = r"(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES) + r")\.?"
_NAME = r"\p{Lu}\p{L}+(?:[ \-](?!" + _TITLE + r" )\p{Lu}\p{L}+){0,2}"

# Repeats are open-ended and possessive, so an entity of any length is found whole and without going back; a domain name has 127 labels at most (RFC 1035).
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]{1,63}\.){1,127}\p{L}{2,24}",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "secret": r"""(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-][0-9A-Za-z_\-]{16,}+)(?![0-9A-Za-z])|(?:(?<=[=:"'])|(?<=[=:] ))(?<=(?:token|secret|passwd|password|api_key|apikey) {0,2}[=:] {0,2}["']?)[^\s"']{8,}+""",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d+])(?:(?:\d{4}[ \-]){3}\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?!\d)",
    "phone": r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\d)])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d.\-])",
    "person": r"(?=[MFSHPDгГ])(?<!\p{L})" + _TITLE + " " + _NAME,
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity holds one of these (e-mails @; IPv6, values after token= and the like [=:]; IPv4 \d\.\d; keys their prefix or 32 hex digits; all other
#: numbers two digits in a row; names their title); texts without are left alone after one cheap look.
_HINT = r"@|\d\d|[=:]|\d\.\d|AKIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-]|[0-9a-f]{32}|(?<!\p{L})" + _TITLE + " "
_EDGE = "\u0001"

# Characters that stand for one another, by script; each alphabet's further members are drawn from its first part.
_ALPHABETS = [("0123456789", ""), ("aeiou", ""), ("bcdfghklmnprstvz", "jqwxy"), ("AEIOU", ""), ("BCDFGHKLMNPRSTVZ", "JQWXY"), ("àâäáãèéêëìîïíòôöóùûüúçñ", ""), ("ÀÂÄÁÃÈÉÊËÌÎÏÍÒÔÖÓÙÛÜÚÇÑ", ""), ("абвгдежзиклмнопрстуфхцчшщыэюя", ""), ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", ""), ("αβγδεζηθικλμνξοπρστυφχψω", ""), ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "")]
_HEX = [("0123456789", ""), ("abcdef", ""), ("ABCDEF", "")]
_LATIN = ["ba", "be", "da", "de", "di", "fa", "fi", "ga", "ja", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "ni", "no", "ra", "re", "ri", "ro", "sa", "si", "ta", "ti", "va", "vi"]
_CYRILLIC = ["ба", "бе", "ва", "ви", "га", "да", "де", "ди", "ка", "ко", "ла", "ле", "лу", "ма", "ме", "ми", "на", "не", "ни", "ра", "ре", "ри", "са", "си", "та", "ти", "фа", "ха", "жа", "за", "ли", "то"]
_GREEK = ["βα", "βε", "γα", "γι", "δα", "δε", "δι", "ζα", "ζη", "θα", "θε", "κα", "κο", "κι", "λα", "λε", "λι", "μα", "με", "μι", "να", "νε", "νι", "πα", "πε", "ρα", "ρι", "σα", "σι", "τα", "τε", "φα"]
#: Calling codes of one and of two digits (ITU E.164); all others have three.
_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_KEY_PREFIX = r"^(?:AKIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-])"


def kind_of(e: Column) -> Column:
    """The type of a found entity: the first pattern that it matches as a whole."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, p in PATTERNS.items():
        if kind != "secret":
            out = out.when(e.rlike(rf"^(?:{p})$"), kind)
    return out.otherwise("secret")


def _untitled(e: Column) -> Column:
    return F.regexp_replace(e, rf"^{_TITLE} ", "")


def canonical(e: Column, kind: Column) -> Column:
    """What all mentions of an entity share."""
    digits = F.regexp_replace(e, r"\D", "")
    phone = F.concat(F.regexp_extract(e, r"^\+", 0), digits)
    name = F.lower(F.regexp_replace(_untitled(e), "-", " "))
    return F.when(kind.isin("email", "ipv6"), F.lower(e)).when(kind.isin("card", "ssn"), digits).when(kind == "phone", phone).when(kind == "person", name).when(kind == "iban", F.regexp_replace(e, " ", "")).otherwise(e)


def _chars(text: Column, pattern: str = "(?s).") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# The drawing is written as SQL text: its expressions are large, and text is parsed in one step.


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_digest(key: str, n: str, *seed: str) -> str:
    """``n`` keyed bytes as pairs of hexadecimal digits, in blocks of one SHA-256 each."""
    k, message = _text(key), ", ".join(seed)
    block = f"sha2(concat_ws('\\u001f', {k}, sha2(concat_ws('\\u001f', {k}, {message}, string(b)), 256)), 256)"
    pairs = f"flatten(transform(sequence(0, greatest(int(floor(({n} - 1) / 32)), 0)), b -> regexp_extract_all({block}, '..', 0)))"
    return f"slice({pairs}, 1, greatest({n}, 0))"


def _sql_swap(text: str, pairs: str, alphabets: list[tuple[str, str]]) -> str:
    """Each letter and digit by a keyed one of its alphabet; all else stays."""
    cases = " ".join(f"when instr('{first + more}', c) > 0 then substring('{first}', int(conv(x, 16, 10)) % {len(first)} + 1, 1)" for first, more in alphabets)
    return f"array_join(zip_with(regexp_extract_all({text}, '(?s).', 0), {pairs}, (c, x) -> case {cases} else c end), '')"


def _sql_luhn(digits: str) -> str:
    """The last digit that makes the number valid, from the digits before it (i = 1 is next to the last digit, which is doubled)."""
    d = f"int(substring({digits}, length({digits}) - i, 1))"
    return f"pmod(-aggregate(sequence(1, length({digits}) - 1), 0, (t, i) -> t + if(i % 2 = 1, 2 * {d} - if({d} > 4, 9, 0), {d})), 10)"


def _draw_texts(units: DataFrame, attempt: int, key: str) -> DataFrame:
    """Column drawn: the surrogates of entities that aren't names, in canonical form. Steps are columns, so that each is worked out once."""
    k, tried = _text(key), f"'{attempt}'"
    steps = units.selectExpr("*", "if(kind = 'email', substring_index(form, '@', 1), form) as base", f"case kind when 'card' then 1 when 'iban' then 2 when 'phone' then length(regexp_extract(form, {_text(_CODE)}, 0)) when 'secret' then length(regexp_extract(form, {_text(_KEY_PREFIX)}, 0)) else 0 end as kept")
    steps = steps.selectExpr("*", f"{_sql_digest(key, 'length(base)', 'kind', 'form', tried)} as pairs", "kind in ('secret', 'ipv6') and base rlike '^[0-9a-fA-F:]+$' as hexadecimal")
    steps = steps.selectExpr("* except (pairs)", f"if(hexadecimal, {_sql_swap('base', 'pairs', _HEX)}, {_sql_swap('base', 'pairs', _ALPHABETS)}) as swapped")
    # Longer ones where collisions go on: nothing to swap, or short forms used up.
    extra = f"sha2(concat_ws('\\u001f', {k}, 'more', form, {tried}), 256)"
    letters = f"when kind in ('email', 'secret') then substring({extra}, 1, {min(attempt, 32)})" if attempt >= 3 else ""
    digits = f"when kind in ('phone', 'ssn', 'iban') then substring(translate({extra}, 'abcdef', '012345'), 1, {min(attempt - 7, 32)})" if attempt >= 8 else ""
    steps = steps.selectExpr("* except (swapped)", f"concat(substring(base, 1, kept), substring(swapped, kept + 1), case {letters} {digits} when isnull(form) then '' else '' end) as swapped")
    steps = steps.selectExpr("*", "if(kind = 'email', split(substring_index(form, '@', -1), '[.]'), array('')) as labels")
    steps = steps.selectExpr("*", "array_join(slice(labels, 1, greatest(size(labels) - 2, 0)), '.') as before", "element_at(labels, -1) as top")
    steps = steps.selectExpr("*", f"{_sql_digest(key, 'length(before)', "'domain'", "array_join(labels, '.')")} as before_pairs")
    mail = f"concat(swapped, '@', {_sql_swap('before', 'before_pairs', _ALPHABETS)}, if(before = '', '', '.'), 'example.', if(top in ('com', 'org', 'net'), top, 'com'))"
    octets = f"array_join(transform({_sql_digest(key, '4', 'kind', 'form', tried)}, x -> string(1 + int(conv(x, 16, 10)) % 254)), '.')"
    card = f"if({_sql_luhn('form')} = int(right(form, 1)), concat(left(swapped, length(swapped) - 1), {_sql_luhn('swapped')}), swapped)"
    return steps.selectExpr(*units.columns, f"case kind when 'email' then {mail} when 'ipv4' then {octets} when 'card' then {card} else swapped end as drawn")


def _draw_words(units: DataFrame, attempt: int, key: str) -> DataFrame:
    """Column drawn: the surrogates of names' words, lower case: 3 syllables (surnames 4), one more for each attempt, and an ending."""
    n = 3 + min(attempt, 24)
    by_script = lambda c, g, other: f"case script when 'c' then {c} when 'g' then {g} else {other} end"
    syllables = by_script(*("array(" + ", ".join(map(_text, x)) + ")" for x in (_CYRILLIC, _GREEK, _LATIN)))
    steps = units.selectExpr("*", r"case when form rlike '\\p{IsCyrillic}' then 'c' when form rlike '\\p{IsGreek}' then 'g' else 'l' end as script", "int(kind = 'family') as family")
    steps = steps.selectExpr("*", f"{_sql_digest(key, f'({n} + family)', 'kind', 'canon', _text(str(attempt)))} as pairs", f"{syllables} as syllables")
    ending = f"case when kind = 'family' then {by_script(*map(_text, ('ов', 'κης', 'r')))} when canon like 'f:%' then {by_script(*map(_text, ('на', 'να', 'na')))} else {by_script(*map(_text, ('н', 'νος', 'n')))} end"
    return steps.selectExpr(*units.columns, f"concat(array_join(transform(pairs, x -> get(syllables, int(conv(x, 16, 10)) % 32)), ''), {ending}) as drawn")


def _formatted(e: Column, kind: Column, drawn: Column) -> Column:
    """``drawn`` with the separators and the case of mention ``e``."""
    like = lambda c, d: F.when(F.substring(c, 1, 1).rlike(r"^\p{Lu}"), F.upper(d)).otherwise(d)
    local = F.zip_with(_chars(F.substring_index(e, "@", 1)), _chars(F.substring_index(drawn, "@", 1)), lambda c, d: F.coalesce(like(c, d), d, F.lit("")))
    mail = F.concat(F.array_join(local, ""), F.lit("@"), F.substring_index(drawn, "@", -1))
    cut = _chars(e, r"[\p{L}\p{N}][^\p{L}\p{N}]*+")
    put = F.zip_with(cut, _chars(drawn, r"[\p{L}\p{N}]"), lambda c, d: F.coalesce(F.concat(like(c, d), F.substring(c, F.lit(2), F.length(c))), d, c))
    return F.when(kind == "email", mail).when(kind == "ipv4", drawn).otherwise(F.concat(F.regexp_extract(e, r"^[^\p{L}\p{N}]*+", 0), F.array_join(put, "")))


def parts_of(text: Column) -> Column:
    """The text split at its entities: entities are at the odd places (from 0)."""
    usual = F.split(F.regexp_replace(text, PATTERN, f"{_EDGE}$0{_EDGE}"), _EDGE)
    return F.when(~text.rlike(_HINT), F.array(text)).when(F.instr(text, _EDGE) > 0, _woven(text, F.lit(PATTERN))).otherwise(usual)


def _woven(text: Column, pattern: Column) -> Column:
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    return F.filter(F.flatten(F.zip_with(between, found, lambda s, x: F.array(s, x))), lambda x: x.isNotNull())


def names_of(parts: Column) -> Column:
    """A pattern of the names that parts hold with a title, and of their surnames; null if there are none."""
    titled = F.transform(F.filter(parts, lambda s, i: (i % 2 == 1) & s.rlike(rf"^{_TITLE} {_NAME}$")), _untitled)
    # Longest first, so that a full name goes before its surname; names hold letters, spaces and hyphens only.
    both = F.flatten(F.transform(titled, lambda s: F.array(s, F.element_at(F.split(s, r"[ \-]"), -1))))
    names = F.transform(F.reverse(F.sort_array(F.transform(F.array_distinct(both), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))), lambda x: x["s"])
    found = F.array_join(names, "|")
    return F.when(found != "", F.concat(F.lit(r"(?<!\p{L})(?=\p{Lu})(?:"), found, F.lit(r")(?!\p{L})")))


def mentions_of(parts: Column, names: Column) -> Column:
    """The parts as structs (t, s), t being 0 for what isn't an entity, 1 for entities and 2 for names without title that the text has with one; odd places hold the entities."""
    plain = F.transform(parts, lambda s, i: F.struct((i % 2).cast("int").alias("t"), s.alias("s")))
    split = lambda s: F.transform(_woven(s, names), lambda x, j: F.struct(F.when(j % 2 == 1, 2).otherwise(0).alias("t"), x.alias("s")))
    more = F.flatten(F.transform(parts, lambda s, i: F.when(i % 2 == 1, F.array(F.struct(F.lit(1).alias("t"), s.alias("s")))).otherwise(split(s))))
    return F.when(names.isNull(), plain).otherwise(more)


def _words(people: DataFrame) -> DataFrame:
    """t, s, pos, word, kind, form, canon of each word of the names (t, s, canon), gender decided."""
    starts = lambda titles: F.col("s").rlike("^(?:" + "|".join(titles) + r")\.? ") & (F.col("t") == 1)
    own = people.withColumn("own", F.when(starts(FEMALE_TITLES), "f").when(starts(MALE_TITLES), "m"))
    by_name = own.groupBy("canon").agg(F.max(F.col("own") == "f").alias("f"), F.max(F.col("own") == "m").alias("m"))
    ending = F.when(F.col("canon").rlike(r"^\p{L}*[aаα](?: |$)"), "f").otherwise("m")
    f, m = F.coalesce("f", F.lit(False)), F.coalesce("m", F.lit(False))
    gender = F.coalesce("own", F.when(f & ~m, "f").when(m & ~f, "m").otherwise(ending))
    words = own.join(by_name, "canon").withColumn("gender", gender).select("t", "s", "gender", F.size(F.split(_untitled(F.col("s")), r"[ \-]")).alias("k"), F.posexplode(F.split(_untitled(F.col("s")), r"[ \-]")).alias("pos", "word"))
    low = F.lower("word")
    family = F.col("pos") == F.col("k") - 1
    # A Cyrillic surname's feminine form is its own form and an ending.
    form = F.when(family, F.regexp_replace(low, "(?<=[а-я]{2})а$", "")).otherwise(low)
    return words.select("t", "s", "pos", "word", F.when(family, "family").otherwise("given").alias("kind"), form.alias("form"), F.when(family, form).otherwise(F.concat("gender", F.lit(":"), low)).alias("canon"))


def _settle(units: DataFrame, key: str, rounds: int) -> DataFrame:
    """space, kind, canon, drawn of the distinct (space, kind, canon, form): distinct within a space, and none a form of the corpus."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = units.select("space", F.col("form").alias("drawn"))
    pending, settled = units, None
    for attempt in range(rounds):
        # A fixed number of tasks: the rows are few bytes, but each is some work.
        dealt = pending.repartition(n, "canon")
        drawn = _draw_texts(dealt.filter("space != 'name'"), attempt, key).unionByName(_draw_words(dealt.filter("space = 'name'"), attempt, key))
        drawn = stored(drawn, "pii-drawn")
        free = drawn.join(taken, ["space", "drawn"], "left_anti")
        winners = free.groupBy("space", "drawn").agg(F.min(F.struct("kind", "canon")).alias("w")).select("space", "w.*", "drawn")
        won = stored(winners, "pii-settled")
        settled = won if settled is None else settled.unionByName(won)
        taken = taken.unionByName(won.select("space", "drawn"))
        pending = drawn.join(won, ["space", "kind", "canon"], "left_anti").drop("drawn")
        if won.count() == drawn.count():
            return settled
    raise RuntimeError("no distinct surrogates were found")


def resolve(entities: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """t, s, kind, surrogate for distinct entities (t, s) as of ``mentions_of``: distinct, and none an entity itself."""
    kind = F.when(F.col("t") == 2, "person").otherwise(kind_of(F.col("s")))
    known = stored(entities.withColumn("kind", kind).withColumn("canon", canonical(F.col("s"), F.col("kind"))), "pii-entities")
    plain = known.filter("kind != 'person'")
    words = stored(_words(known.filter("kind = 'person'").drop("kind")), "pii-words")
    units = plain.select(F.col("kind").alias("space"), "kind", "canon", F.col("canon").alias("form")).unionByName(words.select(F.lit("name").alias("space"), "kind", "canon", "form")).distinct()
    settled = _settle(stored(units, "pii-units"), key, rounds).drop("space")
    texts = plain.join(settled, ["kind", "canon"]).select("t", "s", "kind", _formatted(F.col("s"), F.col("kind"), F.col("drawn")).alias("surrogate"))
    ended = F.concat("drawn", F.when((F.col("kind") == "family") & (F.lower("word") != F.col("form")), "а").otherwise(""))
    cased = F.when(F.col("word") == F.upper("word"), F.upper(ended)).otherwise(F.initcap(ended))
    named = words.join(settled, ["kind", "canon"]).groupBy("t", "s").agg(F.sort_array(F.collect_list(F.struct("pos", cased.alias("new")))).alias("w"))
    s = F.col("s")
    title = F.when(F.col("t") == 1, F.regexp_extract(s, rf"^{_TITLE} ", 0)).otherwise("")
    name = F.array_join(F.zip_with("w", _chars(_untitled(s), r"[ \-]"), lambda w, gap: F.concat(w["new"], F.coalesce(gap, F.lit("")))), "")
    people = named.select("t", "s", F.lit("person").alias("kind"), F.concat(title, name).alias("surrogate"))
    return stored(texts.unionByName(people), "pii-surrogates")


def replace_pii(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with surrogates in the text; ``count`` names a column for the number of replaced mentions."""
    cols = docs.columns
    c = {name: f"c{i}" for i, name in enumerate(cols)}
    base = docs.select(*[F.col(f"`{name}`").alias(c[name]) for name in cols])
    body = c[text]
    split = base.withColumn("parts", parts_of(F.col(body))).withColumn("parts", F.when(F.size("parts") > 1, F.col("parts")))
    split = stored(split.withColumn("rid", F.monotonically_increasing_id()), "pii-parts")
    held = split.filter("parts is not null").withColumn("names", names_of(F.col("parts"))).withColumn("parts", mentions_of(F.col("parts"), F.col("names"))).drop("names")
    odd = F.filter("parts", lambda _, i: i % 2 == 1)
    mentions = held.select("rid", F.posexplode(odd).alias("pos", "m")).select("rid", "pos", "m.*")
    mapping = resolve(mentions.select("t", "s").distinct(), key)
    table = mentions.join(mapping.drop("kind"), ["t", "s"]).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "surrogate"))).alias("to"))
    met = held.join(table, "rid")
    between = F.transform(F.filter("parts", lambda _, i: i % 2 == 0), lambda x: x["s"])
    swapped = F.array_join(F.zip_with(between, "to", lambda s, x: F.concat(s, F.coalesce(x["surrogate"], F.lit("")))), "")
    extra = lambda n: [] if count is None else [n.cast("int").alias(count)]
    out = lambda df, new, n: df.select(*[(new if name == text else F.col(c[name])).alias(name) for name in cols], *extra(n))
    return out(split.filter("parts is null"), F.col(body), F.lit(0)).unionByName(out(met, swapped, F.size("to")))

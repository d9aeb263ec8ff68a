"""PII replaced by keyed surrogates of the same kind.

Method: entities are found by regular expressions: e-mail addresses, phone numbers,
IPv4 and IPv6 addresses, payment cards that pass the Luhn check, social security
numbers, IBANs, tokens of 32 to 64 hex digits, access keys with a known prefix, values
after ``password=`` and the like, and names after a form of address. Each distinct
entity is one row and gets a surrogate drawn from SHA-2 of key, kind, entity and
attempt: digits become digits, letters letters of the same case and script; names are
built of syllables by script with an ending by gender; cards pass the Luhn check and
IBANs the check of their digits; a phone number keeps what precedes its last ten
digits. Names are as long as the number of names of their kind asks for, so that few
collide. Surrogates that two entities of a kind share, or that equal an entity of the
corpus, are drawn again, names a syllable longer and addresses longer after the third
attempt, until none is left; so distinct entities stay distinct.

Coreference: one entity has one surrogate in all documents, however it is punctuated
or capitalised. In a document with a name after a form of address, its parts are
replaced wherever they stand with a capital, alone or with other titles. A part that
is called given and family name, or man and woman, by one document is one entity there
(family name before given, man before woman before unknown). Initials become other
initials, without distinctness.

DataFrame functions only. Documents without an entity pass through a filter and a
projection; the others are written once with their matches, and joined, by the hash
(128 bits) of their text, with the surrogates of their entities. Entities are made
distinct per text before any shuffle of them.

Not found: names without any form of address in their document, names in small
letters, postal addresses, dates of birth.

Edge cases: null texts stay null, empty ones empty; digits that fail the Luhn check
and octets over 255 stay; repeated rows stay repeated; an empty table gives no rows;
all columns of the input are returned as they were, besides the text; long texts are
treated whole. The key is the caller's secret and has no default. Kinds with a fixed
form (social security and card numbers, IPv4) must not fill more than half of what
their form allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import discard, materialize, table

#: Forms of address by gender (n: either), fixed values.
TITLES = {
    "m": ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "госпожа", "κυρία"],
    "n": ["Dr", "Prof", "Professor"],
}
#: First, middle and last syllables of names by script (family) or script and gender, fixed values.
HEADS = {"latin": "Al Bel Cor Dan Els Fer Gal Hen Ist Jor Lan Mar Nor Or Per Ros", "cyrillic": "Ал Бор Вал Гор Дан Ел Зар Кар Лав Мар Нов Ол Пал Рос Сал Тар", "greek": "Αλ Βαρ Γαλ Δαμ Ελ Καρ Λαμ Μαν Νικ Παν Σαρ Φαν"}
MIDDLES = {"latin": "ba de fi go la me ni ro sa te vi wo", "cyrillic": "ба ве го ди ла ме ни ро са то", "greek": "βα γε δι κο λα με νι ρο"}
ENDS = {
    "given_m_latin": "o us in er ek an", "given_f_latin": "a ina elle ia eth isa", "given_n_latin": "e y is ey en il",
    "given_m_cyrillic": "ий он ей ан им", "given_f_cyrillic": "а ина ия ана ея", "given_n_cyrillic": "ен ис ой",
    "given_m_greek": "ος ης ας ων", "given_f_greek": "α η ια ινη", "given_n_greek": "ις ω",
    "family_latin": "bert den field ler man nell ridge ston ton ven wick worth", "family_cyrillic": "ко нюк ленко ренко шук дзе", "family_greek": "κης λάκης νίδης πουλος",
}
#: Letters of surrogates by script, fixed values; all of one case and length per row.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àâäçèéêëîïñôöùûü", "ÀÂÄÇÈÉÊËÎÏÑÔÖÙÛÜ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
#: Kinds whose entities differ only by capitals from themselves.
FOLDED = ("email", "secret", "ipv6")
#: Room of a name kind per name of it.
ROOM = 32

_EVERY_TITLE = "|".join(t for ts in TITLES.values() for t in sorted(ts, key=len, reverse=True))
_TITLE_STARTS = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
_WORD = r"\p{Lu}\p{L}{1,40}(?:[\x27’-]\p{Lu}\p{L}{1,40}){0,3}"
_PART = rf"(?:[A-Z]\.(?!\p{{L}})|{_WORD}|[OD][\x27’]\p{{Lu}}\p{{L}}{{1,40}})"
_TITLE = rf"(?=[{_TITLE_STARTS}])(?<![\p{{L}}])(?:{_EVERY_TITLE})\.? "
#: Patterns by kind, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}][\p{L}\p{N}._+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "credential": r"(?<![\p{L}])(?i:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?[^\s,;.\x22\x27]{6,64}",
    "token": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|rk)[-_](?:live|test)[-_][A-Za-z0-9]{16,64}|gh[opsu]_[A-Za-z0-9]{36,64}|xox[abp]-[A-Za-z0-9-]{10,64})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![A-Za-z0-9:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})(?![A-Za-z0-9:])",
    "phone": r"(?<![\p{N}])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])|(?<![\p{N}])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![\p{N}.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9]|[.-][0-9])",
    "ssn": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "name": rf"{_TITLE}{_PART}(?: {_PART}){{0,3}}",
}
ANY = "|".join(PATTERNS.values())
#: Also every word with a capital, for documents with a name.
ANY_OR_WORD = ANY + rf"|(?<![\p{{L}}\p{{N}}]){_WORD}"
HAS_TITLE = rf"{_TITLE}\p{{Lu}}"
#: Cheap tests, one of which every text with an entity passes, besides HAS_TITLE; each
#: tries only places of few characters.
HINTS = (r"[0-9@=]", r"[:_-](?<=(?i:password|passwd|pwd|secret|token|api[_-]?key) ?:|gh[opsu]_|xox[abp]-|[spr]k[_-])", r"A[KS]IA")


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words: str) -> str:
    return "array(" + ", ".join(map(_lit, words.split())) + ")"


def _luhn(digits: str, shift: int) -> str:
    """SQL: Luhn sum of a digit string, its last digit in position ``shift`` from the right."""
    d = f"cast(substring({digits}, length({digits}) - i + 1, 1) as int)"
    return f"aggregate(transform(sequence(1, length({digits})), i -> case when (i + {shift}) % 2 = 1 then {d} when {d} > 4 then 2 * {d} - 9 else 2 * {d} end), 0, (a, x) -> a + x)"


def _kind(m: str) -> str:
    """SQL: the kind of a match, null for what only looks like an entity."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    true = {"ip": f"forall(split({m}, '[.]'), o -> cast(o as int) <= 255)", "card": f"{_luhn(digits, 0)} % 10 = 0"}
    cases = (f"when {m} rlike {_lit('^(?:' + p + ')$')} then " + (f"(case when {true[k]} then '{k}' end)" if k in true else f"'{k}'") for k, p in PATTERNS.items())
    return f"case {' '.join(cases)} else 'word' end"


def _name_parts(m: str) -> str:
    """SQL: the words of a match after its form of address."""
    return f"slice(split({m}, ' '), 2, 9)"


def _entities(found: str) -> str:
    """SQL: (at, unit, rank) of a match: its key in its document, kind:body, and which unit wins for a key."""
    m, kind = f"{found}.m", f"{found}.kind"
    gender = f"(case when {m} rlike {_lit('^(?:' + '|'.join(TITLES['m']) + ')[. ]')} then 'm' when {m} rlike {_lit('^(?:' + '|'.join(TITLES['f']) + ')[. ]')} then 'f' else 'n' end)"
    script = f"(case when w rlike {_lit('[а-яА-ЯёЁ]')} then 'cyrillic' when w rlike {_lit('[α-ωΑ-Ωά-ώ]')} then 'greek' else 'latin' end)"
    part = f"concat(case when i < size({_name_parts(m)}) - 1 then concat('given_', {gender}, '_') else 'family_' end, {script}, ':', lower(w))"
    names = f"filter(transform({_name_parts(m)}, (w, i) -> named_struct('at', concat('name:', lower(w)), 'unit', {part}, 'rank', case when i < size({_name_parts(m)}) - 1 then concat('2', translate({gender}, 'mfn', '012')) else '1' end)), x -> not x.at rlike {_lit('^name:[a-z][.]$')})"
    plain = f"concat({kind}, ':', {_body(m, kind)})"
    none = "cast(array() as array<struct<at: string, unit: string, rank: string>>)"
    return f"case when {kind} is null or {kind} = 'word' then {none} when {kind} = 'name' then {names} else array(named_struct('at', {plain}, 'unit', {plain}, 'rank', '0')) end"


def _body(m: str, kind: str) -> str:
    """SQL: the canonical form of a match that is no name."""
    folded = ", ".join(f"'{k}'" for k in FOLDED)
    return (
        f"case when {kind} in ({folded}) then lower({m}) when {kind} in ('ip', 'token') then {m} when {kind} = 'credential' then regexp_extract({m}, '[=:] ?(.*)$', 1) "
        f"when {kind} = 'iban' then replace({m}, ' ', '') when {kind} = 'phone' then right(regexp_replace({m}, '[^0-9]', ''), 10) else regexp_replace({m}, '[^0-9]', '') end"
    )


def _drawn(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (kind, body, attempt, size) with a column ``value``: the surrogate drawn at the attempt."""
    values = ", ".join(f"({_lit(k)}, {_list(HEADS[k.rsplit('_', 1)[1]])}, {_list(MIDDLES[k.rsplit('_', 1)[1]])}, {_list(e)})" for k, e in ENDS.items())
    syllables = rows.sparkSession.sql(f"select * from values {values} as t(kind, heads, middles, ends)")  # a row per kind
    seed = F.concat_ws("|", F.lit(key), "kind", "body", F.col("attempt").cast("string"))
    df = rows.join(F.broadcast(syllables), "kind", "left").withColumn("h", F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 512) for i in range(2)]))

    def number(i: str) -> str:
        """The i-th number that the hash gives."""
        return f"cast(conv(substring(h, 1 + 7 * ({i}) % 240, 7), 16, 10) as bigint)"

    def pick(words: str, i: str) -> str:
        return f"element_at({words}, cast(1 + {number(i)} % size({words}) as int))"

    def poured(text: str, low: str = "1") -> str:
        """Letters and digits from place ``low`` on, others of their kind for each."""
        c = f"substring({text}, i, 1)"
        each = "case " + " ".join(f"when instr('{a}', {c}) > 0 then substring('{a}', cast(1 + {number('i')} % {len(a)} as int), 1)" for a in ALPHABETS) + f" else {c} end"
        return f"array_join(transform(case when length({text}) >= {low} then sequence({low}, length({text})) else array() end, i -> {each}), '')"

    name = f"concat({pick('heads', '0')}, array_join(transform(case when size > 0 then sequence(1, size) else array() end, i -> {pick('middles', 'i + 1')}), ''), {pick('ends', '1')})"
    # short addresses, and letters without an alphabet, have few shapes: later ones grow
    longer = f"array_join(transform(case when attempt > 3 then sequence(4, attempt) else array() end, i -> substring('{ALPHABETS[0]}', cast(1 + {number('i + 20')} % 26 as int), 1)), '')"
    user = "substring_index(body, '@', 1)"
    shapes = {
        "email": f"concat({longer}, {poured(user)}, '@', {poured('substring(body, instr(body, chr(64)) + 1, length(body) - instr(body, chr(64)) - length(substring_index(body, chr(46), -1)) - 1)')}, '.', substring_index(body, '.', -1))",
        "secret": f"array_join(transform(sequence(1, length(body)), i -> lower(hex({number('i')} % 16))), '')",
        "ipv6": f"array_join(transform(sequence(1, length(body)), i -> case when substring(body, i, 1) = ':' then ':' else lower(hex(1 + {number('i')} % 15)) end), '')",
        "ip": f"array_join(transform(sequence(1, 4), i -> cast(1 + {number('i')} % 254 as string)), '.')",
        "phone": f"concat(cast(2 + {number('1')} % 8 as string), array_join(transform(sequence(2, length(body)), i -> cast({number('i')} % 10 as string)), ''))",
        "card": f"concat(substring(body, 1, 1), array_join(transform(sequence(2, length(body) - 1), i -> cast({number('i')} % 10 as string)), ''))",
        "iban": poured("body", "5"),
        "token": f"concat(regexp_extract(body, '^(AKIA|ASIA|.*[-_])', 1), {poured('regexp_replace(body, {0}, {1})'.format(_lit('^(AKIA|ASIA|.*[-_])'), _lit('')))})",
    }
    shaped = "case " + " ".join(f"when kind = '{k}' then {v}" for k, v in shapes.items()) + f" when heads is not null then {name} else {poured('body')} end"
    df = df.withColumn("value", F.expr(shaped))
    # the letters of an IBAN count as 10 to 35; the check digits make the whole 1 modulo 97
    digits = "concat(value, substring(body, 1, 2), '00')"
    rest = f"aggregate(sequence(1, length({digits})), 0, (a, i) -> (case when substring({digits}, i, 1) rlike '[0-9]' then a * 10 + cast(substring({digits}, i, 1) as int) else a * 100 + ascii(substring({digits}, i, 1)) - 55 end) % 97)"
    checked = f"case when kind = 'card' then concat(value, cast((10 - {_luhn('value', 1)} % 10) % 10 as string)) when kind = 'iban' then concat(substring(body, 1, 2), lpad(cast(98 - {rest} as string), 2, '0'), value) else value end"
    return df.withColumn("value", F.expr(checked)).drop("h", "heads", "middles", "ends")


def _first_size(units: DataFrame) -> Column:
    """Middle syllables of names of a kind: enough for ``ROOM`` names per name of it."""
    counts = {r["kind"]: r["count"] for r in units.groupBy(F.substring_index("unit", ":", 1).alias("kind")).count().collect()}  # a row per kind
    sizes = []
    for kind, ends in ENDS.items():
        script = kind.rsplit("_", 1)[1]
        room, size = len(HEADS[script].split()) * len(ends.split()), 0
        while room < ROOM * counts.get(kind, 0):
            room, size = room * len(MIDDLES[script].split()), size + 1
        sizes += [F.lit(kind), F.lit(size)]
    return F.coalesce(F.create_map(*sizes)[F.col("kind")], F.lit(0))


def surrogates(units: DataFrame, key: str, max_attempts: int = 60) -> DataFrame:
    """(unit, surrogate) for distinct units; no surrogate twice in a kind, none a unit."""
    real = units.select(F.lower("unit").alias("taken")).distinct()
    base = units.select("unit", F.substring_index("unit", ":", 1).alias("kind"), F.expr("substring(unit, instr(unit, ':') + 1)").alias("body"))
    now = materialize(_drawn(base.select("*", F.lit(0).alias("attempt"), _first_size(units).alias("size")), key))
    settled: DataFrame | None = None
    for _ in range(max_attempts):
        at = now.withColumn("at", F.concat("kind", F.lit(":"), F.lower("value")))
        # names have room, so a value has few rows; the smallest unit keeps it
        first = at.groupBy("at").agg(F.min("unit").alias("first"))
        bad = real if settled is None else real.unionByName(settled.select(F.concat("kind", F.lit(":"), F.lower("value")).alias("taken")))
        judged = at.join(first, "at").join(bad, F.col("at") == F.col("taken"), "left")
        good = judged.where("unit = first and taken is null").select("unit", "kind", "value").distinct()
        good = materialize(good)
        settled = good if settled is None else settled.unionByName(good)
        again = now.join(good.select("unit"), "unit", "left_anti").select("unit", "kind", "body", (F.col("attempt") + 1).alias("attempt"), (F.col("size") + 1).alias("size"))
        later = materialize(_drawn(again, key))
        discard(now)
        now = later
        if not now.limit(1).count():
            return settled.select("unit", F.col("value").alias("surrogate"))
    raise RuntimeError("surrogates still collide: too many entities of one form")


def _rendered(found: str) -> str:
    """SQL: a match rewritten with the map ``subs`` of its document."""
    m, kind = f"{found}.m", f"{found}.kind"
    sur = f"element_at(subs, concat({kind}, ':', {_body(m, kind)}))"
    # digits and letters of the surrogate are poured into the punctuation of the match, from the right
    solid = f"regexp_replace({m}, '[^A-Z0-9]', '')"
    whole = f"concat(left({solid}, greatest(length({solid}) - length({sur}), 0)), {sur})"
    poured = f"aggregate(sequence(1, length({m})), named_struct('t', '', 'at', 1), (a, i) -> case when substring({m}, i, 1) rlike '[A-Z0-9]' then named_struct('t', concat(a.t, substring({whole}, a.at, 1)), 'at', a.at + 1) else named_struct('t', concat(a.t, substring({m}, i, 1)), 'at', a.at) end, a -> a.t)"
    cased = lambda was, new: f"case when length({was}) > 1 and {was} = upper({was}) and {was} <> lower({was}) then upper({new}) else {new} end"
    initial = "concat(substring('ABCDEFGHJKLMNPRSTVW', cast(1 + conv(substring(sha2(concat(pii_key, '|initial|', w), 256), 1, 6), 16, 10) % 19 as int), 1), '.')"
    named = "coalesce(element_at(subs, concat('name:', lower(w))), w)"
    name = f"concat_ws(' ', substring_index({m}, ' ', 1), array_join(transform({_name_parts(m)}, w -> case when w rlike '^[A-Z][.]$' then {initial} else {cased('w', named)} end), ' '))"
    word = f"element_at(subs, concat('name:', lower({m})))"
    return (
        f"case when {kind} is null then {m} when {kind} = 'word' then coalesce({cased(m, word)}, {m}) when {kind} = 'name' then {name} when {sur} is null then {m} when {kind} in ('email', 'secret') then {cased(m, sur)} "
        f"when {kind} in ('ip', 'ipv6', 'token') then {sur} when {kind} = 'credential' then concat(regexp_extract({m}, '^([^=:]*[=:] ?)', 1), {sur}) else {poured} end"
    )


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, entities of the text column replaced."""
    row = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    titled = F.col("text").rlike(HAS_TITLE)
    likely = titled
    for hint in reversed(HINTS):
        likely = F.col("text").rlike(hint) | likely
    likely = F.coalesce(likely, F.lit(False))
    has = F.coalesce(likely & F.col("text").rlike(ANY), F.lit(False))
    pattern = f"case when text rlike {_lit(HAS_TITLE)} then {_lit(ANY_OR_WORD)} else {_lit(ANY)} end"
    matches = F.expr(f"transform(regexp_extract_all(text, {pattern}, 0), x -> named_struct('m', x, 'kind', {_kind('x')}))")
    # documents with an entity, once, with what was found in them
    held = materialize(row.where(has).select("row", "text", F.md5("text").alias("h"), matches.alias("found")))
    per_text = held.select("h", F.explode(F.array_distinct("found")).alias("one")).distinct()
    named = per_text.select("h", F.explode(F.expr(_entities("one"))).alias("e")).groupBy("h", F.col("e.at").alias("at")).agg(F.min(F.struct("e.rank", "e.unit")).alias("low"))
    units = materialize(named.select("h", "at", F.col("low.unit").alias("unit")))
    subs = units.join(surrogates(units.select("unit").distinct(), key), "unit").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias("subs"))
    full = held.join(subs, "h", "left").withColumn("pii_key", F.lit(key))
    full = full.withColumn("parts", F.expr(f"split(text, {pattern}, -1)")).withColumn("rendered", F.expr(f"transform(found, one -> {_rendered('one')})"))
    new = F.when(F.col("subs").isNull(), F.col("text")).otherwise(F.concat_ws("", F.expr("zip_with(parts, rendered, (p, r) -> concat(p, coalesce(r, '')))")))
    full = full.withColumn("new", new)
    keep = [F.col(f"row.`{c}`").alias(c) if c != text_col else F.col("new").alias(c) for c in docs.columns]
    n = F.expr("size(filter(found, one -> one.kind <> 'word'))").cast("long")
    plain = row.where(~has).withColumn("new", F.col("text"))
    return full.select(*keep, *([n.alias(count_col)] if count_col else [])).union(plain.select(*keep, *([F.lit(0).cast("long").alias(count_col)] if count_col else [])))


def session_key(spark: SparkSession) -> str:
    """The key of the registered queries: ``spark.spanforge.pii.key``, or one that is no secret."""
    return spark.conf.get("spark.spanforge.pii.key", "not a secret")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark), count_col="n_entities")

"""PII surrogates: detected entities get keyed replacements of their own type, gender, script and format.

Everything runs on DataFrame functions. A text is cut at its entities by one pattern. An entity has one or two parts in
a canonical form (a phone's digits with its country, an address's name and domain in lower case, a surname and a given
name), so that mentions in different spellings share them: one number in several formats, an address in two cases, a
person by full name and by surname, whose gender a text's titles tell also where a mention has none. Each part is replaced by a pure function of the key, its type, itself and an attempt
number, and written back in the format of the mention; so mentions of one entity stay mentions of one (other) entity in
every document, and no text is shuffled. Distinctness is checked on the table of different parts: where two of them would
get the same surrogate, or a surrogate is itself a part of the data, all but the first try again with the next attempt
until none clash. Such second attempts are rare; they reach the documents as a map while they are few, and by a join
beyond that.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Overrides that may be sent along as a map, and attempts before giving up.
MAPPED, ATTEMPTS = 2000, 40

# The patterns of entities. Each begins with what its first character must be, which settles most places of
# a text at once, and then where the character before can't be part of it, so that a long run is read once.
_NAME = r"\p{Lu}(?:\p{L}{1,40}(?:['’\-]\p{L}{2,40}){0,3}|['’]\p{L}{2,40}(?:['’\-]\p{L}{2,40}){0,2})"
_TITLES_F = r"Mrs|MRS|mrs(?=\.)|Ms|MS|ms(?=\.)|Miss|MISS|Frau|FRAU|Madame|MADAME|Mme|Mlle|Señora|SEÑORA|Sra|Doña|Signora|SIGNORA|[Гг]оспожа"
_TITLES_M = r"Mr|MR|mr(?=\.)|Herrn?|HERR|Monsieur|MONSIEUR|Señor|SEÑOR|Sr|Don|Signor|SIGNOR|[Гг]осподин"
_TITLES_N = r"Dr|DR|dr(?=\.)|Prof|PROF|prof(?=\.)|Professor|PROFESSOR|Professorin|Doctor|DOCTOR|Dra(?=\.)"
_TITLES = f"{_TITLES_F}|{_TITLES_M}|{_TITLES_N}"
# White space inside a name, a line's end included; and words that begin a sentence and aren't a surname after a line's end.
_GAP = r"(?:[ \t\u00A0]{1,3}|[ \t]?\r?\n[ \t]?)"
_BEGINNINGS = "The|This|That|These|He|She|It|We|You|They|In|On|At|And|But|If|When|Please|Yours|Best|Der|Die|Das|Er|Sie|Wir|Und|Le|La|Les|El|Los|Il"
_CUES = "Name:|name:|name is|Contact:|Dear"
_NOBODY = "Sirs?|Madam|Readers?|Friends?|Customers?|Colleagues?|Editors?|Team|All|Us|Sales|Support"
_APART = r"(?<![\p{L}\p{N}])"
# A secret's value runs to its end, however long: full stops and = inside it belong to it, = also at its end.
_VALUE = r"[A-Za-z0-9_\-+/~]"
_SECRETS = r"[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd|PWD|[Pp]assphrase|PASSPHRASE|[Pp]asscode|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_\-]?[Kk]ey|API_KEY|[Aa]ccess[_\-]?[Kk]ey|[Aa]ccessToken|[Cc]lientSecret"
_SCHEMES = "(?:[Bb]earer|BEARER|[Bb]asic|[Tt]oken)"
PATTERNS = {
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": rf"(?<![\p{{L}}\p{{N}}.\-+/=_])[2-9]\d{{2}}[2-9]\d{{6}}(?![\p{{L}}\p{{N}}\-]|\.\d)|{_APART}\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d{{2,4}}(?:[ .\-]\d{{2,8}}){{1,4}}(?!\d)|{_APART}\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<![\p{{L}}\p{{N}}\-])\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}(?![\d\-])|{_APART}\+\d{{8,15}}(?!\d)",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": rf"{_APART}\d{{4}}(?:[ \-]?\d{{4}}){{2}}[ \-]?\d{{1,7}}(?!\d)",
    "access": rf"{_APART}(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])",
    "iban": rf"{_APART}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}])",
    "secret": rf"{_APART}(?:(?:{_SECRETS})\s{{0,2}}[=:]\s{{0,2}}[\"']?|(?:[Aa]uthorization|AUTHORIZATION)\s{{0,2}}[=:]\s{{0,2}}[\"']?{_SCHEMES}\s{{1,2}}){_VALUE}(?:{_VALUE}|[.=]++(?={_VALUE})){{5,}}+=*+",
    "name": rf"{_APART}(?:(?:(?:{_CUES}){_GAP})?(?:{_TITLES})\.?{_GAP}(?:(?:{_TITLES_N})\.?{_GAP})*|(?:{_CUES})(?!{_GAP}(?:{_NOBODY})\b){_GAP})(?!(?:{_TITLES_N})(?!\p{{L}})){_NAME}(?:{_GAP}(?<!\n[ \t]?(?={_APART}(?:{_BEGINNINGS})(?!\p{{L}}))){_NAME})?",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}\-]{1,63}+(?:\.[\p{L}\p{N}\-]{1,63}+){1,8}",
}
_of = lambda *names: "(?:" + "|".join(PATTERNS[n] for n in names) + ")"
#: Entities of a text without an @; and with one. An address comes first, as it may hold any of the others.
NO_AT = f"(?=[0-9+(]){_of('ssn', 'phone', 'ip', 'card')}|(?=[A-Z]){_of('access', 'iban')}|(?=[pPsStTaAcC]){_of('secret')}|(?=[CDFHMNPSdmnpгГ]){_of('name')}"
ANY = f"{PATTERNS['email']}|{NO_AT}"
# Syllables that names are made of, by script, and their endings by gender.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga go ka ke ko la le lo ma me mi na ne no pa pe ra re ri ro sa se so ta te to va ve vi".split(),
    "cyrillic": "ба бе бо да де до га го ка ко ла ле ло ма ме ми на не но па пе ра ре ри ро са се со та те то ва ве ви".split(),
}
# How long the country codes of phone numbers are, by their first digits.
_COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Names and domains up to this length are lengthened: they leave too few others.
_SHORT = 8
_ENDS = {("latin", "f"): ["lia", "na", "ra", "sa"], ("latin", "m"): ["ton", "rik", "mus", "do"], ("cyrillic", "f"): ["лия", "на", "ра", "са"], ("cyrillic", "m"): ["тон", "рик", "мир", "слав"]}


def entity_type(e: Column) -> Column:
    """The type of an entity that the pattern has found."""
    rules = [("email", e.contains("@")), ("name", e.rlike(rf"^(?:{_CUES})\s")), ("secret", e.rlike("^[A-Za-z_-]+\\s*[=:]")), ("access", e.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$")), ("iban", e.rlike(r"^[A-Z]{2}\d{2}"))]
    rules += [(k, e.rlike(f"^(?:{PATTERNS[k]})$")) for k in ("ssn", "phone", "ip", "card")]
    return reduce(lambda out, r: F.when(r[1], r[0]).otherwise(out), reversed(rules), F.lit("name"))


def _digest(key: str, kind: Column, e: Column, attempt: Column) -> Column:
    """128 hex digits that follow from the key, the type, the entity and the attempt."""
    return F.sha2(F.concat_ws("\0", F.lit(key), kind, attempt.cast("string"), e), 512)


def _number(hexed: Column, at: Column, width: int = 4) -> Column:
    """A number from four digits of a digest at a place; places beyond its end go round with another offset."""
    return F.conv(F.substring(F.concat(hexed, hexed), (F.pmod(at * 3 + (at / 40).cast("int") * 7, F.lit(124)) + 1).cast("int"), F.lit(width)), 16, 10).cast("int")


def _spelt(e: Column, hexed: Column, hexy: Column) -> Column:
    """Each digit becomes a digit, each letter a letter of its case and script; what is hexadecimal stays so; marks stay.

    ``hexy`` is evaluated for each character, so it must not depend on the length of the entity."""
    # The letters of each case and script.
    sets = [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"), (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"), (r"\p{N}", "0123456789")]

    def one(c: Column, i: Column) -> Column:
        letters = reduce(lambda out, s: F.when(c.rlike(s[0]), s[1]).otherwise(out), reversed(sets), F.lit(""))
        letters = F.when(hexy, "0123456789abcdef").otherwise(letters)
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(letters, _number(hexed, i) % F.length(letters) + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(e, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted single."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, b: a + b
    )


def _words_of_name(e: Column) -> Column:
    """The one or two words of a name after its titles or cue."""
    return F.regexp_extract(e, rf"(?s)^(?:(?:{_CUES}){_GAP})?(?:(?:{_TITLES})\.?{_GAP}(?:(?:{_TITLES_N})\.?{_GAP})*)?(.*)$", 1)


def _gender(e: Column) -> Column:
    """f or m by a name's title, else -."""
    has = lambda titles: e.rlike(rf"^(?:(?:{_CUES}){_GAP})?(?:{titles})\.?\s")
    return F.when(has(_TITLES_F), "f").when(has(_TITLES_M), "m").otherwise("-")


def _plain_words(e: Column) -> Column:
    """The words of a name in lower case, apostrophes of one kind."""
    return F.split(F.replace(F.lower(_words_of_name(e)), F.lit("’"), F.lit("'")), r"\s+")


def told_apart(found: Column) -> Column:
    """Entities of a text as structs of e, kind and g. The gender g of a name without a title that tells it is that of the
    text's names with the same surname, and no other given name, if those with a gender agree."""
    kinds = F.transform(found, lambda e: F.struct(e.alias("e"), entity_type(e).alias("kind")))
    name = lambda x: F.when(x.kind == "name", _plain_words(x.e))
    words = F.transform(kinds, lambda x: F.struct(x.e.alias("e"), x.kind.alias("kind"), F.when(x.kind == "name", _gender(x.e)).otherwise("-").alias("g"), name(x).alias("w")))

    def settled(xs: Column, titled: Column) -> Column:
        def gender(x: Column) -> Column:
            same = F.filter(titled, lambda y: (F.element_at(y.w, -1) == F.element_at(x.w, -1)) & ((F.size(y.w) == 1) | (F.size(x.w) == 1) | (y.w[0] == x.w[0])))
            genders = F.array_distinct(F.transform(same, lambda y: y.g))
            return F.when((x.kind == "name") & (x.g == "-") & (F.size(genders) == 1), F.get(genders, F.lit(0))).otherwise(x.g)

        return F.transform(xs, lambda x: F.struct(x.e.alias("e"), x.kind.alias("kind"), gender(x).alias("g")))

    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    titled = lambda xs: F.array_distinct(F.transform(F.filter(xs, lambda x: (x.kind == "name") & (x.g != "-")), lambda x: F.struct(x.w.alias("w"), x.g.alias("g"))))
    return once(words, lambda xs: once(titled(xs), lambda ts: settled(xs, ts)))


def parts_of(e: Column, kind: Column, gender: Column) -> Column:
    """The parts of an entity as an array of structs of their type and canonical form."""
    part = lambda k, c: F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), c.alias("c"))
    digits = F.regexp_replace(e, "[^0-9]", "")
    low, words = F.lower(e), _plain_words(e)
    surname = part(F.concat(F.lit("surname "), gender), F.element_at(words, -1))
    canon = (
        F.when(kind == "phone", F.when(e.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits)))  # those without + are North American
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "secret", F.regexp_replace(e, _SECRET_NAME, ""))
        .otherwise(e)
    )
    return (
        F.when(kind == "email", F.array(part("local", F.regexp_extract(low, "^([^@]*)", 1)), part("site", F.regexp_extract(low, "@(.*)$", 1))))
        .when((kind == "name") & (F.size(words) > 1), F.array(surname, part(F.concat(F.lit("given "), gender), words[0])))
        .when(kind == "name", F.array(surname))
        .otherwise(F.array(part(kind, canon)))
    )


_SECRET_NAME = rf"^[A-Za-z_\-]+\s*[=:]\s*[\"']?(?:(?<=^[Aa][A-Za-z]{{12}}\s{{0,2}}[=:]\s{{0,2}}[\"']?){_SCHEMES}\s+)?"


def _kept(k: Column, c: Column) -> Column:
    """The beginning of a part that its surrogate keeps: a country, a network."""
    return F.when(k == "access", F.substring(c, 1, 4)).when(k == "phone", F.regexp_extract(c, _COUNTRY, 0)).when(k == "card", F.substring(c, 1, 1)).when(k == "iban", F.substring(c, 1, 2)).otherwise("")


def _spelt_name(k: Column, c: Column, hexed: Column) -> Column:
    """A lower-case name of the same script, with apostrophes and hyphens where it has them, and one letter for one or two
    before or after such a mark; its ending tells the gender where the title does."""

    def of(script: str) -> Column:
        syllables = F.split(F.lit(" ".join(_SYLLABLES[script])), " ")
        at = lambda n, choices: F.element_at(choices, _number(hexed, n) % F.size(choices) + 1)
        ending = lambda g: at(F.lit(9), F.split(F.lit(" ".join(_ENDS[script, g])), " "))
        end = F.when(k.endswith("f"), ending("f")).when(k.endswith("m"), ending("m")).otherwise(at(F.lit(8), syllables))
        whole = F.concat(*[at(F.lit(n), syllables) for n in range(2)], F.when(k.startswith("surname"), F.concat(*[at(F.lit(n), syllables) for n in range(2, 5)])).otherwise(""), end)
        piece = lambda p, i: F.when(F.length(p) <= 2, F.substring(at(i * 11 + 13, syllables), 1, 1)).otherwise(F.concat(*[at(i * 11 + 17 + n, syllables) for n in range(3)]))
        marks = F.regexp_extract_all(c, F.lit("(['-])"), F.lit(1))
        last = F.size(marks)
        pieces = F.transform(F.split(c, "['-]"), lambda p, i: F.concat(F.when(i > 0, F.get(marks, i - 1)).otherwise(""), F.when((i == last) & (F.length(p) > 2), whole).otherwise(piece(p, i))))
        return F.when(last > 0, F.array_join(pieces, "")).otherwise(whole)

    return F.when(c.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _finished(x: Column) -> Column:
    """A part's surrogate, in canonical form, from its kept beginning and spelt rest."""
    plain = F.concat(x.kept, x.body)
    longer = lambda v, at: F.when(F.length(v) < _SHORT, F.concat(v, F.lit("."), F.substring(x.h, at, 8))).otherwise(v)
    ending = F.regexp_extract(x.c, r"(\.[^.]*)$", 1)  # of a domain
    site = F.concat(longer(F.substring(x.body, F.lit(1), F.length(x.body) - F.length(ending)), 60), ending)
    octets = F.array_join(F.transform(F.split(x.c, r"\."), lambda o, i: (_number(x.h, i * 5) % 254 + 1).cast("string")), ".")
    # The last digit of a card makes the Luhn sum right where it was.
    short = F.substring(plain, F.lit(1), F.length(plain) - 1)
    card = F.when(_luhn(x.c) % 10 == 0, F.concat(short, F.pmod(F.lit(10) - _luhn(F.concat(short, F.lit("0"))) % 10, F.lit(10)).cast("string"))).otherwise(plain)
    name = x.k.startswith("surname") | x.k.startswith("given")
    return F.when(x.k == "local", longer(x.body, 100)).when(x.k == "site", site).when(x.k == "ip", octets).when(x.k == "card", card).when(name, _spelt_name(x.k, x.c, x.h)).otherwise(plain)


def part_surrogates(parts: Column, attempt, key: str) -> Column:
    """An array of parts as structs of k, c and made: a function of key, type, part and attempt alone.

    ``attempt`` gives a part's attempt. The steps are arrays of their own, so that each digest, which every character of a
    surrogate draws on, is made once.
    """
    hashed = F.transform(parts, lambda x: F.struct(x.k.alias("k"), x.c.alias("c"), _digest(key, x.k, x.c, attempt(x)).alias("h"), _kept(x.k, x.c).alias("kept")))
    rest = lambda x: F.substring(x.c, F.length(x.kept) + 1, F.length(x.c))
    cut = F.transform(hashed, lambda x: F.struct(x.k.alias("k"), x.c.alias("c"), x.h.alias("h"), x.kept.alias("kept"), rest(x).alias("rest"), ((x.k == "secret") & rest(x).rlike("^[0-9a-f]++$")).alias("hexy")))
    spelt = F.transform(cut, lambda x: F.struct(x.k.alias("k"), x.c.alias("c"), x.h.alias("h"), x.kept.alias("kept"), F.when(x.k.rlike("^(?:surname|given|ip)"), "").otherwise(_spelt(x.rest, x.h, x.hexy)).alias("body")))
    return F.transform(spelt, lambda x: F.struct(x.k.alias("k"), x.c.alias("c"), _finished(x).alias("made")))


def _cased(made: Column, like: Column) -> Column:
    """Lower-case letters made upper-case where the mention has them so; all of them where all of a word's are."""
    one = F.array_join(F.zip_with(F.split(made, ""), F.split(like, ""), lambda m, c: F.when(c.rlike(r"\p{Lu}"), F.upper(m)).otherwise(F.coalesce(m, F.lit("")))), "")
    return F.when(like.rlike(r"\p{Lu}.*\p{Lu}") & ~like.rlike(r"\p{Ll}"), F.upper(made)).when(like.rlike(r"\p{Lu}"), one).otherwise(made)


def _name_cased(made: Column, like: Column) -> Column:
    """A name's letters in the case of the mention, piece by piece between its marks, which are the mention's own."""
    marks = F.regexp_extract_all(like, F.lit("(['’-])"), F.lit(1))
    pieces = F.zip_with(F.split(made, "['-]"), F.split(like, "['’-]"), lambda m, x: _cased(m, x))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, F.get(marks, i - 1)).otherwise(""), p)), "")


def _filled(like: Column, made: Column) -> Column:
    """The letters and digits of a mention replaced by as many of a surrogate's last ones."""
    plain = lambda v: F.length(F.regexp_replace(v, "[^A-Za-z0-9]", ""))
    skip = F.length(made) - plain(like)
    return F.array_join(F.transform(F.split(like, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substring(made, skip + plain(F.substring(like, F.lit(1), i)) + 1, F.lit(1))).otherwise(c)), "")


def _written_back(e: Column, kind: Column, parts: Column) -> Column:
    """The replacement of a mention in its own format, from the surrogates of its parts."""
    made = lambda i: F.get(parts, F.lit(i)).made
    email = F.concat(_cased(made(0), F.regexp_extract(e, "^([^@]*)", 1)), F.lit("@"), _cased(made(1), F.regexp_extract(e, "@(.*)$", 1)))
    words = F.split(_words_of_name(e), r"\s+")
    before = F.substring(e, F.lit(1), F.length(e) - F.length(_words_of_name(e)))
    surname = _name_cased(made(0), F.element_at(words, -1))
    gap = F.regexp_extract(_words_of_name(e), r"(\s+)", 1)
    name = F.concat(before, F.when(F.size(words) > 1, F.concat(_name_cased(made(1), words[0]), gap, surname)).otherwise(surname))
    secret = F.concat(F.regexp_extract(e, f"({_SECRET_NAME})", 1), made(0))
    return F.when(kind == "email", email).when(kind == "name", name).when(kind == "secret", secret).when(kind.isin("phone", "card", "ssn", "iban"), _filled(e, made(0))).otherwise(made(0))


def surrogates(found: Column, attempt, key: str) -> Column:
    """An array of entities as structs of entity, kind and made."""
    parts = F.transform(told_apart(found), lambda x: F.struct(x.e.alias("e"), x.kind.alias("kind"), part_surrogates(parts_of(x.e, x.kind, x.g), attempt, key).alias("parts")))
    return F.transform(parts, lambda x: F.struct(x.e.alias("entity"), x.kind.alias("kind"), _written_back(x.e, x.kind, x.parts).alias("made")))


def has_entity(text: Column) -> Column:
    """Is there an entity? First by what every kind of entity holds one of, which is quick to tell."""
    mark = reduce(lambda a, b: a | b, [text.contains(x) for x in ("@", "=", ":", "AKIA", "ASIA")], text.rlike("[0-9]"))
    maybe = mark | text.rlike(f"(?=[CDFHMNPSdmnpгГ]){PATTERNS['name']}")
    return maybe & F.when(text.contains("@"), text.rlike(ANY)).otherwise(text.rlike(NO_AT))


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(NO_AT), F.lit(0)))


def _named(k: Column, c: Column) -> Column:
    return F.concat_ws("\0", k, c)


def second_attempts(docs: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(part, attempt) of the parts whose first surrogate clashes; the attempts given leave no two of a type alike, surnames
    of whatever gender being one type, and given names another."""
    found = docs.where(has_entity(F.col("text"))).select(F.explode(told_apart(entities(F.col("text")))).alias("x")).groupBy("x").agg(F.count("*").alias("mentions"))
    parts = written(found.select(F.explode(parts_of(F.col("x.e"), F.col("x.kind"), F.col("x.g"))).alias("p")).select("p.k", "p.c").distinct())
    made = lambda attempt: part_surrogates(F.array(F.struct("k", "c")), lambda x: attempt, key)[0].made
    now = written(parts.select("k", "c", F.lit(0).alias("attempt"), made(F.lit(0)).alias("surrogate")))
    kind = F.substring_index("k", " ", 1).alias("kind")
    for _ in range(attempts):
        shared = now.groupBy(kind, "surrogate").agg(F.min(F.struct("attempt", "c", "k")).alias("first"), F.count("*").alias("n"))
        real = parts.select(kind, F.col("c").alias("surrogate"), F.lit(True).alias("real")).distinct()
        clash = shared.join(real.hint("merge"), ["kind", "surrogate"], "left").where("n > 1 or real")
        judged = written(clash.select("kind", "surrogate", F.when(F.col("real").isNull(), F.col("first.c")).alias("first"), F.col("first.k").alias("first_k")))
        again = written(now.withColumn("kind", kind).join(judged.hint("merge"), ["kind", "surrogate"]).where("first is null or c <> first or k <> first_k").select("k", "c", (F.col("attempt") + 1).alias("attempt")))
        if not again.limit(1).count():
            return now.where("attempt > 0").select(_named(F.col("k"), F.col("c")).alias("part"), "attempt")
        now = written(now.join(again.select("k", "c").hint("merge"), ["k", "c"], "left_anti").unionByName(again.withColumn("surrogate", made(F.col("attempt")))))
    raise RuntimeError("surrogates still clash: there are more entities of a format than surrogates")


def _replaced(text: Column, made: Column) -> Column:
    """The text with its entities replaced, in order; between them full names that it has with a title go as well."""
    parts = F.when(text.contains("@"), F.split(text, ANY, -1)).otherwise(F.split(text, NO_AT, -1))
    words = lambda e: F.split(_words_of_name(e), r"\s+")
    full = F.array_distinct(F.filter(F.transform(F.filter(made, lambda x: x.kind == "name"), lambda x: F.struct(words(x.entity).alias("was"), words(x.made).alias("made"))), lambda x: F.size(x.was) > 1))
    pattern = lambda x: F.concat(F.lit(_APART + r"\Q"), x.was[0], F.lit(rf"\E({_GAP})\Q"), x.was[1], F.lit(r"\E(?![\p{L}\p{N}])"))
    bare = lambda p: F.aggregate(full, p, lambda t, x: F.regexp_replace(t, pattern(x), F.concat(x.made[0], F.lit("$1"), x.made[1])))
    parts = F.when(F.size(full) > 0, F.transform(parts, bare)).otherwise(parts)
    return F.array_join(F.zip_with(parts, made, lambda a, b: F.concat(a, F.coalesce(b.made, F.lit("")))), "")


def pseudonymise(docs: DataFrame, key: str, mapped: int = MAPPED) -> DataFrame:
    """All columns of the input with ``text`` replaced, and ``n_entities`` and ``entity_counts`` (map of type to count).

    Whoever has the key can rebuild the surrogates: keep it from those who get the texts. Null texts stay null, with no
    entities; texts without an entity stay as they are. Equal entities get equal surrogates everywhere, in whatever
    spelling, different ones different surrogates. Names are found by a title or a cue such as ``Dear``, and full names
    that a text has with one also without it there; other bare names are not told from other words. A person whose title
    tells a gender in one text, and whom another text names by a cue or a neutral title only, has two surrogates: no text
    reads another. Repeated rows: a row each. No rows: none. An input column named like a result is replaced by it.
    """
    again = written(second_attempts(docs, key))
    n = again.count()
    own = [c for c in docs.columns if c not in ("n_entities", "entity_counts")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), "text", F.when(has_entity(F.col("text")), entities(F.col("text"))).alias("found"))
    if n == 0:
        attempt = lambda x: F.lit(0)
    elif n <= mapped:
        tries = F.from_json(F.lit(again.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))))).first()[0]), "map<string,int>")
        attempt = lambda x: F.coalesce(tries[_named(x.k, x.c)], F.lit(0))
    else:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
        mention = rows.where("found is not null").select("row", F.explode(F.array_distinct(told_apart(F.col("found")))).alias("x")).select("row", F.explode(parts_of(F.col("x.e"), F.col("x.kind"), F.col("x.g"))).alias("p"))
        mention = mention.select("row", _named(F.col("p.k"), F.col("p.c")).alias("part")).distinct()
        tried = written(mention.join(again.hint("merge"), "part").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))).alias("tries")))
        rows = rows.join(tried.hint("merge"), "row", "left")
        attempt = lambda x: F.coalesce(F.col("tries")[_named(x.k, x.c)], F.lit(0))
    rows = rows.withColumn("made", F.when(F.col("found").isNotNull(), surrogates(F.col("found"), attempt, key)))
    counts = F.map_from_entries(F.transform(F.array_distinct("made.kind"), lambda k: F.struct(k, F.size(F.filter("made", lambda x: x.kind == k)))))
    none = F.col("made").isNull()
    out = rows.select(
        "doc",
        F.when(none, F.col("text")).otherwise(_replaced(F.col("text"), F.col("made"))).alias("changed"),
        F.when(none, 0).otherwise(F.size("made")).alias("n_found"),
        F.when(none, F.create_map().cast("map<string,int>")).otherwise(counts).alias("counts"),
    )
    return out.select(*[F.col("changed").alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in own], F.col("n_found").alias("n_entities"), F.col("counts").alias("entity_counts"))

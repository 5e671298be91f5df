"""String kernels as chains of built-in replacements.

A chain is a list of steps: ("map", from, to) replaces characters one by one, ("sub", pattern, text) replaces
matches of a regular expression (groups as \\1), ("lower",) lowers. `applied` makes a Column of it.
Patterns use groups instead of look-around, so any engine with POSIX-like expressions can run a chain, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Chain = list[tuple]


def applied(chain: Chain, value: Column) -> Column:
    """The chain as a Column expression."""

    def step(v: Column, s: tuple) -> Column:
        if s[0] == "lower":
            return F.lower(v)
        if s[0] == "map":
            return F.translate(v, s[1], s[2])
        return F.regexp_replace(v, F.lit(s[1]), F.lit(s[2].replace("$", "\\$").replace("\\1", "$1").replace("\\2", "$2")))

    return reduce(step, chain, value)


def both(lower_from: str, lower_to: str) -> tuple:
    """A map for small and capital letters."""
    return ("map", lower_from + lower_from.upper(), lower_to + lower_to.upper())


def pairs(*changes: tuple[str, str]) -> Chain:
    return [("sub", a, b) for a, b in changes]


SPACES = [("sub", r"\s+", " "), ("sub", r"^\s+|\s+$", "")]
#: Cyrillic letters and their Latin ones; ъ and ь stay.
TO_LATIN = [
    ("lower",),
    ("map", "абвгдеёжзийклмнопрстуфхцчшыэіґўѓѝћѐ", "abvgdeežzijklmnoprstufhcčšyeigugiće"),
    *pairs(("щ", "št"), ("ю", "ju"), ("я", "ja"), ("ї", "ji"), ("є", "je"), ("џ", "dž"), ("ѕ", "dz")),
]
#: Latin letters with marks, and the bare ones.
STRIP = [
    ("lower",),
    (
        "map",
        "čćçĉċšśşŝžźżđďðěéèêëęėēáàâãäåąāăíìîïįīóòôõöøōúùûüųūůýÿỳńňñťţřŕľĺłģğķĥ",
        "cccccsssszzzdddeeeeeeeeaaaaaaaaaiiiiiiooooooouuuuuuuyyynnnttrrlllggkh",
    ),
    ("sub", "ß", "ss"),
]
SIMPLE_LATIN = TO_LATIN + STRIP + SPACES
#: Letters that count alike when forms are compared.
NORMAL_FORM = [("sub", "[ъь]", ""), ("map", "čČšŠžŽěĚńŃłŁóÓáÁéÉíÍúÚýÝ", "ccsszzeennllooaaeeiiuuyy")]

#: A soft consonant before i, e, ę, ě is written hard, and swallows a j after it.
SOFT = [("sub", f"{a}([ieęě])", b + "\\1") for s, h in zip("ľťďňśźćđ", "ltdnszčd") for a, b in ((s.upper(), h.upper()), (s, h))] + [
    ("sub", "([ĽľŤťĎďŇňŚśŹźĆćĐđ])[jJ]", "\\1")
]
#: The Latin alphabet and its Cyrillic one.
LATIN, CYRILLIC = "bvgdžzpfhktčšsclmnrjaeiouyěęų", "бвгджзпфхктчшсцлмнріаеиоуыѣѧѫ"
_DIGRAPHS = pairs(("Dž", "Џ"), ("dž", "џ"), ("Št", "Щ"), ("št", "щ"))


def _softened(mark: str) -> Chain:
    changes = []
    for s, c in (("ľ", "л"), ("ť", "т"), ("ď", "д"), ("ň", "н"), ("ś", "с"), ("ź", "з")):
        changes += [(s.upper(), (c + mark).upper()), (s, c + mark)]
    return pairs(*changes, ("Ć", "Ћ"), ("ć", "ћ"), ("Đ", ("д" + mark).upper()), ("đ", "д" + mark))


TO_CYRILLIC = SOFT + _DIGRAPHS + [both(LATIN, CYRILLIC)] + _softened("ь")
TO_CYRILLIC_NEW = SOFT + _DIGRAPHS + [both(LATIN, CYRILLIC)] + _softened("і")
EAST = TO_CYRILLIC + [both("ѣѧѫ", "еяу")]
WEST = [both("ěęǫų", "eeoo")]
SOUTH = TO_CYRILLIC + [both("ѣѧѫ", "ееа")]
#: Phonetic signs, without the brackets around a transcription.
IPA = (
    [("lower",), ("sub", r"^\s+|\s+$", "")]
    + SOFT
    + pairs(("dž", "d͡ʒ"), ("št", "ʃt"), ("č", "t͡ʃ"), ("c", "t͡s"), ("ľ", "lʲ"), ("ť", "tʲ"), ("ď", "dʲ"), ("ň", "nʲ"), ("ś", "sʲ"), ("ź", "zʲ"), ("ć", "tɕ"), ("đ", "dʑ"))
    + [("map", "žšh", "ʒʃx"), ("sub", "jj", "jʲ"), ("sub", r"([^aeěiyouęǫų \-])j", "\\1ʲ"), ("map", "ěeoy", "ɛɛɔi")]
    + pairs(("ę", "ɛ̃"), ("[ǫų]", "ɔ̃"))
)
#: The etymological hub in Cyrillic letters, back to Latin ones.
CYRILLIC_TO_HUB = (
    pairs(("Џ", "Dž"), ("џ", "dž"), ("Щ", "Št"), ("щ", "št"), ("Ќ", "Ks"), ("ќ", "ks"))
    + [("map", CYRILLIC + CYRILLIC.upper() + "ґҐ", LATIN + LATIN.upper() + "gG")]
    + [("sub", f"([ijIJ]){c}", "\\1" + v) for s, v in (("я", "a"), ("ю", "u"), ("є", "e"), ("ё", "o")) for c, v in ((s.upper(), v.upper()), (s, v))]
    + pairs(("Я", "Ja"), ("я", "ja"), ("Ю", "Ju"), ("ю", "ju"), ("Є", "Je"), ("є", "je"), ("Ё", "Jo"), ("ё", "jo"))
    + [("lower",)]
)
_ADJECTIVE_END = lambda a, b, c, d: pairs((r"yj([^\pL▲]|$)", a + "\\1"), (r"ij([^\pL▲]|$)", b + "\\1"), (r"YJ([^\pL▲]|$)", c + "\\1"), (r"IJ([^\pL▲]|$)", d + "\\1"))
#: Standard spelling made simple: short adjective endings, no nasal vowels, j before a vowel as i.
SIMPLE = (
    SOFT
    + _ADJECTIVE_END("y", "i", "Y", "I")
    + [both("ěęǫų", "eeuu"), ("sub", "([iI])[jJ]([auoeAUOE])", "\\1\\2"), ("sub", "J([auoeAUOE])", "I\\1"), ("sub", "j([auoeAUOE])", "i\\1")]
    + [both("ľťďňśźćđ", "ltdnszcd")]
)
STANDARD = [both("ěę", "ee"), both("ǫų", "uu")]
SIMPLE_TO_HUB = [("sub", "[iI]([aeouAEOU])", "j\\1"), ("lower",)]
#: The Glagolitic alphabet, small letters; digraphs first.
GLAGOLITIC = pairs(("dž", "ⰴⰶ"), ("št", "ⱋ"), ("dz", "ⰷ"), ("ju", "ⱓ"), ("jo", "ⱖ"), ("je", "ⱔ"), ("ja", "ⰻⰰ"), ("y", "ⱏⰹ")) + [
    ("map", "abvgdežzijklmnoprstufhcěęǫų", "ⰰⰱⰲⰳⰴⰵⰶⰸⰹⰻⰽⰾⰿⱀⱁⱂⱃⱄⱅⱆⱇⱈⱌⱑⱗⱘⱘ")
]
_C = "[bcdfghjklmnprstvxzščž]"
#: Sound changes from proto-forms: marks off, liquids moved, nasals, jers.
FROM_PROTO = (
    [("lower",), ("sub", r"^\s+|\s+$", ""), ("sub", "[́̀̂̑̄̆̋̇]", "")]
    + pairs(("[āáǎ]", "a"), ("[eéēěě]", "e"), ("[oóō]", "o"), ("[uúū]", "u"), ("[iíī]", "i"), (f"^ort", "rat"))
    + [("sub", f"({_C}){a}({_C})", f"\\1{b}\\2") for a, b in (("or", "ra"), ("ol", "la"), ("er", "rě"), ("el", "lě"))]
    + pairs(("[ǫǭ]", "ų"), ("[ъь]$", ""), ("ь", "e"), ("ъ", "o"), ("ʒ", "z"), ("[ľĺ]", "lj"), ("ń", "nj"), ("ŕ", "r"))
)

#: The new orthography's letters in standard Latin; a soft vowel after i loses its j.
NEW_TO_STANDARD = (
    pairs((r"ый([^\pL▲]|$)", "y\\1"), (r"ий([^\pL▲]|$)", "i\\1"), (r"ЫЙ([^\pL▲]|$)", "Y\\1"), (r"ИЙ([^\pL▲]|$)", "I\\1"), ("[Ъъ҂]", ""))
    + pairs(("Џ", "Dž"), ("џ", "dž"), ("Ѕ", "Dz"), ("ѕ", "dz"), ("Ї", "Ji"), ("ї", "ji"), ("Į", "In"), ("į", "in"), ("Щ", "Št"), ("щ", "št"), ("Ќ", "Ks"), ("ќ", "ks"), ("Ѱ", "Ps"), ("ѱ", "ps"))
    + [both("бвгґджзпфхктчшсцјлмнрҏйўáåэыӯóаеиуôоіьѣѧѫѳ", "bvggdžzpfhktčšscilmnrrjvaaeyvoaeiuooijeeut")]
    + [("sub", f"([iI]){c}", "\\1" + v) for s, v in (("я", "a"), ("ю", "u"), ("є", "e"), ("ё", "o")) for c, v in ((s.upper(), v.upper()), (s, v))]
    + pairs(("Я", "Ja"), ("я", "ja"), ("Ю", "Ju"), ("ю", "ju"), ("Є", "Je"), ("є", "je"), ("Ё", "Jo"), ("ё", "jo"))
)
#: What is left of a lemma when it is matched with other sources.
CLEAN_MATCH = [("lower",), ("sub", "[\u0301\u0300\u0302\u0311\u0304\u0306\u030b\u0307]", ""), ("sub", "[^a-zA-Zěęǫųščžy]", "")]

SCRIPTS = ("etym_lat", "etym_cyr", "std_lat", "std_cyr", "simple_lat", "simple_cyr")
TO_HUB: dict[str, Chain] = {
    "etym_lat": [("lower",)],
    "etym_cyr": CYRILLIC_TO_HUB,
    "std_lat": [],
    "simple_lat": SIMPLE_TO_HUB,
    "simple_cyr": CYRILLIC_TO_HUB + SIMPLE_TO_HUB,
}
FROM_HUB: dict[str, Chain] = {
    "etym_lat": [("lower",)],
    "etym_cyr": TO_CYRILLIC,
    "std_lat": STANDARD,
    "std_cyr": TO_CYRILLIC + [both("ѣѧ", "ее"), both("ѫ", "у")],
    "simple_lat": SIMPLE,
}


def converted(value: Column, source: str, target: str) -> Column:
    """From one spelling to another, through etymological Latin."""
    return value if source == target else applied(TO_HUB[source] + FROM_HUB[target], value)


def script(value: Column) -> Column:
    """Which of the spellings a text is in, judged by its letters; null for no text."""
    has = lambda pattern: value.rlike(pattern)
    historical, cyrillic = has("(?iu)[ěęǫų]") | has("[ѢѣѦѧѪѫ]"), has("(?iu)[а-яѢѣѦѧѪѫћЋ]")
    j, i = has("(?i)j[aeou]"), has("(?iu)i[aeouаеоу]")
    in_cyrillic = F.when(historical, "etym_cyr").when(i & ~j, "simple_cyr").otherwise("std_cyr")
    in_latin = F.when(historical, "etym_lat").when(j, "std_lat").when(i, "simple_lat").otherwise("std_lat")
    return F.when(value.isNull() | (value == ""), F.lit(None)).when(cyrillic, in_cyrillic).otherwise(in_latin)


def split_translations(values: Column) -> Column:
    """All comma-separated parts of an array of texts, trimmed, in Latin letters, without blank ones."""
    parts = F.flatten(F.transform(values, lambda v: F.split(F.coalesce(v, F.lit("")), ",")))
    return F.filter(F.transform(parts, lambda p: applied(TO_LATIN + SPACES, p)), lambda p: p != "")


def mark(word: Column, translation: Column) -> Column:
    """+, ~ or - by the similarity of two texts in simple Latin; null where one is missing or blank."""
    a, b = applied(SIMPLE_LATIN, word), applied(SIMPLE_LATIN, translation)
    longest = F.greatest(F.length(a), F.length(b))
    similar = 1 - F.levenshtein(a, b) / longest
    return F.when((a != "") & (b != ""), F.when(similar >= 0.6, "+").when(similar >= 0.35, "~").otherwise("-"))


def intelligibility(word: Column, translations: dict[str, Column]) -> Column:
    """Marks like `ru+ pl~` for the languages that have a translation, in a fixed order of languages."""
    order = ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "mk", "bg"]
    return F.concat_ws(" ", *[F.concat(F.lit(c), mark(word, translations[c])) for c in order if c in translations])


def pairwise_similarity(words: Column) -> Column:
    """1 - mean / greatest edit distance over all pairs of an array: 1 if all are equal, 0 for fewer than two."""
    n = F.size(words)
    distances = F.flatten(
        F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.levenshtein(a, b)))
    )
    total = F.aggregate(distances, F.lit(0), lambda x, y: x + y)
    return F.when(n < 2, 0.0).when(F.array_max(distances) == 0, 1.0).otherwise(1 - total / F.size(distances) / F.array_max(distances))


def target_similarity(target: Column, others: Column) -> Column:
    """1 - mean distance / longest text, from 0 to 1; 0 without a target or others."""
    total = F.aggregate(others, F.lit(0), lambda x, o: x + F.levenshtein(target, o))
    longest = F.greatest(F.length(target), F.array_max(F.transform(others, F.length)))
    return F.when((target == "") | (F.size(others) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total / F.size(others) / longest)))


def syllables(word: Column) -> Column:
    return F.regexp_count(word, F.lit("(?iu)[aeiouyěęǫọų]"))


def inferred_gender(value: Column) -> Column:
    """By the last letter of the last word."""
    last = F.substring(F.element_at(F.split(value, " "), -1), -1, 1)
    return (
        F.when(last.isin("a", "å"), "FEM")
        .when(last.isin("o", "e", "ę"), "NEUT")
        .when(last == "j", "FEM")
        .when(last == "u", "MASC")
        .when(last.rlike("[bcdfghklmnprstvwxyzžščńćđňľ]"), "MASC")
    )


def without_tags(html: Column, most: int = 200) -> Column:
    """The first characters of a page's text."""
    text = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " ")
    return F.substring(F.regexp_replace(text, r"^\s+|\s+$", ""), 1, most)


def chapters(body: Column) -> Column:
    """array<struct<heading, content>>: parts that begin with `## `; text before the first is a part without a heading."""
    parts = F.split(body, "(?m)^## ")
    strip = lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")

    def part(p: Column, i: Column) -> Column:
        at = F.instr(p, "\n")
        heading = F.when(i == 0, F.lit("")).when(at == 0, strip(p)).otherwise(strip(F.substring(p, F.lit(1), at - 1)))
        content = F.when(i == 0, strip(p)).when(at == 0, F.lit("")).otherwise(strip(F.substring(p, at + 1, F.length(p))))
        return F.struct(heading.alias("heading"), content.alias("content"))

    split = F.filter(F.transform(parts, part), lambda c: (c["heading"] != "") | (c["content"] != ""))
    return F.when(F.size(parts) <= 1, F.array(F.struct(F.lit("").alias("heading"), body.alias("content")))).otherwise(split)


#: Tags of parts of speech in TEI.
TEI_TAGS = {
    "NOUN": "n",
    "VERB": "v",
    "ADJ": "adj",
    "ADV": "adv",
    "PRON": "pron",
    "NUM": "num",
    "ADP": "prep",
    "CONJ": "cc",
    "SCONJ": "cs",
    "PART": "part",
    "INTJ": "intj",
    "DET": "det",
    "AUX": "v",
    "PUNCT": "punct",
    "X": "x",
}
XML = pairs(("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def tei_token(surface: Column, lemma: Column, pos: Column, feats: Column, word: Column, sure: Column) -> Column:
    """A token as XML; feats: key=value joined by a bar; sure: whether an analysis matched."""
    tags = F.create_map(*[F.lit(x) for pair in TEI_TAGS.items() for x in pair])
    tag = F.coalesce(F.try_element_at(tags, pos), F.lower(pos))
    text = applied(XML, surface)
    ana = F.when(feats != "", F.concat(F.lit(' ana="'), applied(XML, F.replace(feats, F.lit("|"), F.lit("; "))), F.lit('"'))).otherwise("")
    low = F.when(sure, "").otherwise(' cert="low"')
    w = F.concat(F.lit('<w lemma="'), applied(XML, lemma), F.lit('" pos="'), tag, F.lit('"'), ana, low, F.lit(">"), text, F.lit("</w>"))
    return F.when(word, w).otherwise(F.concat(F.lit("<pc>"), text, F.lit("</pc>")))


def yo_variants(word: Column) -> Column:
    """The word, with е for each ё, and with ё for each е."""
    return F.array_distinct(F.array(word, F.replace(word, F.lit("ё"), F.lit("е")), F.replace(word, F.lit("е"), F.lit("ё"))))


def feats_text(feats: Column) -> Column:
    """A map of features as key=value; key=value, without empty ones."""
    entries = F.filter(F.map_entries(feats), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def joined_chapters(parts: Column) -> Column:
    """Chapters (heading, content) as one text, the reverse of chapters()."""
    text = lambda c: F.when(c["heading"] != "", F.concat(F.lit("## "), c["heading"], F.lit("\n\n"), c["content"])).otherwise(c["content"])
    return F.array_join(F.filter(F.transform(parts, text), lambda t: t != ""), "\n\n")

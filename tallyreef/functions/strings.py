"""String expressions of the cleaning and token pipelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: French stop words dropped from comments, with seven more; `ne` and `pas` stay, as negation carries meaning.
STOP_WORDS = (
    "au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes moi mon nos notre nous "
    "on ou par pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y "
    "été étée étées étés étant étante étants étantes suis es est sommes êtes sont serai seras sera serons serez seront "
    "serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons "
    "soyez soient fusse fusses fût fussions fussiez fussent ayant ayante ayantes ayants eu eue eues eus ai as avons avez ont "
    "aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes "
    "eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent donc alors car parce ca"
).split()
#: Lemmas that say nothing of an item.
BLOCK_LIST = ["bref", "bof", "excelent", "bon", "autre", "seul", "tendre", "fin", "super", "superbe", "juste", "jouable", "ca", "faire", "pouvoir", "ausi"]
#: Accented letters and what stands for them.
ACCENTS, PLAIN = "àâäáãçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaceeeeiiiinooooouuuuyy"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…•"


def spaced(text: Column) -> Column:
    """Punctuation as blanks."""
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def strip_accents(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTS, PLAIN)


def collapse_repeats(word: Column) -> Column:
    """Three or more of a character in a row become one."""
    return F.regexp_replace(word, r"(.)\1{2,}", "$1")


def clean_tokens(text: Column, shortest: int = 1, longest: int = 20) -> Column:
    """Lower-case words without stop words, repeats, hash-like words and digits; word length strictly between the bounds."""
    words = split_words(spaced(F.replace(F.lower(text), F.lit("n'"), F.lit("ne "))))
    words = F.filter(words, lambda x: ~x.isin(STOP_WORDS))
    words = F.filter(F.transform(words, collapse_repeats), lambda x: ~x.rlike(r"^(?=.*\d)[a-z0-9]{20,}$"))
    words = F.flatten(F.transform(words, lambda x: split_words(F.regexp_replace(x, r"\d+\w*", " "))))
    return F.filter(words, lambda x: (F.length(x) > shortest) & (F.length(x) < longest))


def repair_sentences(text: Column) -> Column:
    """Long rules become line ends, sentence ends get a blank, escaped apostrophes their own character."""
    out = F.replace(text, F.lit("\\'"), F.lit("'"))
    out = F.regexp_replace(out, r"\*{15,}|-{10,}", "\n")
    return F.regexp_replace(out, r"([.!?)])(?=\p{L})", "$1 ")


def simple_pos(tag: Column) -> Column:
    """VER:pres, VER:infi, ... -> VER."""
    return F.regexp_replace(tag, "^VER:.*$", "VER")


def parse_range(text: Column) -> Column:
    """struct(lo, hi) of "jusqu'à 4", "à partir de 2", "3", "2 à 6", "8 ans et +"; no end is null."""
    s = F.regexp_replace(F.trim(text), r"^jusqu'à (\d+)$", "1 à $1")
    s = F.regexp_replace(s, r"^à partir de (\d+)$", "$1 à 0")
    s = F.regexp_replace(s, r"^(\d+) ans et \+$", "$1 à 99")
    s = F.regexp_replace(s, r"^(\d+)$", "$1 à $1")
    part = (lambda k: F.try_to_number(F.nullif(F.regexp_extract(s, r"^(\d+) à (\d+)$", k), F.lit("")), F.lit("999999")).cast("long"))
    return F.struct(part(1).alias("lo"), F.nullif(part(2), F.lit(0).cast("long")).alias("hi"))


def range_display(lo: Column, hi: Column, cut: int) -> Column:
    """lo-hi; lo+ where hi is null or over the cut; - where there is no lo."""
    text = (lambda c: c.cast("string"))
    return F.when(lo.isNull(), "-").when(hi.isNull() | (hi > cut), F.concat(text(lo), F.lit("+"))).otherwise(F.concat(text(lo), F.lit("-"), text(hi)))


def split_fields(text: Column, n: int) -> list[Column]:
    """The first n fields between bars; "~" is null."""
    parts = F.split(text, r"\|", -1)
    return [F.nullif(F.get(parts, k), F.lit("~")) for k in range(n)]


def first_tags(tags: Column, n: int = 2) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.slice(F.split(tags, r"\|"), 1, n), ", "), F.lit("")), F.lit("-"))

"""Normalisation of titles and journal names, as column expressions."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that collapses, as a class of Java's patterns.
SPACES = r"[\x0C\n\r\t\u00A0\u0020\u1680\u180E\u2028\u2029\u2000-\u200A\u202F\u205F\u3000]+"
#: Letters with an HTML 4 entity of the form letter + accent, and what is left of them.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŠŸÐàáâãäåçèéêëìíîïñòóôõöøùúûüýÿšð"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYSYEaaaaaaceeeeiiiinoooooouuuuyyse"
#: Ligatures and the like, which become two letters.
LIGATURES = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "sz", "Þ": "TH", "þ": "th"}
#: Named entities of HTML 5, as the standard library has them, and what the references are written like.
ENTITIES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Stop words of journal names, and of titles.
NAME_STOPS = "and at from in of on the aus dem der das des die fur und zu zur de du et la le les del y della di van da do e v".split()
TITLE_STOPS = "and der des die do et fur in of the und".split()
#: Series markers, in the order in which they are lifted.
SERIES = (
    r"\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|[0-9]{1,3}(st|nd|rd|th)?)\s+(series|serie|ser)\b",
    r"\b(new|nova|nouvelle|neue|nuova|neudruck)\s+(series|serie|ser|folge|reihe)\b",
    r"\bn\s+(s|f|ser|serie|series|folge)\b",
    r"\b(series|serie|ser|folge|reihe)\b(\s+([0-9]{1,3}|[ivxlcdm]{1,5}|[a-z])\b)?",
)
#: Upper-case letters that a browse list files under a plain one.
FOLDED = {
    "A": "ÀÁÂÃÄÅĀĂĄÆ", "C": "ÇĆČĈĊ", "D": "ÐĐĎ", "E": "ÈÉÊËĒĖĘĚ", "I": "ÌÍÎÏĪĮİ", "N": "ÑŃŇ", "O": "ÒÓÔÕÖØŌŐ", "U": "ÙÚÛÜŪŮŰ", "Y": "ÝŸ",
    "Z": "ŽŹŻ", "S": "ŠŚŞŜ", "L": "ŁĽ", "T": "ŢŤ", "R": "ŔŘ",
}
PREFIX, ANCHOR_WORDS = 3, 3


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def _entity(e: Column) -> Column:
    """What an entity stands for: by name or by number; itself, where there is no such thing."""
    names = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in ENTITIES.items())), F.lit("\x02"), F.lit("\x01"))
    body = F.substr(e, F.lit(2), F.length(e) - 2)
    number = F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10)).when(body.startswith("#"), F.substr(body, F.lit(2))).cast("bigint")
    # Code points that text may hold; through UTF-32, as it has them all.
    fit = number.isin(9, 10, 13) | number.between(32, 126) | number.between(160, 0xD7FF) | number.between(0xE000, 0xFFFD) | number.between(0x10000, 0x10FFFF)
    numbered = F.when(fit, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    return F.coalesce(F.when(body.startswith("#"), numbered).otherwise(F.try_element_at(names, body)), e)


def decode_entities(c: Column) -> Column:
    """All entities of HTML 5 with their semicolon, once."""

    def decoded(x: Column) -> Column:
        parts = F.zip_with(F.split(x, ENTITY, -1), F.regexp_extract_all(x, F.lit(ENTITY), F.lit(0)), lambda gap, e: F.concat(gap, F.when(e.isNull(), F.lit("")).otherwise(_entity(e))))
        return F.when(x.rlike(ENTITY), F.array_join(parts, "")).otherwise(x)

    return F.transform(F.array(c), decoded)[0]


def unaccent(c: Column) -> Column:
    """Letters with a named accent, plain; others stay (and fall to what removes all but a-z and 0-9)."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), LIGATURES.items(), F.translate(c, ACCENTED, PLAIN))


def clean_title(c: Column) -> Column:
    """Without tags and entities, a space after a full stop before a letter, white space collapsed."""
    dotted = F.regexp_replace(decode_entities(strip_tags(c)), r"\.(\p{L})", r". $1")
    return F.regexp_replace(dotted, SPACES, " ")


def _letters(c: Column) -> Column:
    """Plain letters, digits and spaces alone. Runs of them are picked out: a search for all other characters takes ten times as long in Java's patterns."""
    return F.array_join(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9 ]+"), F.lit(0)), "")


def normalise_title(c: Column) -> Column:
    """Lower-cased, plain letters and digits; trimmed before punctuation goes, so spaces it leaves stay."""
    trimmed = F.regexp_replace(F.regexp_replace(unaccent(clean_title(c)), r"^\s+", ""), r"\s+$", "")
    return F.lower(_letters(trimmed))


def _split_acronyms(dotted: Column) -> Column:
    """Acronyms as single letters, unless all is capitals; white space collapsed. Texts without two capitals in a row have none."""

    def one(d: Column) -> Column:
        split = F.regexp_replace(d, r"(?<=\b[A-Z]{1,20})(?=[A-Z]+\b)", " ")
        return F.regexp_replace(F.when(d.rlike("[A-Z]{2}") & ~d.rlike(r'^[\p{Lu}\s"]+$'), split).otherwise(d), SPACES, " ")

    return F.transform(F.array(dotted), one)[0]


def clean_name(c: Column) -> Column:
    """As for titles; also without elided articles, and with acronyms as single letters (unless all is capitals)."""
    bare = F.regexp_replace(decode_entities(strip_tags(c)), r"(?i)[d|l]['|’]", "")
    return _split_acronyms(F.regexp_replace(bare, r"\.(\p{L})", r". $1"))


def normalise_name(c: Column) -> Column:
    """Lower-cased, plain letters and digits, trimmed at the end."""
    return F.trim(F.lower(_letters(unaccent(clean_name(c)))))


def drop_stops(c: Column, stops: list[str] = NAME_STOPS) -> Column:
    bare = F.regexp_replace(c, rf"(?i)\b({'|'.join(stops)})\b", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s\s+", " "), r"^\s+", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, " ", -1), lambda w: F.trim(w) != "")


def told_words(normalised: Column, stops: list[str] = NAME_STOPS) -> Column:
    """The words of a normalised text (a to z, 0 to 9 and spaces) without stop words: those that drop_stops leaves there, as a word ends at a space only."""
    return F.filter(words(normalised), lambda w: ~w.isin(*stops))


def name_tokens(c: Column) -> Column:
    """The words of a name that tell it apart."""
    return told_words(normalise_name(c))


def strip_series(normalised: Column) -> tuple[Column, Column]:
    """The text without series markers, and the markers, joined by '; '."""
    text, found = normalised, []
    for p in SERIES:
        text, markers = _series_step(text, p)
        found.append(markers)
    return F.trim(F.regexp_replace(text, r"\s+", " ")), F.array_join(F.concat(*found), "; ")


def _series_step(text: Column, pattern: str) -> tuple[Column, Column]:
    """The text without the markers of one pattern, and those markers."""
    return F.regexp_replace(text, pattern, " "), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.trim(m))


def _told_tokens(stripped: Column) -> Column:
    return F.filter(told_words(stripped), lambda t: ~t.rlike("^[0-9]+$"))


def _keys(tokens: Column, prefixes: Column) -> dict[str, Column]:
    return {
        "tokens": F.array_join(tokens, " "),
        "key_a": F.array_join(prefixes, " "),
        "key_b": F.array_join(F.array_sort(prefixes), " "),
        "key_c": F.array_join(F.slice(prefixes, 1, ANCHOR_WORDS), " "),
        "key_d": F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), ""),
    }


KEYS = ("normalized", "tokens", "series", "key_a", "key_b", "key_c", "key_d")


def name_keys(raw: Column) -> dict[str, Column]:
    """normalized, tokens, series, and the blocking keys a (prefixes in order), b (sorted), c (the first few), d (initials)."""
    normalised = normalise_name(raw)
    stripped, series = strip_series(normalised)
    tokens = _told_tokens(stripped)
    found = {"normalized": normalised, "series": series} | _keys(tokens, F.transform(tokens, lambda t: F.substring(t, 1, PREFIX)))
    return {k: found[k] for k in KEYS}


def with_name_keys(names: DataFrame, raw: str = "raw") -> DataFrame:
    """The table with the columns of name_keys. Each step is a column of its own, which is computed once for each row, however many steps build on it."""
    rows = names.withColumn("normalized", normalise_name(F.col(raw))).withColumn("_text", F.col("normalized"))
    found = []
    for i, p in enumerate(SERIES):
        rest, markers = _series_step(F.col("_text"), p)
        found.append(f"_found{i}")
        rows = rows.withColumns({"_text": rest, found[-1]: markers})
    rows = rows.withColumn("_tokens", _told_tokens(F.trim(F.regexp_replace("_text", r"\s+", " "))))
    rows = rows.withColumn("_prefixes", F.transform("_tokens", lambda t: F.substring(t, 1, PREFIX)))
    keys = _keys(F.col("_tokens"), F.col("_prefixes")) | {"normalized": F.col("normalized"), "series": F.array_join(F.concat(*found), "; ")}
    return rows.select(*(c for c in names.columns if c not in KEYS), *(keys[k].alias(k) for k in KEYS))


def first_letter(c: Column) -> Column:
    return F.upper(F.substring(c, 1, 1))


def folded_letter(c: Column) -> Column:
    return F.translate(first_letter(c), "".join(FOLDED.values()), "".join(k * len(v) for k, v in FOLDED.items()))


def no_letter_first(c: Column) -> Column:
    """Whether the first character has no case."""
    lead = F.substring(c, 1, 1)
    return (F.length(c) > 0) & (F.lower(lead) == F.upper(lead))


def shorten(c: Column, most: int = 250) -> Column:
    return F.when(F.length(c) > most, F.substring(c, 1, most - 1)).otherwise(c)


def bag_of_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(clean_title(c), " ", -1)), " ")


def slug(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    s = F.when(s == "", F.lit("x")).otherwise(s)
    return F.when(F.length(s) > 80, F.concat(F.substring(s, 1, 80), F.lit("-"), F.substring(F.md5(c), 1, 6))).otherwise(s)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def safe_filename(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit("export")).otherwise(s)


def is_clean(raw: Column, key_a: Column) -> Column:
    """Whether a name has a key and starts with a letter."""
    return (key_a != "") & raw.rlike(r"^\s*\p{L}")

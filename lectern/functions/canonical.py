"""Column functions over canonical ids (`mr:MMDD-slug`), labels, names and folded text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_PATTERN = r"\Amr:[0-9]{4}-[a-z0-9-]+\z"
#: Longest day of each month; February has 29, as positions have no year.
DAYS = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
#: What counts as white space at the ends of a text, beyond ASCII too.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Parts of a slug that name nobody.
SLUG_STOP = ["et", "de", "a", "ab", "in", "cum", "socii"]
# Endings of a genitive and what a nominative has instead, the first that fits counts.
ENDINGS = [("ae", "a"), ("ii", "ius"), ("onis", "o"), ("icis", "ix"), ("ntis", "ns")]
# Endings of names, in their turn, and names that no rule gives.
NAME_ENDINGS = [("ae", "a"), ("ii", "ius"), ("onis", "o"), ("oris", "or"), ("icis", "ix"), ("ntis", "ns"), ("etis", "es")]
IRREGULAR = [
    ("fidei", "fides"), ("spei", "spes"), ("caritatis", "caritas"), ("manuelis", "manuel"), ("sosthenis", "sosthenes"),
    ("zenaidis", "zenais"), ("irenes", "irene"), ("aristsei", "aristaeus"), ("socratis", "socrates"), ("epistemis", "episteme"),
]
# Endings of which a slug part may have either form.
VARIANTS = [*ENDINGS, ("is", "es")]
# First parts of a slug that lead a class of unnamed people.
CLASS_LEADS = ["martyres", "fratres", "milites", "virgines", "monachi", "confessores", "sorores", "presbyteri"]
# Governing bodies by scope.
HOLY_SEE = "Dicastery for Divine Worship and the Discipline of the Sacraments"
ITALY = "Conferenza Episcopale Italiana"


@lru_cache(maxsize=1)
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Characters that a compatible decomposition without marks makes one other, these, and those that it makes several.

    Marks come last among the first, with nothing to match: they go. Hangul syllables stay whole.
    """
    one, other, marks, several = [], [], [], {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not plain:
            marks.append(c)
        elif len(plain) > 1:
            several[c] = plain
        elif plain != c:
            one.append(c)
            other.append(plain)
    return "".join(one + marks), "".join(other), several


def unmarked(text: Column) -> Column:
    """The text in compatible decomposition, without combining marks."""
    one, other, several = _decomposed()
    plain = F.translate(text, one, other)
    apart = F.str_to_map(F.lit("\x1e".join(f"{c}\x1f{p}" for c, p in several.items())), F.lit("\x1e"), F.lit("\x1f"))
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(apart, c), c)), "")
    # a look-up a character; a regex class of so many would be searched one by one
    without = F.translate(plain, "".join(several), "")
    return F.when(F.char_length(without) < F.char_length(plain), spelled).otherwise(plain)


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(WHITE))


def right_stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def is_canonical(id_: Column) -> Column:
    return id_.rlike(ID_PATTERN)


def anchor_month(id_: Column) -> Column:
    """The month that a canonical id names, else null."""
    return F.when(is_canonical(id_), F.substring(id_, 4, 2).cast("int"))


def anchor_day(id_: Column) -> Column:
    return F.when(is_canonical(id_), F.substring(id_, 6, 2).cast("int"))


def slug_of(id_: Column) -> Column:
    return F.when(is_canonical(id_), F.regexp_replace(id_, r"\Amr:[0-9]{4}-", ""))


def mmdd(month: Column, day: Column) -> Column:
    return F.when(month.isNotNull() & day.isNotNull(), F.format_string("%02d-%02d", month, day))


def primary_subtag(locale: Column) -> Column:
    return F.lower(F.split(locale, "-")[0])


def pick_locale(query: Column, header: Column) -> Column:
    """The explicit locale, else the first tag of an Accept-Language header."""
    first = F.trim(F.split(F.split(header, ",")[0], ";")[0])
    return F.coalesce(query, F.when(first != "", first))


def governance(scope: Column) -> Column:
    """(governing_body, type, nation) of a scope."""
    body = F.when(scope == "universal", HOLY_SEE).when(scope == "IT", ITALY).otherwise(F.concat(F.lit("Bishops' Conference ("), scope, F.lit(")")))
    kind = F.when(scope == "universal", "dicastery").otherwise("bishops_conference")
    return F.struct(body.alias("governing_body"), kind.alias("type"), F.when(scope != "universal", scope).alias("nation"))


def edition_record(scope: Column, decree: Column, promulgated: Column) -> Column:
    """Struct (scope, promulgation) of an edition: (type, nation) and, where either is known, (decree, date)."""
    where = F.struct(F.when(scope == "universal", "universal").otherwise("national").alias("type"), F.when(scope != "universal", scope).alias("nation"))
    known = F.when(decree.isNotNull() | promulgated.isNotNull(), F.struct(decree.alias("decree"), promulgated.alias("date")))
    return F.struct(where.alias("scope"), known.alias("promulgation"))


def availability(restricted: Column, available: Column, closed: str = "copyrighted texts, a grant is needed", none: str = "registered, no texts attached") -> Column:
    """(status, note): restricted comes before public, public before unavailable. The conditions must not be null."""
    status = F.when(restricted, "restricted-texts").when(available, "public").otherwise("unavailable")
    return F.struct(status.alias("status"), F.when(restricted, closed).when(~available, none).alias("note"))


def cache_class(masked: Column, draft: Column, explicit: Column) -> Column:
    return F.when(masked | draft, "private").when(explicit, "immutable").otherwise("daily")


def sanitized(name: Column) -> Column:
    """A name as part of a branch: other characters become -, leading - and . go."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "-"), r"^[-.]+", "")


def valid_topic(topic: Column) -> Column:
    return topic.rlike(r"\A[a-z0-9][a-z0-9._-]{0,63}\z")


def valid_branch(branch: Column) -> Column:
    return branch.rlike(r"\Acuration/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+\z") & ~F.contains(branch, F.lit(".."))


def valid_edition(id_: Column) -> Column:
    return id_.rlike(r"\A[a-z0-9_]+\z")


def leads_class(id_: Column) -> Column:
    """Whether the first part of the id's slug is a word for a class of people."""
    return F.split(slug_of(id_), "-")[0].isin(CLASS_LEADS)


def deaccented(text: Column) -> Column:
    """Marks stripped, case kept, æ and œ spelled out."""
    plain = unmarked(text)
    for a, b in (("æ", "ae"), ("œ", "oe"), ("Æ", "Ae"), ("Œ", "Oe")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return plain


def _lowered(text: Column) -> Column:
    return F.translate(F.lower(unmarked(text)), "æœ", "ee")


def folded(text: Column) -> Column:
    """Lower case without marks; æ and œ become e, j becomes i, all but a-z and the space a space."""
    return F.regexp_replace(F.translate(_lowered(text), "j", "i"), "[^a-z ]", " ")


def folded_english(text: Column) -> Column:
    """As folded(), and then ae and oe become e."""
    return F.regexp_replace(folded(text), "ae|oe", "e")


def fold_slug(text: Column, j_to_i: bool = False) -> Column:
    """Folded text with - for runs of other letters, none at the ends; j becomes i where asked for."""
    plain = F.translate(_lowered(text), "j", "i") if j_to_i else _lowered(text)
    return F.btrim(F.regexp_replace(plain, "[^a-z]+", "-"), F.lit("-"))


def tokens(folded_text: Column) -> Column:
    """The words of a folded text."""
    return F.filter(F.split(folded_text, " +"), lambda w: w != "")


def signature(folded_text: Column, stop: list[str], cut: int = 6) -> Column:
    """Distinct beginnings of the words of five letters or more that aren't stop words."""
    words = F.filter(tokens(folded_text), lambda w: (F.length(w) >= 5) & ~w.isin(stop))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, cut)))


def slug_parts(slug: Column, stop: list[str]) -> Column:
    """The parts of a slug of four letters or more that aren't stop words or numbers."""
    return F.filter(F.split(slug, "-"), lambda p: (F.length(p) >= 4) & ~p.isin(stop) & ~p.rlike(r"\A[0-9]+\z"))


def slug_stems(slug: Column, stop: list[str], cut: int = 6) -> Column:
    return F.transform(slug_parts(slug, stop), lambda p: F.substring(p, 1, cut))


def lemma_variants(part: Column) -> Column:
    """A slug part and the nominatives that it may be a genitive of."""
    forms = [part]
    for end, other in VARIANTS:
        forms.append(F.when(part.endswith(end) & (F.length(part) > len(end) + 1), F.concat(F.substring(part, F.lit(1), F.length(part) - len(end)), F.lit(other))))
    forms.append(F.when(part.endswith("i") & (F.length(part) > 3), F.concat(F.substring(part, F.lit(1), F.length(part) - 1), F.lit("us"))))
    return F.array_distinct(F.array_compact(F.array(*forms)))


def stem_variants(slug: Column, stop: list[str], cut: int = 6) -> Column:
    """For every part of a slug the distinct stems of its variants, j as i, ae and oe as e."""
    parts = slug_parts(F.translate(slug, "j", "i"), stop)
    return F.transform(parts, lambda p: F.array_distinct(F.transform(lemma_variants(p), lambda v: F.substring(F.regexp_replace(v, "ae|oe", "e"), 1, cut))))


def lemmatized(token: Column, mined: Column, endings: list[tuple[str, str]] = ENDINGS, least_i: int = 5) -> Column:
    """A genitive as a nominative: as it was mined, else by its ending, -i from `least_i` letters on, else the token itself."""
    out = F.when(mined.isNotNull(), mined)
    for end, other in endings:
        out = out.when(token.endswith(end), F.concat(F.substring(token, F.lit(1), F.length(token) - len(end)), F.lit(other)))
    return out.when(token.endswith("i") & (F.length(token) >= least_i), F.concat(F.substring(token, F.lit(1), F.length(token) - 1), F.lit("us"))).otherwise(token)


def lemmatized_name(token: Column, mined: Column) -> Column:
    """A name's genitive as a nominative: by the irregular names, else as lemmatized() with the endings of names."""
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR for x in pair])
    return F.coalesce(F.try_element_at(irregular, token), lemmatized(token, mined, NAME_ENDINGS, 4))


def rejoined(raw: Column) -> Column:
    """Short capitalised words that a scan cut off from the rest of the word, joined to it again."""
    return F.regexp_replace(raw, r"\b([A-Z][a-z]{1,3}) ([a-z]{2,})\b", "$1$2")


def capitalised(raw: Column) -> Column:
    """The folded capitalised words of three letters or more."""
    return F.transform(F.regexp_extract_all(rejoined(raw), F.lit("[A-Z][a-zA-Z]{2,}"), F.lit(0)), lambda w: F.trim(folded(w)))


def fingerprint(*columns: Column) -> Column:
    """A digest of a result's columns, nulls told apart from texts."""
    told = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *told))


def new_id(month: Column, day: Column, persons: Column) -> Column:
    """The id of one person, of a pair, or of the first of three or more and their companions; null without persons."""
    first = F.get(persons, F.lit(0))
    slug = F.when(F.size(persons) >= 3, F.concat(first, F.lit("-et-socii"))).when(F.size(persons) == 2, F.array_join(persons, "-et-")).otherwise(first)
    return F.concat(F.format_string("mr:%02d%02d-", month, day), slug)


def new_subject(persons: Column, marker: Column) -> Column:
    """The subject of new_id(): a title by number, gender and rank of the marker, and the names."""
    first, many = F.get(persons, F.lit(0)), F.size(persons) >= 2
    woman = marker.endswith("arum") | marker.isin("sanctae", "beatae")
    ending = F.when(many, F.when(woman, "ae").otherwise("i")).when(woman | first.endswith("a"), "a").otherwise("us")
    shown = F.transform(persons, lambda p: F.initcap(F.replace(p, F.lit("-"), F.lit(" "))))
    names = F.when(F.size(persons) >= 3, F.concat(F.get(shown, F.lit(0)), F.lit(" et socii"))).when(many, F.array_join(shown, " et ")).otherwise(F.get(shown, F.lit(0)))
    return F.concat(F.when(marker.startswith("beat"), "Beat").otherwise("Sanct"), ending, F.lit(" "), names)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))

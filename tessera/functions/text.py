"""Text functions as Column expressions: folds, name cores, entities, HTML cleaning, small extractors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that the folds replace, and what by.
FOLD_FROM, FOLD_TO = "áàäâãéèëêíìïîóòöôõúùüûñç", "aaaaaeeeeiiiiooooouuuunc"
TITLE_FROM, TITLE_TO = "áàäâéèëêíìïîóòöôúùüûñ", "aaaaeeeeiiiioooouuuun"
UI_FROM, UI_TO = "áàäâéèëêíìïîóòöôúùüû", "aaaaeeeeiiiioooouuuu"
# Words that tell no name from another.
PARTICLES = ("de", "del", "la", "las", "los", "el", "y", "para", "por", "con", "al", "a", "en", "e", "the", "of")
# Words of a post that say when, not which.
POST_PREFIXES = (
    "ex", "exp", "entonces", "actual", "nuevo", "nueva", "nuevos", "antiguo", "antigua", "saliente", "encargado", "encargada",
    "designado", "designada", "electo", "electa", "alto", "alta", "hoy", "futuro", "futura", "candidato", "candidata",
)
# Entities of bodies, in this order; the ampersand comes last, or it would undo the others.
BODY_ENTITIES = (
    ("&#8211;", "–"), ("&#8212;", "—"), ("&#8216;", "‘"), ("&#8217;", "’"), ("&#8220;", "“"), ("&#8221;", "”"), ("&#8230;", "…"),
    ("&#8242;", "′"), ("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"),
    ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"),
)
# Entities of titles, in this order; here the ampersand comes before the angle brackets.
TITLE_ENTITIES = (
    ("&#8211;", "–"), ("&#8212;", "—"), ("&#8216;", "‘"), ("&#8217;", "’"), ("&#8220;", "“"), ("&#8221;", "”"), ("&#8230;", "…"),
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#8242;", "′"),
)
# Tags that end a block, and line breaks.
BLOCK_ENDS = ("</p>", "</div>", "</li>", "</h1>", "</h2>", "</h3>", "</h4>", "</blockquote>", "</figcaption>", "</figure>", "</tr>")
BREAKS = ("<br>", "<br/>", "<br />", "<BR>")


def _spaced(c: Column) -> Column:
    """Everything but letters, digits and blanks becomes a blank; blanks collapse."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def fold(c: Column) -> Column:
    """Comparison form of a name: lower case, accents and tilde off, punctuation to blanks."""
    return _spaced(F.translate(F.lower(c), FOLD_FROM, FOLD_TO))


def title_key(c: Column) -> Column:
    return _spaced(F.translate(F.lower(c), TITLE_FROM, TITLE_TO))


def ui_fold(c: Column) -> Column:
    """Keeps length, tilde and punctuation, so that offsets hold."""
    return F.translate(F.lower(c), UI_FROM, UI_TO)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(fold(c), " "), lambda t: t != "")


def core(c: Column) -> Column:
    """Significant words of a name: no particles, no words of a single byte."""
    return F.filter(_tokens(c), lambda t: (F.octet_length(t) > 1) & ~t.isin(*PARTICLES))


def initials(c: Column) -> Column:
    return F.transform(F.filter(_tokens(c), lambda t: ~t.isin(*PARTICLES)), lambda t: F.substring(t, 1, 1))


def post_core(c: Column) -> Column:
    """Core of a post without what says when; a glued ex goes where four bytes or more are left."""
    kept = F.filter(core(c), lambda t: ~t.isin(*POST_PREFIXES))
    return F.transform(kept, lambda t: F.when(t.startswith("ex") & (F.octet_length(t) >= 6), F.substring(t, 3, 1 << 20)).otherwise(t))


def pair_key(a: Column, b: Column) -> Column:
    """Key of an unordered pair of names."""
    return F.concat_ws("|", F.array_sort(F.array(fold(a), fold(b))))


def decode_entities(c: Column, entities: tuple[tuple[str, str], ...] = BODY_ENTITIES) -> Column:
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), entities, c)


def decode_title(c: Column) -> Column:
    return F.trim(decode_entities(c, TITLE_ENTITIES))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long")


# Shortcodes known by name alone.
SHORTCODES = ("caption", "gallery", "embed", "audio", "video", "playlist", "wp_caption", "contact-form", "gravityform", "et_pb_section", "vc_row", "vc_column")


def shortcodes(c: Column) -> Column:
    """Sorted names of bracketed codes: those with an attribute, a closing mate or a known name; other brackets are prose."""
    name = lambda m: F.regexp_extract(m, r"^\[/*([A-Za-z0-9_-]+)", 1)
    marks = F.regexp_extract_all(c, F.lit(r"\[[^\]]{0,199}\]"), F.lit(0))
    closed = F.transform(F.filter(marks, lambda m: m.startswith("[/")), name)
    sure = F.filter(marks, lambda m: ~m.startswith("[/") & (F.contains(m, F.lit("=")) | F.array_contains(closed, name(m)) | F.lower(name(m)).isin(*SHORTCODES)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(sure, name), lambda n: n != "")))


def without_shortcodes(c: Column, names: Column) -> Column:
    """The text without the marks of these codes; what they wrap stays."""
    mark = F.concat(F.lit(r"\[/*(?:"), F.array_join(names, "|"), F.lit(r")(?:[^\]A-Za-z0-9_-][^\]]{0,197})?\]"))
    return F.when(F.size(names) > 0, F.regexp_replace(c, mark, F.lit(" "))).otherwise(c)


def clean_html(c: Column) -> Column:
    """HTML to paragraphs joined by blank lines.

    Scripts, styles and comments go (unterminated ones with all that follows), and the marks of shortcodes; breaks end lines,
    block ends end paragraphs, other tags go, entities are decoded, blanks collapse and empty paragraphs go.
    """
    names = shortcodes(c)
    for name in ("script", "style"):
        c = F.regexp_replace(c, rf"(?s)<{name}.*?(</{name}>|\z)", " ")
    c = without_shortcodes(c, names)
    c = F.regexp_replace(c, r"(?s)<!--.*?(-->|\z)", " ")
    c = reduce(lambda acc, t: F.replace(acc, F.lit(t), F.lit("\n")), BREAKS, c)
    c = reduce(lambda acc, t: F.replace(acc, F.lit(t), F.lit("\n\n")), BLOCK_ENDS, c)
    c = decode_entities(F.regexp_replace(c, r"(?s)<[^>]*(>|\z)", ""))
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    parts = F.transform(F.split(F.array_join(lines, "\n"), "\n\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def has_blocks(c: Column) -> Column:
    return F.contains(c, F.lit("wp-block-")) | F.contains(c, F.lit("<!-- wp:"))


def unbalanced(c: Column) -> Column:
    """True if tags are opened and not closed once scripts, styles and comments are out."""
    for name in ("script", "style"):
        c = F.regexp_replace(c, rf"(?s)<{name}.*?(</{name}>|\z)", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?(-->|\z)", " ")
    # Only the first `>` after an opening counts.
    closed = F.regexp_replace(c, r"<[^<>]*>", "")
    return F.contains(closed, F.lit("<"))


def broken(c: Column) -> Column:
    """True for a body with an unbalanced tag or any shortcode."""
    return unbalanced(c) | (F.size(shortcodes(c)) > 0)


def url_key(c: Column) -> Column:
    """Lower case, https, www and no closing slash."""
    c = F.regexp_replace(F.lower(F.trim(c)), "^http://", "https://")
    return F.regexp_replace(F.regexp_replace(c, r"^https://(www\.)?", "https://www."), "/+$", "")


def url_section(c: Column) -> Column:
    """First path segment, `raiz` for none or one that starts with a digit."""
    part = F.regexp_extract(c, r"^[a-zA-Z]+://[^/]+/([^/?#]*)", 1)
    return F.when((part == "") | part.rlike("^[0-9]"), F.lit("raiz")).otherwise(part)


def site_address(c: Column) -> Column:
    """A typed site address with a scheme and without query, fragment, admin and interface paths."""
    c = F.trim(c)
    c = F.when(c.rlike("^[a-zA-Z]+://"), c).otherwise(F.concat(F.lit("https://"), c))
    c = F.regexp_replace(c, r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(c, r"/wp-(json|admin)(/.*)?$", ""), "/+$", "")


def origin(c: Column) -> Column:
    return F.regexp_extract(c, r"^([a-zA-Z]+://[^/?#]+)", 1)


def markdown_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(c, r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1")


def snippet(text: Column, needle: Column, around: int = 260) -> Column:
    """`around` characters either side of the first occurrence, with an ellipsis where the text goes on; null without one."""
    at = F.instr(text, needle)
    start = F.greatest(at - around, F.lit(1))
    stop = F.least(at + F.length(needle) + around - 1, F.length(text))
    body = F.substr(text, start, stop - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(stop < F.length(text), "…").otherwise("")))


# Words that hint that a relation is over, or yet to come.
PAST_WORDS = (
    r"ex|exministr\p{L}*|expresident\p{L}*|exgobernador\p{L}*|exalcald\p{L}*|exsenador\p{L}*|exdirector\p{L}*|"
    r"entonces|otrora|fue|había sido|salient\p{L}+"
)
FUTURE_WORDS = r"asumirá|será|ocupará|reemplazará|entrante|electo|electa|designad\p{L}+|nombrad\p{L}+ para|próximo|próxima"


def validity_hint(c: Column) -> Column:
    """`pasada`, `futura` or null by the words around a relation."""
    at = lambda words: c.rlike(rf"(?iu)(?<!\p{{L}})(?:{words})(?!\p{{L}})")
    return F.when(at(PAST_WORDS), "pasada").when(at(FUTURE_WORDS), "futura")


def minutes_seconds(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), F.floor(seconds % 60).cast("long"))


def duration_label(seconds: Column) -> Column:
    """Seconds below 90, minutes below 90 minutes, hours below two days, then days."""
    whole = lambda unit: F.round(seconds / unit).cast("long").cast("string")
    return (
        F.when(seconds < 90, F.concat(whole(1), F.lit(" s")))
        .when(seconds < 5400, F.concat(whole(60), F.lit(" min")))
        .when(seconds < 48 * 3600, F.concat(whole(3600), F.lit(" h")))
        .otherwise(F.concat(whole(86400), F.lit(" días")))
    )


def year_label(first: Column, last: Column) -> Column:
    return F.when(first.isNull() | last.isNull(), "").when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def generic(c: Column) -> Column:
    """True for a text without capitals or digits."""
    return ~c.rlike(r"[\p{Lu}\p{Nd}]")


def content_stamp(c: Column, prefix: str = "v") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 12))


def plausible_year(c: Column) -> Column:
    """The first four characters as a year from 1990 to 2100, else null."""
    y = F.substring(c, 1, 4).try_cast("int")
    return F.when(y.between(1990, 2100), y)


def identifier(c: Column) -> Column:
    """Only ASCII letters, digits, `_` and `-` stay."""
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "")


def host(c: Column) -> Column:
    """Host of an address: no scheme, path, user, port or leading www."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.-]*://", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[/?#].*$", ""), r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(c, r":\d+$", ""), r"^www\.", "")


def length_between(c: Column, least: int = 300, most: int = 1200) -> Column:
    """True for texts of `least` to `most` words."""
    return word_count(c).between(least, most)


def description(text: Column, tipo: Column) -> Column:
    """True for a post or organisation that is described, not named: no later word over three letters is capitalised."""
    words = F.slice(F.split(F.trim(text), r"\s+"), 2, 1 << 20)
    named = F.exists(words, lambda w: (F.length(w) > 3) & (F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1))) & ~F.lower(w).isin("de", "del", "la", "el", "los", "las", "y", "en", "para"))
    of = F.trim(text).rlike(r"(?i)\bde\b")
    return tipo.isin("cargo", "organizacion") & (F.length(F.trim(text)) >= 4) & (~named | ((tipo == "cargo") & of))


def label_key(label: Column, labels: dict[str, str]) -> Column:
    """The key whose wording a model's label is, in lower case; an unknown label is its own key."""
    low = F.lower(label)
    keys = F.create_map(*(x for k, v in labels.items() for x in (F.lit(v), F.lit(k))))
    return F.coalesce(F.element_at(keys, low), low)


def highlighted(text: Column, names: list[str], mark: str = "**") -> Column:
    """The text with every one of the names marked, longer names first; names of one letter are left alone."""
    import re

    found = sorted((n for n in names if len(n) > 1), key=lambda n: (-len(n), n))
    return F.regexp_replace(text, "(" + "|".join(map(re.escape, found)) + ")", f"{mark}$1{mark}") if found else text


def clamped(at: Column, step: Column, last: Column) -> Column:
    """The place `step` further on, held between 0 and `last`."""
    return F.greatest(F.lit(0), F.least(last, at + step))


def name_variants(c: Column) -> Column:
    """Ways a name may be written, in order of preference: whole, its significant words, its last word of four letters or more."""
    words = core(c)
    last = F.try_element_at(words, F.lit(-1))
    return F.array_distinct(F.array_compact(F.array(fold(c), F.nullif(F.array_join(words, " "), F.lit("")), F.when(F.length(last) >= 4, last))))


def located(text: Column, needle: Column) -> Column:
    """Where a model's wording stands in a text: struct (ini, fin, intento), as it is (0), case aside (1) or accents aside too (2); null if nowhere."""
    tries = [F.instr(text, needle), F.instr(F.lower(text), F.lower(needle)), F.instr(ui_fold(text), ui_fold(needle))]
    found = lambda i: F.when(tries[i] > 0, F.struct((tries[i] - 1).alias("ini"), (tries[i] - 1 + F.length(needle)).alias("fin"), F.lit(i).alias("intento")))
    return F.when(F.length(needle) > 0, F.coalesce(*(found(i) for i in range(3))))

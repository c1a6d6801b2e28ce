"""Scalar text functions: Column in, Column out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\r\\f]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def handle_case(c, lower: bool = True) -> Column:
    """Null to '', lower-cased on demand."""
    x = F.coalesce(col(c), F.lit(""))
    return F.lower(x) if lower else x


def words(c) -> Column:
    """Words between blanks, without empty ones."""
    return F.array_remove(F.split(col(c), BLANK), "")


def tokens(c) -> Column:
    return words(handle_case(c))


def normalize_space(c) -> Column:
    return F.array_join(words(F.coalesce(col(c), F.lit(""))), " ")


def split_single_blanks(c) -> Column:
    """Split at each white-space character, so that runs give empty words."""
    return F.split(col(c), "[ \\t\\n\\r\\f]", -1)


def truncate_words(c, k: int) -> Column:
    return F.array_join(F.slice(words(c), 1, k), " ")


def truncate_chars(c, k: int) -> Column:
    return F.substring(col(c), 1, k)


def remove_words(c, stop: list[str]) -> Column:
    """Drop the listed words, whatever their case."""
    drop = F.array(*map(F.lit, sorted({w.lower() for w in stop})))
    return F.array_join(F.filter(words(c), lambda x: ~F.array_contains(drop, F.lower(x))), " ")


#: The reserved operators of the query syntax.
OPERATORS = ("OR", "AND", "NOT", "TO")


def remove_operators(c) -> Column:
    return F.array_join(F.filter(words(c), lambda x: ~x.isin(*OPERATORS)), " ")


def remove_punct(c) -> Column:
    """Runs of ASCII punctuation become a space."""
    return F.regexp_replace(col(c), r"[!-/:-@\[-`{-~]+", " ")


def index_no_case(word: str, c) -> Column:
    """Place of a word in an array from 0, whatever its case; -1 if absent."""
    return F.array_position(F.transform(col(c), lambda x: F.lower(x)), word.lower()) - 1


def has_non_ascii(c) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(r"[^\x00-\x7F]")


def remove_bad_unicode(c) -> Column:
    """Only U+0020 to U+00FC, tabs and line ends stay."""
    return F.regexp_replace(col(c), "[^\\u0020-\\u00FC\\t\\n\\r]", "")


def clean_up(c) -> Column:
    """Line ends unified, ASCII only, repeated sentence marks and line ends collapsed, breaks to
    line ends, tags to spaces."""
    x = F.regexp_replace(col(c), "\\r", "")
    x = F.regexp_replace(x, "[\\u2018\\u2019]", "'")
    x = F.regexp_replace(x, "[^\\x00-\\x7F]", " ")
    x = F.regexp_replace(x, "([?!.:])[?!.:]+", "$1")
    x = F.regexp_replace(x, "(?i)<br */?>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", " ")
    return F.regexp_replace(x, "\\n+", "\n")


def remove_plain_tags(c) -> Column:
    """Tags without attributes."""
    return F.regexp_replace(col(c), "</?[a-zA-Z]+/?>", " ")


def newlines_to_spaces(c) -> Column:
    return F.regexp_replace(col(c), "[\\n\\r]+", " ")


def tabs_to_spaces(c) -> Column:
    return F.regexp_replace(col(c), "\\t", " ")


def is_alpha_num(c) -> Column:
    """A word of letters, digits, -, _ and . in any script."""
    return F.coalesce(col(c), F.lit("")).rlike(r"^[\p{L}\p{N}_.\-]+$")


def sentences(c) -> Column:
    """Pieces that end in . ! or ? before a blank."""
    return F.filter(F.transform(F.split(col(c), "(?<=[.!?])[ \\t\\n\\r\\f]+"), lambda x: F.trim(x)), lambda x: x != "")


def pretokenize_url(c) -> Column:
    """Decoded, without scheme and www., punctuation to spaces."""
    x = F.try_url_decode(col(c))
    x = F.regexp_replace(F.coalesce(x, col(c)), r"^(https?://|www\.)+", "")
    return F.trim(F.regexp_replace(remove_punct(x), " +", " "))


def normalize_url(c) -> Column:
    """Without user, query, fragment and a lone slash as path."""
    x = F.regexp_replace(col(c), "[?#].*$", "")
    x = F.regexp_replace(x, "^([a-zA-Z]+://)[^/@]*@", "$1")
    return F.regexp_replace(x, "^([a-zA-Z]+://[^/]+)/$", "$1")


def _url_part(c, k: int) -> Column:
    """Scheme, authority, path, query or fragment (2, 4, 5, 7, 9), the last three with nothing before."""
    return F.regexp_extract(col(c), r"^(([a-zA-Z][a-zA-Z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?", k)


def without_dots(path) -> Column:
    """A path with its . and .. segments carried out."""
    x = col(path)
    parts = F.split(F.regexp_replace(x, "^/", ""), "/", -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.when(x.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def resolved_url(ref, base) -> Column:
    """A reference within a page at an absolute URL, by the rules of RFC 3986."""
    ref, base = F.trim(col(ref)), col(base)
    scheme, host, path = (_url_part(ref, k) for k in (2, 4, 5))
    has_host, has_query = ref.rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:)?//"), ref.rlike(r"^[^#]*\?")
    base_path, base_host = _url_part(base, 5), base.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")
    merged = F.when(base_host & (base_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(base_path, "^(.*/)?", 0), path))
    own = (scheme != "") | has_host
    to_path = F.when(own | path.startswith("/"), without_dots(path)).when(path == "", base_path).otherwise(without_dots(merged))
    query = F.when(has_query, _url_part(ref, 6)).when(~own & (path == ""), _url_part(base, 6)).otherwise("")
    to_scheme = F.when(scheme != "", _url_part(ref, 1)).otherwise(_url_part(base, 1))
    to_host = F.when(own, _url_part(ref, 3)).otherwise(_url_part(base, 3))
    return F.concat(to_scheme, to_host, to_path, query, _url_part(ref, 8))


def url_words(c) -> Column:
    """The words of a URL's host and path, lower-cased; what is escaped is decoded."""
    x = normalize_url(c)
    x = F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    return F.array_remove(F.split(F.lower(F.regexp_replace(x, "^[a-zA-Z][a-zA-Z0-9+.-]*://(www\\.)?", "")), r"[^\p{L}\p{N}]+"), "")


#: Coarse classes of Penn part-of-speech tags; tags may be in lower case as well.
POS_CLASS = {
    "JJ": "A", "JJR": "A", "JJS": "A",
    "NN": "N", "NNS": "N", "NNP": "N", "NNPS": "N",
    "RB": "R", "RBR": "R", "RBS": "R",
    "VB": "V", "VBD": "V", "VBG": "V", "VBN": "V", "VBP": "V", "VBZ": "V",
}
# End of fixed values.


def pos_class(c) -> Column:
    table = F.create_map(*(F.lit(x) for pair in POS_CLASS.items() for x in pair))
    same = (col(c) == F.upper(col(c))) | (col(c) == F.lower(col(c)))
    return F.when(same, F.try_element_at(table, F.upper(col(c))))


def strip_html(c) -> Column:
    """Text of a page: scripts, styles, comments and the title dropped, block tags to line ends, other
    tags to nothing, references decoded (see ``html``)."""
    from ranklode.functions.html import page

    return page(c)["text"]


def decode_entities(x: Column) -> Column:
    for name, value in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(value))
    return x


def html_title(c) -> Column:
    from ranklode.functions.html import page

    return page(c)["title"]


def html_links(c) -> Column:
    """Array of (href, anchor text): any quotes, references decoded, frames too."""
    from ranklode.functions.html import page

    return page(c)["links"]


def anchor_text(c) -> Column:
    """The texts of all links, joined by blanks."""
    return F.array_join(F.transform(html_links(c), lambda a: a["text"]), " ")


def json_attribute(c, name: str, kind: str = "string", default=None) -> Column:
    """A top-level attribute of a JSON object as ``kind``; where it is absent or of another kind, the
    default."""
    x = F.get_json_object(col(c), f"$.{name}").try_cast(kind)
    return x if default is None else F.coalesce(x, F.lit(default).cast(kind))

"""Text and URL functions as Column expressions."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once and standing once in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(c: Column) -> Column:
    """Runs of white space, as Unicode has it, become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def word_tokens(c: Column) -> Column:
    """Lower-cased words of two characters or more."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def word_ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """All runs of lo to hi tokens of an array, joined by one space."""
    return _runs(tokens, lo, hi, " ")


def char_ngrams(text: Column, lo: int, hi: int) -> Column:
    """All substrings of lo to hi characters of a text, lower-cased."""
    low = F.lower(text)
    return _runs(F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, "")), lo, hi, "")


def _bind(value: Column, use) -> Column:
    """An array expression made of another array, which is worked out once."""
    return F.flatten(F.transform(F.array(value), use))


def _runs(parts: Column, lo: int, hi: int, glue: str) -> Column:
    """Runs of neighbouring parts: each length is the one before, paired with the parts further on."""
    none = F.array().cast("array<string>")

    def grow(t: Column, run: Column, n: int) -> Column:
        here = run if n >= lo else none
        if n == hi:
            return here
        # the runs that another part follows, each with that part
        joined = F.zip_with(F.slice(run, 1, F.size(t) - n), F.slice(t, n + 1, F.size(t)), lambda a, b: F.concat(a, F.lit(glue), b) if glue else F.concat(a, b))
        longer = F.when(F.size(t) <= n, none).otherwise(joined)
        return F.concat(here, _bind(longer, lambda r: grow(t, r, n + 1)))

    return _bind(parts, lambda t: grow(t, t, 1))


def stop_filter(tokens: Column, stop: tuple[str, ...]) -> Column:
    """Tokens that are not stop words; repeats stay."""
    words = F.array(*map(F.lit, stop))
    return F.filter(tokens, lambda x: ~F.array_contains(words, x))


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles], F.lit(False))


def authority(url: Column) -> Column:
    """Host and port; also of URLs that a strict parser refuses."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit(""))


def percent_quote(c: Column) -> Column:
    """Percent-encode for a path: letters, digits and ``_.-~/`` stay."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def join_item(title: Column, snippet: Column) -> Column:
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(snippet, F.lit("")))


def resolve_redirect(url: Column, host: str, param: str = "url", path: str = "") -> Column:
    """The target inside a redirect link of a host's script: hex, else base64, of a text with a URL in a parameter.
    Other URLs, and parameters that hold none, stay as they are."""
    given = F.regexp_extract(url, r"[?&]" + param + "=([^&#]*)", 1)
    raw = F.coalesce(F.try_url_decode(given), given)
    # a target ends at white space, quotes and angle brackets
    find = lambda b: F.nullif(F.regexp_extract(F.decode(b, "UTF-8"), r"(https?://[^\s\"'<>\x00-\x20]+)", 1), F.lit(""))
    hexed = F.when(raw.rlike("^([0-9a-fA-F]{2})+$"), find(F.unhex(raw)))
    based = F.when(raw.rlike("^[A-Za-z0-9+/]+=*$"), find(F.try_to_binary(F.rpad(F.rtrim(raw, F.lit("=")), F.ceil(F.length(F.rtrim(raw, F.lit("="))) / 4).cast("int") * 4, F.lit("=")), F.lit("base64"))))
    here = url.contains(host) & F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).contains(path)
    return F.when(here & (given != ""), F.coalesce(F.rtrim(hexed, F.lit(")")), F.rtrim(based, F.lit(")")), url)).otherwise(url)


# Fixed values: signs between the steps of a breadcrumb, and what a step may hold besides letters,
# digits and white space; the last letters of a domain glued to a URL are lower-case ones.
CRUMB_SIGNS = "›»>"
CRUMB_MARKS = "_-.#@&?=%!+"
LABEL_ENDS = ":：-—–"


def clean_title(c: Column, ad_labels: tuple[str, ...] = ()) -> Column:
    """Decode character references, strip an advertising label, a domain glued before a URL, and trailing
    breadcrumbs; a title that is then a URL becomes its host, and one that would be empty stays."""
    one_of = lambda signs: "[" + "".join("\\" + x for x in signs) + "]"
    label = r"(?iU)^\s*(?:" + "|".join(ad_labels) + r")\s*" + one_of(LABEL_ENDS) + r"\s*"
    step = r"(?:[\w\s]|" + one_of(CRUMB_MARKS) + ")++"
    crumbs = r"(?U)\s*+(?:" + one_of(CRUMB_SIGNS) + step + ")++$"

    def stripped(t: Column) -> Column:
        s = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)^[\w.-]+\.[a-z]{2,}(?=https?://)", ""), crumbs, ""))
        return let(s, lambda s: F.when(s == "", F.trim(t)).when(s.startswith("http"), F.coalesce(F.nullif(authority(s), F.lit("")), s)).otherwise(s))

    decoded = html_unescape(c)
    return F.when(c.isNull() | (c == ""), c).otherwise(let(F.regexp_replace(decoded, label, "") if ad_labels else decoded, stripped))


_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def resolve_url(href: Column, base: Column) -> Column:
    """A reference resolved against a page's URL; an empty reference stays empty, one that names a host or
    another scheme stays as it is."""
    names = ("scheme", "host", "path", "query", "fragment")
    parts = lambda c: F.struct(*[F.regexp_extract(c, r"(?s)" + _PARTS, i + 1).alias(n) for i, n in enumerate(names)])
    none = F.array().cast("array<string>")
    climb = lambda done, s: F.when(s == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    def walked(whole: Column) -> Column:
        """A path from the root without steps up or in place."""
        def join(steps: Column) -> Column:
            done = F.aggregate(steps, none, climb)
            return F.concat(F.lit("/"), F.array_join(F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done), "/"))

        return let(F.split(F.substring(whole, 2, 1 << 30), "/", -1), join)

    def joined(x: Column) -> Column:
        r, b = x["r"], x["b"]
        folder = F.when(b["path"] == "", F.lit("/")).otherwise(F.regexp_replace(b["path"], "[^/]*$", ""))
        whole = F.when(r["path"].startswith("/"), r["path"]).otherwise(F.regexp_replace(F.concat(folder, r["path"]), "/{2,}", "/"))
        new_path = F.when(r["path"] == "", b["path"]).otherwise(walked(whole))
        new_query = F.when((r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        tail = F.concat(let(new_query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")), F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise(""))
        return F.when((r["scheme"] != "") & ((F.lower(r["scheme"]) != F.lower(b["scheme"])) | (r["host"] != "")), href).otherwise(F.concat(b["scheme"], F.lit("://"), b["host"], new_path, tail))

    given = F.coalesce(href, F.lit(""))
    return (
        F.when((given == "") | base.isNull() | (base == ""), given)
        .when(given.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)" + _PARTS, 1), F.lit(":"), given))
        .otherwise(let(F.struct(parts(href).alias("r"), parts(base).alias("b")), joined))
    )


def _numbered() -> dict[int, str]:
    """What a numeric reference stands for where that isn't its own code point: C1 controls by the Windows
    code page, nothing for code points that are no characters."""
    out = {0: "\ufffd", 0x0D: "\r"}
    out |= {n: "" for n in (*range(0x1, 0x9), 0xB, *range(0xE, 0x20), 0x7F, *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF)))}
    for n in range(0x80, 0xA0):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[n] = chr(n)
    return out


def html_unescape(c: Column) -> Column:
    """Character references of HTML decoded: named ones, also old ones without a semicolon, and numeric ones."""
    # one literal, which the optimizer folds into a constant map: thousands of literals would slow every rule down
    table = lambda d: F.from_json(F.lit(json.dumps({str(k): v for k, v in d.items()})), "map<string,string>")
    ended, open_ended = (table({k: v for k, v in html5.items() if k.endswith(";") == e}) for e in (True, False))
    numbered = table(_numbered())
    pieces = F.regexp_extract_all(c, F.lit(r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"), F.lit(0))

    def number(s: Column) -> Column:
        hexed = F.substring(s, 3, 1).isin("x", "X")
        digits = F.regexp_extract(s, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
        small = F.when(F.length(digits) <= 8, digits).otherwise("110000")
        n = F.when(F.length(digits) > 8, 0x110000).when(digits == "", 0).when(hexed, F.conv(small, 16, 10)).otherwise(small).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(numbered, n.cast("string")), F.when(((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF), "\ufffd").otherwise(char))

    def name(s: Column) -> Column:
        # names that may lack their semicolon have two to six letters
        short = [F.when(F.length(s) > k, F.concat(F.try_element_at(open_ended, F.substring(s, 2, k)), F.substring(s, k + 2, 64))) for k in range(6, 1, -1)]
        return F.coalesce(F.when(s.endswith(";"), F.try_element_at(ended, F.substring(s, 2, 64))), *short, s)

    piece = lambda s: F.when(s.rlike("^&#[0-9]|^&#[xX][0-9a-fA-F]"), number(s)).when(s.startswith("&") & (F.length(s) > 1), name(s)).otherwise(s)
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(c)

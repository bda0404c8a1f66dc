"""Text functions of the search, as Column expressions; a few also in Python for one query on the driver."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words dropped from a query unless it has no others.
STOPWORDS = (
    "a about an and are as at be can did do find for from had has have how i in is it me my of on or our save saved "
    "show that the this to was we what when where which who why with you your"
).split()
MAX_TERMS = 16
SHORT_CHARS = 300

#: Letters and numbers (Alphabetic or of category N), and Unicode white space.
ALNUM, SPACE = r"\p{IsAlphabetic}\p{N}", r"\p{IsWhite_Space}"
_PIECE = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_WORD = regex.compile(r"\P{White_Space}+")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0))


def pieces(text: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{ALNUM}]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters (category L) and numbers (category N), unstemmed."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: Column) -> Column:
    """A query's terms, in order: a typed word's pieces joined by spaces (a phrase if several)."""
    found = F.array_distinct(F.filter(F.transform(words(query), lambda w: F.array_join(pieces(w), " ")), lambda t: t != ""))
    telling = F.filter(found, lambda t: ~t.isin(STOPWORDS))
    return F.slice(F.when(F.size(telling) > 0, telling).otherwise(found), 1, MAX_TERMS)


def chosen(terms: Column, mask: Column) -> Column:
    """The terms whose places are set in ``mask``, in order."""
    return F.filter(terms, lambda t, i: F.getbit(mask, i) == 1)


def typed_forms(query: Column) -> Column:
    """Term to the word as typed, without outer punctuation; of several spellings the last."""
    shown = lambda w: F.regexp_replace(w, rf"^[^{ALNUM}]+|[^{ALNUM}]+$", "")
    pairs = F.filter(F.transform(words(query), lambda w: F.struct(F.array_join(pieces(w), " ").alias("term"), shown(w).alias("typed"))), lambda p: p.term != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, 2_000_000), lambda q: q.term == p.term))
    return F.map_from_entries(last)


def terms_of(query: str) -> list[str]:
    """``query_terms`` of one query on the driver."""
    found = dict.fromkeys(t for w in _WORD.findall(query) if (t := " ".join(p.lower() for p in _PIECE.findall(w))))
    return ([t for t in found if t not in STOPWORDS] or list(found))[:MAX_TERMS]


def typed_of(query: str) -> dict[str, str]:
    found = {}
    for w in _WORD.findall(query):
        if parts := list(_PIECE.finditer(w)):
            found[" ".join(p[0].lower() for p in parts)] = w[parts[0].start() : parts[-1].end()]
    return found


def shorten(text: Column, limit: int = SHORT_CHARS) -> Column:
    """White space collapsed; beyond ``limit`` characters cut at the last space and marked with an ellipsis."""
    flat = F.array_join(words(text), " ")
    cut = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, " [^ ]*$", ""), F.lit("…")))


def plural_stem(term: Column) -> Column:
    """Without one final ``s`` if three bytes remain."""
    return F.when(F.endswith(term, F.lit("s")) & (F.octet_length(term) >= 4), F.substring(term, F.lit(1), F.length(term) - 1)).otherwise(term)


def name_terms(terms: Column, text: Column) -> Column:
    """The terms that a name or title has: a word starting with the term's stem, or for a phrase its words in a row."""
    own = pieces(text)
    joined = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))

    def has(t):
        return F.when(F.instr(t, " ") > 0, F.contains(joined, F.concat(F.lit(" "), t, F.lit(" ")))).otherwise(F.exists(own, lambda w: F.startswith(w, plural_stem(t))))

    return F.filter(terms, has)


def name_prefilter(terms: Column, filename: Column, title: Column) -> Column:
    """Some stemmed term occurs anywhere in the ASCII-lower-cased name and title."""
    text = ascii_lower(F.concat(filename, F.lit(" "), F.coalesce(title, F.lit(""))))
    return F.exists(terms, lambda t: F.contains(text, plural_stem(t)))


def contains_name(filename: Column, part: str) -> Column:
    return F.contains(ascii_lower(filename), F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in part)))


def quoted_list(terms: Column, typed: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit("“"), F.coalesce(F.try_element_at(typed, t), t), F.lit("”"))), ", ")


def match_reasons(semantic: Column, keyword_terms: Column, name_terms_: Column, typed: Column) -> Column:
    """Why a file matched; a null signal gives no reason."""
    return F.filter(
        F.array(
            F.when(semantic.isNotNull(), F.lit("Similar in meaning")),
            F.when(keyword_terms.isNotNull(), F.concat(F.lit("Mentions "), quoted_list(keyword_terms, typed))),
            F.when(name_terms_.isNotNull(), F.concat(F.lit("File name or title matches "), quoted_list(name_terms_, typed))),
        ),
        lambda r: r.isNotNull(),
    )


def relevance_label(relevance: Column) -> Column:
    return F.when(relevance >= 0.7, "Strong match").when(relevance >= 0.4, "Good match").otherwise("Partial match")


def format_bytes(size: Column) -> Column:
    out = F.concat(F.format_string("%.1f", size / F.lit(float(1 << 40))), F.lit(" TB"))
    for unit, power in (("GB", 30), ("MB", 20), ("KB", 10)):
        out = F.when(size < (1 << power + 10), F.concat(F.format_string("%.1f", size / F.lit(float(1 << power))), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def format_count(count: Column) -> Column:
    return F.format_number(count, 0)


def plural(count: Column, singular: str, many: str | None = None) -> Column:
    return F.concat(format_count(count), F.lit(" "), F.when(count == 1, singular).otherwise(many or f"{singular}s"))


def format_date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "MMM d, y"), F.lit("—"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def display_name(path: Column) -> Column:
    """Last component, or the whole path if that is empty."""
    return F.coalesce(F.nullif(file_name(F.regexp_replace(path, r"(?<=.)/+$", "")), F.lit("")), path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def file_kind(path: Column) -> Column:
    """pdf, text, markdown, docx or image by extension; null if not supported."""
    ext = extension(path)
    return F.when(ext == "pdf", "pdf").when(ext == "txt", "text").when(ext.isin("md", "markdown"), "markdown").when(ext == "docx", "docx").when(ext.isin("png", "jpg", "jpeg", "webp"), "image")


def mime_type(ext: Column) -> Column:
    named = {"pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
    out = F.lit("application/octet-stream")
    for k, v in named.items():
        out = F.when(F.lower(ext) == k, v).otherwise(out)
    return out


def under(path: Column, root: Column) -> Column:
    """Whether ``path`` is ``root`` or inside it, by whole components."""
    bare = F.regexp_replace(root, r"(?<=.)/+$", "")
    return (path == bare) | F.startswith(path, F.when(F.endswith(bare, F.lit("/")), bare).otherwise(F.concat(bare, F.lit("/"))))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def markdown_title(text: Column) -> Column:
    """The first line that starts with ``# ``, trimmed; null if blank or missing."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?md)^# (.*)$", 1), rf"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


def word_count(pages: Column) -> Column:
    return F.aggregate(pages, F.lit(0), lambda n, p: n + F.size(words(p.text)))


def page_count(pages: Column) -> Column:
    """Null unless some page is numbered; else all pages, blank ones too."""
    return F.when(F.exists(pages, lambda p: p.number.isNotNull()), F.size(pages))


def unix_millis(at: Column) -> Column:
    ms = F.unix_millis(at)
    return F.when(ms >= 0, ms)


def tidy_pdf(text: Column) -> Column:
    """Lines without trailing white space, blank runs collapsed to one line, the whole trimmed."""
    lines = F.regexp_replace(text, rf"[\p{{IsWhite_Space}}&&[^\n]]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), rf"^{SPACE}+|{SPACE}+$", "")


def index_summary(files: Column, read: Column, failed: Column) -> Column:
    """What the index holds of a folder."""
    part = lambda n, words: F.when(n > 0, F.concat(format_count(n), F.lit(words)))
    return F.array_join(F.filter(F.array(plural(files, "file"), part(read, " read"), part(failed, " couldn't be read")), lambda p: p.isNotNull()), " · ")


def scan_summary(state: Column, found: Column, processed: Column, read: Column, to_read: Column, embedded: Column, to_embed: Column, error: Column, files: Column, files_read: Column, files_failed: Column) -> Column:
    """One line on a folder: the step that its scan is at, otherwise what the index holds. The sentences."""
    of = lambda verb, n, total, what: F.concat(F.lit(f"{verb} "), format_count(n), F.lit(" of "), plural(total, what))
    return (
        F.when(state == "discovering", F.concat(F.lit("Looking for files… "), plural(found, "file"), F.lit(" found")))
        .when(state == "hashing", of("Checking", processed, found, "file"))
        .when(state == "reading", of("Reading", read, to_read, "document"))
        .when(state == "embedding", of("Understanding", embedded, to_embed, "passage"))
        .when(state == "failed", F.coalesce(error, F.lit("Scanning failed.")))
        .when(state.isNotNull() | (files > 0), index_summary(files, files_read, files_failed))
        .otherwise("Waiting to scan")
    )


def scan_percent(state: Column, found: Column, processed: Column, read: Column, to_read: Column, embedded: Column, to_embed: Column) -> Column:
    """0 to 100 of the step that runs; null while its size is not known."""
    share = lambda n, total: F.when(total > 0, n / F.nullif(total, F.lit(0)) * 100)
    return F.when(state == "done", F.lit(100.0)).when(state == "hashing", share(processed, found)).when(state == "reading", share(read, to_read)).when(state == "embedding", share(embedded, to_embed))

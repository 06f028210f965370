"""Scalar functions as Spark columns: built-in expressions only, so they stay in generated code.

Words are runs without white space in the ASCII sense; texts with other white
space can be normalised first with :func:`normalize_ws`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel import cells

from .scalars import BLOCKED_SCHEMES, DATA_IMAGES, FILTERED_TAGS

# Media types by extension; the first extension of a type is its own.
MIME = {
    "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "json": "application/json", "xml": "application/xml",
    "md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv", "tsv": "text/tab-separated-values", "rtf": "application/rtf",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml", "ico": "image/x-icon",
    "tiff": "image/tiff", "tif": "image/tiff", "avif": "image/avif", "apng": "image/apng",
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "odt": "application/vnd.oasis.opendocument.text",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "bz2": "application/x-bzip2", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar",
    "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "oga": "audio/ogg", "flac": "audio/flac", "aac": "audio/aac", "m4a": "audio/mp4",
    "mp4": "video/mp4", "webm": "video/webm", "ogv": "video/ogg", "avi": "video/x-msvideo", "mov": "video/quicktime", "mkv": "video/x-matroska",
    "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf",
    "rs": "text/rust", "py": "text/x-python", "java": "text/x-java", "c": "text/x-c", "cpp": "text/x-c++", "h": "text/x-c", "hpp": "text/x-c++", "go": "text/x-go", "rb": "text/x-ruby",
    "php": "text/x-php", "swift": "text/x-swift", "kt": "text/x-kotlin", "scala": "text/x-scala", "r": "text/x-r", "lua": "text/x-lua", "pl": "text/x-perl",
    "sh": "text/x-shellscript", "bash": "text/x-shellscript", "zsh": "text/x-shellscript", "fish": "text/x-shellscript", "ps1": "text/x-powershell",
    "yaml": "text/yaml", "yml": "text/yaml", "toml": "text/toml", "ini": "text/plain", "sql": "text/x-sql", "tex": "text/x-tex", "latex": "text/x-latex", "bib": "text/x-bibtex",
    "epub": "application/epub+zip", "mobi": "application/x-mobipocket-ebook", "wasm": "application/wasm",
}
# Fixed formats: names and aliases of output formats.
FORMATS = {"html": "html", "htm": "html", "xml": "xml", "latex": "latex", "tex": "latex", "beamer": "beamer", "revealjs": "revealjs", "bibtex": "bibtex", "bib": "bibtex", "commonmark": "commonmark", "markdown": "commonmark", "md": "commonmark"}


def replace_all(c: Column, pairs: Mapping[str, str]) -> Column:
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]


# --- text metrics -----------------------------------------------------------


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def count_words(t: Column) -> Column:
    return F.size(words(t)).cast("long")


def count_chars(t: Column) -> Column:
    return F.char_length(F.regexp_replace(t, r"\s+", "")).cast("long")


def count_lines(t: Column) -> Column:
    """Lines as a text reader sees them: a final newline ends the last one."""
    return (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((t != "") & ~t.endswith("\n"), 1).otherwise(0)).cast("long")


def count_sentences(t: Column) -> Column:
    return F.greatest(F.char_length(t) - F.char_length(F.regexp_replace(t, "[.!?]", "")), F.lit(1)).cast("long")


def reading_time_secs(t: Column) -> Column:
    """At 200 words a minute, rounded up."""
    return F.ceil(count_words(t) * 60 / 200).cast("long")


def count_syllables(t: Column) -> Column:
    """Vowel groups of each word's letters, less a silent final e, at least one for each word that has letters.

    Three regex counts over the text instead of a fold over its words.
    """
    s = F.regexp_replace(F.lower(t), r"[^\p{L}\s]", "")
    groups = F.regexp_count(s, F.lit("[aeiouy]+"))
    silent = F.regexp_count(s, F.lit(r"[aeiouy][^aeiouy\s]\S*e(?!\S)"))
    mute = F.regexp_count(s, F.lit(r"(?<!\S)[^aeiouy\s]+(?!\S)"))
    return (groups - silent + mute).cast("long")


def readability(t: Column) -> dict[str, Column]:
    w, s, y = F.greatest(count_words(t), F.lit(1)), count_sentences(t), count_syllables(t)
    per_sentence, per_word = w / s, y / w
    ease = 206.835 - 1.015 * per_sentence - 84.6 * per_word
    grade = F.greatest(0.39 * per_sentence + 11.8 * per_word - 15.59, F.lit(0.0))
    return {"sentences": s, "syllables": y, "reading_ease": ease, "grade": grade}


#: Fixed bands of the reading ease, from the top.
BANDS = [(90.0, "Very Easy"), (80.0, "Easy"), (70.0, "Fairly Easy"), (60.0, "Standard"), (50.0, "Fairly Difficult"), (30.0, "Difficult")]


def ease_band(ease: Column) -> Column:
    out = F.lit("Very Difficult")
    for least, name in reversed(BANDS):
        out = F.when(ease >= least, name).otherwise(out)
    return out


# --- slugs, white space, escapes ----------------------------------------------


def slug_cli(t: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N} ]", ""), F.lit(" "), F.lit("-"))


def anchor_ascii(t: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9 _-]", ""), "[ _-]+", "-")
    s = F.regexp_replace(s, "-$", "")
    return F.when(s == "", "heading").when(s.rlike("^[0-9]"), F.concat(F.lit("h-"), s)).otherwise(s)


def normalize_ws(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize_label(t: Column) -> Column:
    return F.upper(F.lower(normalize_ws(t)))


def truncate(t: Column, n: int) -> Column:
    return F.when(F.char_length(t) <= n, t).otherwise(F.concat(F.left(t, F.lit(max(n - 3, 0))), F.lit("...")))


def escape_html(t: Column) -> Column:
    return replace_all(t, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


def escape_html_writer(t: Column) -> Column:
    return F.replace(escape_html(t), F.lit("'"), F.lit("&#x27;"))


def escape_xml(t: Column) -> Column:
    return F.replace(escape_html(t), F.lit("'"), F.lit("&apos;"))


def escape_xml_attr(t: Column) -> Column:
    return replace_all(escape_xml(t), {"\n": "&#10;", "\r": "&#13;", "\t": "&#9;"})


def unescape_xml(t: Column) -> Column:
    """The five entities, the ampersand last, so nothing is decoded twice."""
    return replace_all(t, {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"})


def needs_xml_escape(t: Column) -> Column:
    return t.rlike("[&<>\"']")


def escape_typst(t: Column) -> Column:
    return F.regexp_replace(t, r'([\\*_`$#@<>"])', r"\\$1")


def escape_man(t: Column) -> Column:
    return replace_all(t, {"\\": "\\e", "-": "\\-", ".": "\\&.", "'": "\\&'"})


def escape_rtf(t: Column, newline: str = "\\line ") -> Column:
    return replace_all(t, {"\\": "\\\\", "{": "\\{", "}": "\\}", "\n": newline})


def escape_latex(t: Column) -> Column:
    from .scalars import LATEX

    marks = {c: chr(0xE000 + i) for i, c in enumerate(LATEX)}  # private-use stand-ins keep the replacements apart
    return replace_all(replace_all(t, marks), {marks[c]: v for c, v in LATEX.items()})


def xml_to_bool(t: Column) -> Column:
    low = F.lower(F.trim(t))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


# --- URLs ---------------------------------------------------------------------


def is_safe_url(u: Column) -> Column:
    low = F.lower(F.trim(u))
    ok = F.when(low.startswith("data:"), low.rlike("^data:(" + "|".join(DATA_IMAGES) + ")(,|;base64,)")).otherwise(~low.rlike("^(&#|&x|(" + "|".join(BLOCKED_SCHEMES) + "):)"))
    return ok & (F.octet_length(u) <= 8192) & ~u.rlike(r"[\x00-\x1F\x7F]")


def is_external_url(u: Column) -> Column:
    return u.rlike("^(https?://|ftp://|mailto:)")


def is_valid_url(u: Column) -> Column:
    return ~u.contains(" ") & (~u.startswith("mailto:") | u.contains("@"))


def escape_href(u: Column) -> Column:
    safe = replace_all(escape_html(u), {"'": "&#x27;", "`": "&#x60;"})
    return F.when(~is_safe_url(u), "#").when(F.trim(u) == "", "").otherwise(safe)


def normalize_uri(u: Column) -> Column:
    """Percent-encoded but for reserved and unreserved characters and the percent sign."""
    out = F.replace(F.url_encode(u), F.lit("+"), F.lit("%20"))
    for ch in "~:/?#[]@!$&'()+,;=":
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def data_uri_mime(u: Column) -> Column:
    m = F.regexp_extract(u, r"^data:([^,;]*)(;[^,]*)?,", 1)
    return F.when(u.rlike("^data:[^,]*,"), F.when(m == "", "text/plain").otherwise(m))


def data_uri_data(u: Column) -> Column:
    return F.when(u.rlike("^data:[^,]*,"), F.regexp_replace(u, "^data:[^,]*,", ""))


def bare_urls(t: Column) -> Column:
    """Bare http and https addresses; final punctuation is no part of one."""
    return F.transform(F.regexp_extract_all(t, F.lit(r"(https?://[^\s<>\[\]()]+)"), 1), lambda u: F.regexp_replace(u, "[.!?,:;]+$", ""))


def bare_emails(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"), 1)


def autolink_html(u: Column) -> Column:
    mail = u.contains("@") & ~u.contains("://")
    return F.concat(F.lit('<a href="'), F.when(mail, "mailto:").otherwise(""), escape_html(u), F.lit('">'), escape_html(u), F.lit("</a>"))


# --- media types ----------------------------------------------------------------


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def mime_type(path: Column) -> Column:
    return lookup(extension(path), MIME)


def mime_type_or_default(path: Column) -> Column:
    return F.coalesce(mime_type(path), F.lit("application/octet-stream"))


def extension_of_mime(m: Column) -> Column:
    first: dict[str, str] = {}
    for ext, kind in MIME.items():
        first.setdefault(kind, ext)
    return lookup(normalize_mime(m), first)


def normalize_mime(m: Column) -> Column:
    return F.trim(F.split_part(m, F.lit(";"), F.lit(1)))


def media_category(m: Column) -> Column:
    return F.split_part(m, F.lit("/"), F.lit(1))


def is_image(m: Column) -> Column:
    return media_category(m) == "image"


def is_text(m: Column) -> Column:
    return media_category(m) == "text"


def is_font(m: Column) -> Column:
    return media_category(m) == "font"


def mime_charset(m: Column) -> Column:
    c = F.regexp_extract(m, r'(?i)charset="?([^";\s]+)', 1)
    return F.when(c != "", c)


def output_format(path: Column) -> Column:
    return lookup(extension(path), FORMATS)


# --- maps: styles and front matter ------------------------------------------------


def _last_wins(entries: Column) -> Column:
    """Map of (k, v) structs in which a later key replaces an earlier one, keys in order.

    The entries are bound to a name first, else they would be computed anew for each key.
    """

    def merged(held: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(held, lambda e: e["k"])))
        value = lambda k: F.element_at(F.filter(held, lambda e: e["k"] == k), -1)["v"]
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(k))))

    return F.element_at(F.transform(F.array(entries), merged), 1)


def parse_css(css: Column) -> Column:
    parts = F.filter(F.split(css, ";"), lambda p: p.contains(":"))
    entry = lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("v"))
    return _last_wins(F.filter(F.transform(parts, entry), lambda e: (e["k"] != "") & (e["v"] != "")))


def css_text(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def inline_style(css: Column) -> Column:
    """The declarations of a style attribute; null where it is blank."""
    return F.when(F.trim(css) != "", parse_css(css))


def merge_css(a: Column, b: Column) -> Column:
    both = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return _last_wins(F.concat(both(a), both(b)))


def has_front_matter(t: Column) -> Column:
    return F.trim(t).rlike("^---\r?\n")


def front_matter_raw(t: Column) -> Column:
    """Between an opening ``---`` line and the next line that is exactly ``---``."""
    m = F.regexp_extract(t, r"^\s*---\r?\n((?:[^\n]*\n)*?)---[ \t]*\r?(?:\n|$)", 1)
    return F.when(t.rlike(r"^\s*---\r?\n(?:[^\n]*\n)*?---[ \t]*\r?(?:\n|$)"), m)


def front_matter_cli(t: Column) -> Column:
    """Between a leading ``---`` and the next ``---`` anywhere."""
    return F.when(t.rlike(r"^---[\s\S]*?---"), F.trim(F.regexp_extract(t, r"^---([\s\S]*?)---", 1), F.lit(" \n\r\t")))


def strip_front_matter(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s*---\r?\n(?:[^\n]*\n)*?---[ \t]*\r?(?:\n+|$)", "")


def front_matter_map(raw: Column) -> Column:
    lines = F.filter(F.split(raw, "\n"), lambda x: x.contains(":") & ~F.trim(x).startswith("#") & ~F.trim(x).startswith("- "))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    bare = lambda v: F.when(v.rlike("^\".*\"$|^'.*'$") & (F.char_length(v) >= 2), F.substring(v, F.lit(2), F.char_length(v) - 2)).otherwise(v)
    return _last_wins(F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("k"), bare(value(x)).alias("v"))))


# --- extensions as line predicates ---------------------------------------------------


def is_table_row(t: Column) -> Column:
    return t.contains("|")


def is_delimiter_row(t: Column) -> Column:
    return t.rlike(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$") & t.contains("|")


def cell_alignment(t: Column) -> Column:
    c = F.trim(t)
    return F.when(c.startswith(":") & c.endswith(":"), "center").when(c.startswith(":"), "left").when(c.endswith(":"), "right").otherwise("none")


def row_cells(t: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(t), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def task_marker(t: Column) -> Column:
    s = F.trim(t)
    return F.when(s.rlike(r"^\[ *[xX] *\]"), True).when(s.rlike(r"^\[ +\]"), False)


def task_text(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(t), r"^\[[ xX]+\]", ""))


def is_task_line(t: Column) -> Column:
    return t.rlike(r"^\s*([-*+]|[0-9]+\.)\s+\[[ xX]\](\s|$)")


def task_html(checked: Column, content: Column) -> Column:
    return F.concat(F.lit('<input type="checkbox" disabled="disabled"'), F.when(checked, ' checked="checked"').otherwise(""), F.lit(" /> "), content)


def task_markdown(checked: Column, content: Column) -> Column:
    return F.concat(F.when(checked, "[x] ").otherwise("[ ] "), content)


def has_strikethrough(t: Column) -> Column:
    return t.contains("~~")


def struck(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"(?<!~)~~(?!~)(.+?)(?<!~)~~(?!~)"), 1)


def is_toc_marker(t: Column) -> Column:
    return F.lower(F.trim(t)).isin("[toc]", "[[toc]]", "<!-- toc -->")


def is_filtered_tag(t: Column) -> Column:
    return F.lower(t).isin(FILTERED_TAGS)


def filter_html(t: Column) -> Column:
    return F.regexp_replace(t, r"(?i)<(/?(?:" + "|".join(FILTERED_TAGS) + r")(?=[\s/>])[^>]*)>", "&lt;$1&gt;")


def is_abbreviation(t: Column) -> Column:
    return t.rlike(r"^\*\[[^\]]+\]:")


def abbreviation_term(t: Column) -> Column:
    return F.when(is_abbreviation(t), F.trim(F.regexp_extract(t, r"^\*\[([^\]]+)\]:", 1)))


def abbreviation_text(t: Column) -> Column:
    return F.when(is_abbreviation(t), F.trim(F.regexp_replace(t, r"^\*\[[^\]]+\]:", "")))


def attribute_block(t: Column) -> Column:
    m = F.regexp_extract(t, r"\{([^{}]*)\}\s*$", 1)
    return F.when(t.rlike(r"\{[^{}]*\}\s*$"), m)


def attribute_id(t: Column) -> Column:
    m = F.regexp_extract(attribute_block(t), r"(?:^|\s)#([^\s.#=}]+)", 1)
    return F.when(m != "", m)


def attribute_classes(t: Column) -> Column:
    return F.regexp_extract_all(attribute_block(t), F.lit(r"(?:^|\s)\.([^\s.#=}]+)"), 1)


def attribute_map(t: Column) -> Column:
    pairs = F.regexp_extract_all(attribute_block(t), F.lit(r"""([A-Za-z_][\w-]*=(?:"[^"]*"|'[^']*'|[^\s"'}]+))"""), 1)
    return _last_wins(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), "^[\"']|[\"']$", "").alias("v"))))


def attributes(t: Column) -> Column:
    """Struct (id, classes, attrs) of a trailing ``{#id .class key=value}``; null where there is none."""
    return F.when(attribute_block(t).isNotNull(), F.struct(attribute_id(t).alias("id"), attribute_classes(t).alias("classes"), attribute_map(t).alias("attrs")))


def attributes_html(a: Column) -> Column:
    """The struct of :func:`attributes` as HTML attributes with a space before them; other keys in order."""
    quoted = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda k, v: F.concat(F.lit(" "), k, F.lit('="'), quoted(v), F.lit('"'))
    own = F.when(a["id"].isNotNull(), part(F.lit("id"), a["id"])).otherwise("")
    classes = F.when(F.size(a["classes"]) > 0, part(F.lit("class"), F.array_join(a["classes"], " "))).otherwise("")
    return F.concat(own, classes, F.array_join(F.transform(F.array_sort(F.map_entries(a["attrs"])), lambda e: part(e["key"], e["value"])), ""))


def is_definition_line(t: Column) -> Column:
    return t.rlike(r"^\s*:\s+\S")


def definition_text(t: Column) -> Column:
    return F.when(is_definition_line(t), F.trim(F.regexp_replace(t, r"^\s*:\s+", "")))


def footnote_label(t: Column) -> Column:
    m = F.regexp_extract(t, r"^ {0,3}\[\^([^\]\s]+)\]:", 1)
    return F.when(m != "", m)


def footnote_refs(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"\[\^([^\]\s]+)\](?!:)"), 1)


def smart_dashes(t: Column) -> Column:
    """Ellipses, then runs of two hyphens or more.

    A run whose length is a multiple of three is em dashes, any other even one
    en dashes; of the rest, one or two en dashes close a run of em dashes.
    """
    t = F.replace(t, F.lit("..."), F.lit("…"))
    run = r"(?<!-)%s(?!-)"
    for rest, made in (("---", "—"), ("--", "–"), ("----", "––"), ("-----", "—–"), ("-------", "—––"), ("------", "——")):
        t = F.regexp_replace(t, run % rest, made)
    longer = F.regexp_extract_all(t, F.lit(r"(?<!-)(-{8,})(?!-)"), 1)
    between = F.split(t, r"(?<!-)-{8,}(?!-)")

    def dashes(x: Column) -> Column:
        n = F.length(x)
        em, en = (lambda k: F.repeat(F.lit("—"), k.cast("int"))), (lambda k: F.repeat(F.lit("–"), k.cast("int")))
        mixed = F.when(n % 3 == 2, F.concat(em((n - 2) / 3), F.lit("–"))).otherwise(F.concat(em((n - 4) / 3), F.lit("––")))
        return F.when(n % 3 == 0, em(n / 3)).when(n % 2 == 0, en(n / 2)).otherwise(mixed)

    made = F.concat(F.transform(longer, dashes), F.array(F.lit("")))
    return F.when(F.size(longer) == 0, t).otherwise(F.array_join(F.zip_with(between, made, lambda a, b: F.concat(a, b)), ""))


# --- scripts ------------------------------------------------------------------------

def _class(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


CJK = f"[{_class(cells.CJK)}]"
_WIDE_LETTER = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"


def has_cjk(t: Column) -> Column:
    return t.rlike(CJK)


def cjk_spacing(t: Column) -> Column:
    """A space between a CJK letter and a neighbouring ASCII letter or digit."""
    return F.regexp_replace(t, f"(?<={_WIDE_LETTER})(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?={_WIDE_LETTER})", " ")


def needs_cjk_spacing(t: Column) -> Column:
    """Whether :func:`cjk_spacing` would put a space anywhere."""
    return t.rlike(f"{_WIDE_LETTER}[A-Za-z0-9]|[A-Za-z0-9]{_WIDE_LETTER}")


def is_cjk_punctuation(t: Column) -> Column:
    """Whether a text is one CJK punctuation mark or bracket, or a full-width one."""
    return t.rlike(r"^[\x{3001}-\x{3003}\x{3008}-\x{3011}\x{3014}-\x{301F}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF3D}\x{FF5B}-\x{FF65}]$")


def graphemes(t: Column) -> Column:
    """The grapheme clusters of a text: what a reader takes for one character."""
    return F.regexp_extract_all(t, F.lit(r"(?s)(\X)"), 1)


#: Inside a run of these every character is a cluster of one column.
_NARROW = r"\x20-\x7E\x{C0}-\x{FF}"


def _ends_of_runs(t: Column) -> Column:
    """A text without what lies inside its runs of narrow characters; what a run begins and ends with may belong to a cluster."""
    return F.regexp_replace(t, f"(?<=[{_NARROW}])[{_NARROW}]+(?=[{_NARROW}])", "")


def count_graphemes(t: Column) -> Column:
    """The number of grapheme clusters of a text; only what is not plain is taken apart."""
    ends = F.element_at(F.transform(F.array(_ends_of_runs(t)), lambda x: F.size(graphemes(x)) - F.char_length(x)), 1)
    return (F.char_length(t) + ends).cast("int")


# Pictographs below the astral planes that take two columns of themselves.
_WIDE_SIGNS = ((0x231A, 0x231B), (0x23E9, 0x23EC), (0x23F0, 0x23F0), (0x23F3, 0x23F3), (0x25FD, 0x25FE), (0x2614, 0x2615), (0x2648, 0x2653), (0x267F, 0x267F), (0x2693, 0x2693), (0x26A1, 0x26A1), (0x26AA, 0x26AB), (0x26BD, 0x26BE), (0x26C4, 0x26C5), (0x26CE, 0x26CE), (0x26D4, 0x26D4), (0x26EA, 0x26EA), (0x26F2, 0x26F3), (0x26F5, 0x26F5), (0x26FA, 0x26FA), (0x26FD, 0x26FD), (0x2705, 0x2705), (0x270A, 0x270B), (0x2728, 0x2728), (0x274C, 0x274C), (0x274E, 0x274E), (0x2753, 0x2755), (0x2757, 0x2757), (0x2795, 0x2797), (0x27B0, 0x27B0), (0x27BF, 0x27BF), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55))
_WIDE = ((0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0xA4CF), (0xA960, 0xA97C), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF01, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1F64F), (0x1F680, 0x1FAFF), (0x20000, 0x3FFFD))


def display_width(t: Column) -> Column:
    """Columns on a terminal, a cluster at a time: wide bases, flags and emoji count two, what has no base none.

    What lies inside runs of narrow letters is as wide as it is long and is not taken apart.
    """
    pictured = f"^[#*0-9{_class(cells.PICTOGRAPHS)}].*\\x{{FE0F}}"
    one = lambda c: (
        F.when(c.rlike(r"^[\p{Mn}\p{Me}\p{Cc}\p{Cf}\x{FF9E}\x{FF9F}\x{1160}-\x{11FF}\x{1F3FB}-\x{1F3FF}]"), 0)
        .when(c.rlike(f"^[{_class((cells.FLAGS,))}]"), F.least(F.char_length(c), F.lit(2)))
        .when(c.rlike(pictured), 2).when(c.rlike(f"^[{_class(cells.PICTOGRAPHS)}].*\\x{{FE0E}}"), 1)
        .when(c.rlike(f"^[{_class(_WIDE + _WIDE_SIGNS)}]"), 2).otherwise(1)
    )
    odd = lambda x: F.aggregate(graphemes(x), F.lit(0), lambda n, c: n + one(c)) - F.char_length(x)
    return F.when(t.rlike(r"^[\x20-\x7E]*$"), F.char_length(t)).otherwise(F.char_length(t) + F.element_at(F.transform(F.array(_ends_of_runs(t)), odd), 1)).cast("int")


# --- lines and tables -------------------------------------------------------------------


def get_lines(t: Column, start: int, end: int) -> Column:
    return F.slice(F.split(t, "\n"), start, max(1, end - start + 1))


def minimize_indent(t: Column) -> Column:
    """The text without the white space that all its non-empty lines begin with; ends with no line break."""
    rows = F.split(F.regexp_replace(t, r"\r?\n$", ""), r"\r?\n")
    indent = F.array_min(F.transform(F.filter(rows, lambda x: x != ""), lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1))))
    return F.when(indent.isNull(), t).otherwise(F.array_join(F.transform(rows, lambda x: F.substr(x, indent + 1)), "\n"))


def wrap_text(t: Column, width: int) -> Column:
    """Greedy wrap by characters."""
    step = lambda s, w: F.when(s == "", w).when(F.char_length(F.substring_index(s, "\n", -1)) + 1 + F.char_length(w) <= width, F.concat(s, F.lit(" "), w)).otherwise(F.concat(s, F.lit("\n"), w))
    return F.aggregate(words(t), F.lit(""), step)


def csv_rows(t: Column, sep: str = ",") -> Column:
    """Rows of cells of simple delimited text without quotes."""
    lines = F.filter(F.split(t, "\r?\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.transform(F.split(x, F.lit("\\" + sep)), lambda c: F.trim(c)))


def table_markdown(rows: Column) -> Column:
    """A padded pipe table of an array of rows; the first row is the header."""
    n = F.size(F.get(rows, F.lit(0)))
    at = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    width = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.array_max(F.transform(rows, lambda r: F.char_length(at(r, i)))), F.lit(3)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(width, lambda w, i: F.rpad(at(r, i), w, F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(width, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), body), "\n")

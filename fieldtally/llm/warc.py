"""WARC derivatives: a metadata and a plain-text conversion record for every response.

DataFrame operations only: pages become text by patterns, records are rows, and a WARC file is a text file
whose lines are records, parted by the blank lines that end a record. Names and dates are functions of the
source, so that a repeated run gives the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bound
from .common import column, read_table

DATE = "2024-01-01T00:00:00Z"
#: How a record begins, and what ends its header and follows its block.
START, END = "WARC/1.", "\r\n\r\n"
# Header fields of a record in their order, with the column of each.
FIELDS = [
    ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"),
    ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"),
    ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
]
HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

#: Parts of a page that hold no text, tags that end a line, and any tag. Quoted values may hold ">".
HIDDEN = ["<!--.*?-->"] + [f"<{t}(?:\\s[^>]*)?>.*?</{t}\\s*>" for t in ("script", "style", "noscript", "template", "svg", "head")]
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
TAG = "(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
# Character references by name.
NAMED = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&reg;": "®",
    "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&laquo;": "«", "&raquo;": "»", "&euro;": "€",
    "&amp;": "&",
}
NUMBERED = "#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})"


def references(text: Column) -> Column:
    """Character references decoded in one pass, so that what one of them gives is never read again as another.

    A number that names no character becomes U+FFFD; unknown names stay as they are.
    """

    def char(name):
        x = F.substring(name, 2, 8)
        code = F.when(F.lower(F.substring(x, 1, 1)) == "x", F.conv(F.substring(x, 2, 6), 16, 10)).otherwise(x).cast("int")
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        shown = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        known = F.create_map(*[F.lit(v) for k, c in NAMED.items() for v in (k[1:-1], c)])
        return F.when(F.rlike(name, F.lit(f"^{NUMBERED}$")), shown).otherwise(F.try_element_at(known, name))

    def piece(p):
        name = F.substring_index(p, ";", 1)
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        read = bound(char(name), lambda c: F.when(c.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(c, rest)))
        return F.when(F.contains(F.substring(p, 1, 10), F.lit(";")), read).otherwise(F.concat(F.lit("&"), p))

    pieces = F.transform(F.split(text, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(piece(p)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def without_hidden(text: Column, pattern: str) -> Column:
    """``text`` with the parts that match ``pattern`` as a space; only what comes before the last end tag is tried.

    No part can end after that, so the result is the same, and tags that never close cost nothing.
    """
    last = F.regexp_extract(text, "(?is)^.*" + pattern[pattern.rindex(".*?") + 3 :], 0)
    return bound(last, lambda head: F.concat(F.regexp_replace(head, "(?is)" + pattern, " "), F.substring(text, F.length(head) + 1, F.length(text))))


def page_text(html: Column) -> Column:
    """The text of a page: hidden parts out, blocks on lines of their own, references decoded, space folded.

    Each step is bound, so that it is computed once however often the next one uses it. A kind of hidden part is
    tried where the page has its end tag; taking parts out makes no new tags, as a space takes their place.
    """

    def shown(page):
        small = F.lower(page)

        def without(low):
            out = page
            for pattern in HIDDEN:
                end = pattern[pattern.rindex(".*?") + 3 :].removesuffix("\\s*>")
                begin = end.replace("/", "") if end.startswith("</") else "<!--"
                rest = F.substring_index(low, end, -1)
                # Parts that begin after the last end tag would each be followed to the end of the page.
                open_ = F.contains(rest, F.lit(begin)) & F.rlike(rest, F.lit(begin + ("[\\s>]" if begin != "<!--" else "")))
                plain = (lambda p: lambda t: F.regexp_replace(t, "(?is)" + p, " "))(pattern)
                out = bound(out, (lambda p, e, o, r: lambda t: F.when(~F.contains(low, F.lit(e)), t).when(o, without_hidden(t, p)).otherwise(r(t)))(pattern, end, open_, plain))
            return out

        return bound(small, without)

    out = bound(html, shown)
    possessive = TAG.replace("]*", "]*+").replace("[^>\"']", "[^>\"']++").replace(")*>", ")*+>")
    out = F.regexp_replace(out, f"(?i)</?(?:{BLOCKS})(?![A-Za-z0-9]){possessive}", "\n")
    out = F.regexp_replace(out, f"</?[A-Za-z!?]{possessive}", "")

    out = bound(out, references)
    # Single spaces and line ends stay as they are and need no match; what a match begins with is one class of characters.
    out = F.regexp_replace(out, "[ \\t\\r\\f\\x{00A0}](?:[ \\t\\r\\f\\x{00A0}]++|(?<! ))", " ")
    out = F.regexp_replace(out, "[ \\n](?:(?<=\\n)[ \\n]++|(?<= )\\n[ \\n]*+)", "\n")
    return F.btrim(out, F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """A name-based URN."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Pages as responses: (id, record_id, target_uri, date, headers, payload); a null page or address is empty."""
    address, body = (F.coalesce(column(pages, c).cast("string"), F.lit("")) for c in (url, html))
    own = column(pages, id)
    length = F.concat(F.lit(HEADERS + "Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    name = record_id(F.lit("response"), F.coalesce(own.cast("string"), F.lit("")), address, F.md5(body))
    return pages.select(own.alias(id), name.alias("record_id"), address.alias("target_uri"), F.lit(date).alias("date"), length.alias("headers"), body.alias("payload"))


def derivatives(source: DataFrame, id: str = "page_id") -> DataFrame:
    """Two records for each response: ``metadata`` and ``conversion``, both referring to it.

    Columns: (id, record_type, record_id, refers_to, concurrent_to, target_uri, date, content_type,
    content_length, block_digest, source_digest, block). The metadata block holds the source's headers,
    digests, language, title and the size of its text, as WARC fields; the two records name each other. An
    empty page has an empty text. Repeated responses give repeated records.
    """
    text = page_text(F.col("payload"))
    base = source.select(column(source, id).alias("id"), "record_id", "target_uri", "date", "headers", "payload", text.alias("text"), digest(F.col("payload")).alias("source_digest"))
    one_line = lambda c: F.regexp_replace(c, "[\\x00-\\x20]+", " ")
    title = F.trim(one_line(F.regexp_extract("payload", "(?is)<title(?:\\s[^>]*)?>(.*?)</title", 1)))
    language = F.regexp_extract("payload", "(?i)<html[^>]*\\slang=[\"']?([A-Za-z-]+)", 1)
    http = F.transform(F.filter(F.split("headers", "\r\n"), lambda h: F.contains(h, F.lit(":"))), lambda h: F.concat(F.lit("http-header: "), h))
    payload_digest, block_digest = F.col("source_digest"), digest(F.concat("headers", F.lit("\r\n"), F.col("payload")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value)
    meta = F.concat(
        F.array(line("source-payload-digest", payload_digest), line("source-block-digest", block_digest)),
        http,
        F.array(line("language", language), line("title", title), line("text-characters", F.length("text").cast("string"))),
    )
    names = {k: record_id(F.lit(k), F.col("record_id")) for k in ("metadata", "conversion")}
    record = lambda kind, other, content, block: F.struct(
        F.lit(kind).alias("record_type"), names[kind].alias("record_id"), F.col("record_id").alias("refers_to"), names[other].alias("concurrent_to"),
        F.col("target_uri"), F.col("date"), F.lit(content).alias("content_type"), payload_digest.alias("source_digest"), block.alias("block"),
    )
    pair = F.array(
        record("metadata", "conversion", "application/warc-fields", F.concat(F.array_join(meta, "\r\n"), F.lit("\r\n"))),
        record("conversion", "metadata", "text/plain; charset=utf-8", F.col("text")),
    )
    out = base.select("id", F.explode(pair).alias("r")).select("id", "r.*")
    return out.select(
        F.col("id").alias(id), "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"), "source_digest", "block",
    )


def as_warc(records: DataFrame) -> DataFrame:
    """One column ``record``: header and block of each record, without the blank lines that end it."""
    lines = [F.concat(F.lit(name + ": "), F.col(c).cast("string"), F.lit("\r\n")) for name, c in FIELDS]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.col("block")).alias("record"))


def write_warc(records: DataFrame, folder: str) -> None:
    """One gzipped WARC file per partition; each record ends with two line ends."""
    as_warc(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of WARC files, in the columns of :func:`derivatives` without the page's id, and ``complete``.

    A record ends where the next one's first line follows two line ends; compressed files need the usual name endings. Fields that a
    record lacks are null. ``content_length`` is the declared one: a block is cut to it, and ``complete`` is false where
    the block found is shorter, or longer by more than the line ends, as after a payload that itself holds such a first line. Bytes
    stay as they are.
    """
    raw = spark.read.option("lineSep", END + START).text(folder)
    text = F.when(F.col("value").startswith(START), F.substring("value", len(START) + 1, F.length("value"))).otherwise(F.col("value"))
    head = F.substring_index(F.col("text"), END, 1)
    field = lambda name: F.nullif(F.btrim(F.regexp_extract("head", f"(?im)^{name}:([^\\r\\n]*)", 1)), F.lit(""))
    split = raw.select(text.alias("text")).where(F.btrim("text", F.lit("\r\n")) != "").withColumn("head", head)
    bytes_ = F.col("text").cast("binary")
    found = F.substring(bytes_, F.octet_length("head") + len(END) + 1, F.octet_length("text"))
    named = split.select(*[field(name).alias(c) for name, c in FIELDS], found.alias("found")).withColumn("content_length", F.col("content_length").try_cast("long"))
    block = F.substring(F.col("found"), F.lit(1), F.coalesce(F.col("content_length"), F.octet_length("found")).cast("int"))
    over = F.octet_length("found") - F.col("content_length")
    return named.select(*[c for _, c in FIELDS], block.cast("string").alias("block"), F.coalesce(over.isin(0, len(END)), F.lit(False)).alias("complete"))


def responses_in(records: DataFrame, id: str = "page_id") -> DataFrame:
    """The responses among records read from WARC files, with their own dates and headers, as :func:`derivatives` takes them.

    The id is the record's name. Records that are not complete are responses too; filter on ``complete`` for whole ones. A
    block without the empty line after its headers is all payload.
    """
    r = records.where(F.lower("record_type") == "response")
    has = F.contains(F.col("block"), F.lit(END))
    head = F.when(has, F.concat(F.substring_index("block", END, 1), F.lit("\r\n"))).otherwise(F.lit(""))
    body = F.when(has, F.substring(F.col("block").cast("binary"), F.octet_length(F.substring_index("block", END, 1)) + len(END) + 1, F.octet_length("block")).cast("string"))
    uri, date = (F.coalesce(c, F.lit("")) for c in ("target_uri", "date"))
    return r.select(F.col("record_id").alias(id), "record_id", uri.alias("target_uri"), date.alias("date"), head.alias("headers"), F.coalesce(body, F.col("block")).alias("payload"))


def op3_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return derivatives(responses(read_table(spark, folder, "pages")))


def _sql_text() -> str:
    out = "html"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern in HIDDEN:
        out = f"regexp_replace({out}, {quote('(?is)' + pattern)}, ' ', 'g')"
    out = f"regexp_replace({out}, {quote('(?i)</?(?:' + BLOCKS + ')' + chr(92) + 'b' + TAG)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {quote('</?[A-Za-z!?]' + TAG)}, '', 'g')"
    name = "split_part(p, ';', 1)"
    char = lambda c: f"CASE WHEN {c} BETWEEN 1 AND 1114111 AND {c} NOT BETWEEN 55296 AND 57343 THEN chr({c}) ELSE chr(65533) END"
    tens, hexes = f"CAST(substr({name}, 2) AS INTEGER)", f"CAST('0x' || substr({name}, 3) AS INTEGER)"
    named = " ".join(f"WHEN {quote(k[1:-1])} THEN {quote(c)}" for k, c in NAMED.items())
    read = f"CASE WHEN regexp_full_match({name}, '#[0-9]{{1,7}}') THEN {char(tens)} WHEN regexp_full_match({name}, '#[xX][0-9A-Fa-f]{{1,6}}') THEN {char(hexes)} ELSE CASE {name} {named} END END"
    whole = f"CASE WHEN i = 1 THEN p WHEN position(';' IN p) = 0 THEN '&' || p ELSE coalesce({read} || substr(p, length({name}) + 2), '&' || p) END"
    out = f"array_to_string(list_transform(string_split({out}, '&'), lambda p, i: {whole}), '')"
    out = f"regexp_replace({out}, '[ \\t\\r\\f\\x{{00A0}}]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({out}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def _sql_id(*parts: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(parts)}))"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-8' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"


_END = "chr(13) || chr(10)"
#: DuckDB: the same records.
OP3_SQL = f"""
WITH pages AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
base AS (
    SELECT *, {_sql_id("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "target_uri", "md5(html)")} AS refers_to, {_sql_text()} AS text,
        'HTTP/1.1 200 OK' || {_END} || 'Content-Type: text/html; charset=utf-8' || {_END} || 'Content-Length: ' || octet_length(encode(html)) || {_END} AS headers,
        regexp_extract(html, '(?i)<html[^>]*\\slang=["'']?([A-Za-z-]+)', 1) AS language,
        trim(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title', 1), '[\\x00-\\x20]+', ' ', 'g')) AS title
    FROM pages),
named AS (SELECT *, {_sql_id("'metadata'", "refers_to")} AS meta_id, {_sql_id("'conversion'", "refers_to")} AS text_id,
    'sha256:' || sha256(html) AS source_digest FROM base),
records AS (
    SELECT page_id, 'metadata' AS record_type, meta_id AS record_id, refers_to, text_id AS concurrent_to, target_uri, 'application/warc-fields' AS content_type,
        source_digest, 'source-payload-digest: ' || source_digest || {_END} || 'source-block-digest: sha256:' || sha256(headers || {_END} || html) || {_END}
        || 'http-header: Content-Type: text/html; charset=utf-8' || {_END} || 'http-header: Content-Length: ' || octet_length(encode(html)) || {_END}
        || 'language: ' || language || {_END} || 'title: ' || title || {_END} || 'text-characters: ' || length(text) || {_END} AS block FROM named
    UNION ALL
    SELECT page_id, 'conversion', text_id, refers_to, meta_id, target_uri, 'text/plain; charset=utf-8', source_digest, text FROM named)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '{DATE}' AS date, content_type,
    CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, block
FROM records"""

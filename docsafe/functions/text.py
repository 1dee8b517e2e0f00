"""Column functions over text, JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
BLANK = " \t\n\x0b\f\r"


def _plain() -> dict[str, str]:
    """Accented letters whose decomposition is a letter and marks, by code points of the Latin blocks."""
    out = {}
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for c in map(chr, block):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c:
                out[c] = base
    return out


PLAIN = _plain()
#: Letters by the number of their marks beyond the first, each as often as it has more.
MARKS = {c: sum(map(bool, map(unicodedata.combining, unicodedata.normalize("NFD", c)))) for c in PLAIN}


def _pairs() -> str:
    """Letter, mark and the composed letter of both, one after another: no place of it but a pair's own reads as a pair."""
    letters = [*map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B))), *PLAIN]
    marks = sorted({m for c in PLAIN for m in unicodedata.normalize("NFD", c) if unicodedata.combining(m)})
    found = ((x, m, unicodedata.normalize("NFC", x + m)) for x in letters for m in marks)
    return "".join(x + m + y for x, m, y in found if len(y) == 1)


PAIRS = _pairs()


def composed(c: Column) -> Column:
    """Latin letters with the marks after them as one character where there is one, whatever the order of the marks."""

    def joined(a: Column, m: Column) -> Column:
        at = F.call_function("locate", F.concat(F.right(a, F.lit(1)), m), F.lit(PAIRS), F.lit(1))
        return F.when(at > 0, F.concat(F.left(a, F.length(a) - 1), F.substr(F.lit(PAIRS), at + 2, F.lit(1)))).otherwise(F.concat(a, m))

    cluster = lambda x: F.when(F.length(x) == 1, x).otherwise(F.aggregate(F.split(F.substr(x, F.lit(2)), ""), F.left(x, F.lit(1)), joined))
    whole = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s).\p{M}*"), F.lit(0)), cluster), "")
    return F.when(c.rlike(r"\p{M}"), whole).otherwise(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def normalized(c: Column) -> Column:
    """Latin letters composed, white space of any kind collapsed and stripped."""
    return F.trim(F.regexp_replace(composed(c), r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "))


def lexical_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{WORD}+(?:[/.-]{WORD}+)*"), F.lit(0))


def simple_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{WORD}+"), F.lit(0))


def retry_tokens(c: Column) -> Column:
    """Lexical tokens, with a digit's dot before a letter taken as a break."""
    return lexical_tokens(F.regexp_replace(c, r"(?<=\p{Nd})\.(?=[\p{L}\p{Nl}\p{No}])", " "))


def marked_tokens(c: Column) -> Column:
    """Words, and every mark that is no blank."""
    return F.regexp_extract_all(c, F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))


def folded(c: Column) -> Column:
    """Lower case, with the letters that folding changes beyond it: sharp and long s, final sigma, micro, ligatures."""
    low = F.translate(F.lower(c), "ſςµ", "sσμ")
    for a, b in (("ß", "ss"), ("ŉ", "ʼn"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return low


def strict_tokens(c: Column) -> Column:
    return F.transform(lexical_tokens(composed(c)), folded)


def accentless(c: Column) -> Column:
    plain = F.translate(F.translate(folded(c), "".join(PLAIN), "".join(PLAIN.values())), "đ", "d")
    return F.regexp_replace(plain, r"\p{M}", "")


def material(c: Column) -> Column:
    """Lexical tokens without accents, joined by blanks: what two readings are compared by."""
    return F.array_join(F.transform(lexical_tokens(c), accentless), " ")


def last_tokens(tokens: Column, most: int = 28, skip: int = 2) -> Column:
    """The last tokens of an array, none of its first `skip`."""
    return F.slice(tokens, F.greatest(F.size(tokens) - most + 1, F.lit(skip + 1)), F.lit(most))


def tail_bigrams(tail: Column) -> Column:
    """(most, distinct_ratio) of a short array of tokens, a column of its own: how often its commonest pair occurs, and the
    share of distinct tokens."""
    pairs = F.slice(F.zip_with(tail, F.slice(tail, F.lit(2), F.greatest(F.size(tail), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)), F.lit(1), F.greatest(F.size(tail) - 1, F.lit(0)))
    times = F.transform(F.array_distinct(pairs), lambda p: F.size(F.filter(pairs, lambda q: q == p)))
    share = F.when(F.size(tail) > 0, F.size(F.array_distinct(tail)) / F.size(tail)).otherwise(F.lit(1.0))
    return F.struct(F.coalesce(F.array_max(times), F.lit(0)).cast("long").alias("most"), share.alias("distinct_ratio"))


def numeric_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"\p{Nd}"))


def punctuation_signature(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"\p{P}"), F.lit(0)), "")


def diacritics(c: Column) -> Column:
    """Marks of all letters, those within composed letters and those that follow them."""
    out = F.regexp_count(c, F.lit(r"\p{M}"))
    for k in range(1, max(MARKS.values()) + 1):
        of = "".join(x for x, n in MARKS.items() if n >= k)
        out = out + F.length(c) - F.length(F.translate(c, of, ""))
    return out.cast("long")


def markdown_to_text(c: Column) -> Column:
    """Markdown without page marks, fences, links' targets, heads, emphasis, bullets and table rules; cells by tabs."""
    c = F.regexp_replace(c, r"(?i)<!--\s*Page\s+\d+\s*-->", "")
    c = F.regexp_replace(c, r"```[^\n]*\n", "")
    c = F.replace(c, F.lit("```"), F.lit(""))
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^\)]+\)", "$1")
    c = F.regexp_replace(c, r"(?md)^#{1,6}\s+", "")
    c = F.regexp_replace(c, r"[*_~`]", "")
    c = F.regexp_replace(c, r"(?md)^\s*[-+]\s+", "")
    rule = lambda x: strip(x).rlike(r"^\|?[\s:\|-]+\|?$") & F.contains(x, F.lit("-"))
    cells = lambda x: F.array_join(F.transform(F.split(F.btrim(strip(x), F.lit("|")), r"\|"), strip), "\t")
    rows = F.transform(F.filter(F.split(c, "\n"), lambda x: ~rule(x)), lambda x: F.when(F.contains(x, F.lit("|")), cells(x)).otherwise(x))
    return strip(F.regexp_replace(F.array_join(rows, "\n"), r"\n{3,}", "\n\n"))


def line_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: strip(x) != "")).cast("long")


def char_loop_start(c: Column) -> Column:
    """Place from 1 of the first run of six or more equal word characters, any case; 0 without one."""
    return F.regexp_instr(F.lower(c), F.lit(rf"({WORD})\1{{5,}}")).cast("long")


def trim_char_loop(c: Column) -> Column:
    """Text before the first character run, unless the rest holds a digit; fewer than two tokens count as nothing."""
    start = char_loop_start(c)
    head = F.rtrim(F.left(c, F.greatest(start - 1, F.lit(0)).cast("int")), F.lit(" ,.;:_-"))
    tail = F.substr(c, F.greatest(start, F.lit(1)).cast("int"))
    return F.when((start == 0) | tail.rlike(r"\p{Nd}"), c).when(F.size(simple_tokens(head)) < 2, F.lit("")).otherwise(head)


def seam_overlap(left: Column, right: Column, most: int = 4) -> Column:
    """How many tokens end the left array and begin the right one alike, case aside; the longest up to `most`."""
    low = lambda a: F.transform(a, F.lower)
    out = F.lit(0)
    for n in range(1, most + 1):
        same = (F.size(left) >= n) & (F.size(right) >= n) & (F.slice(low(left), -n, n) == F.slice(low(right), 1, n))
        out = F.when(same, F.lit(n)).otherwise(out)
    return out.cast("long")


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, F.lit("n/a")).otherwise(F.format_string("%+.1f%%", (new - old) / old * 100))


def trim_ngram_loop(c: Column, start: Column) -> Column:
    """Text before the loop that begins at a place from 0, unless the rest holds a digit; fewer than two tokens or four
    characters count as nothing. A null place leaves the text."""
    head = F.rtrim(F.left(c, start.cast("int")), F.lit(" ,;:-"))
    rest = F.substr(c, (start + 1).cast("int"))
    short = (F.size(simple_tokens(head)) < 2) | (F.length(head) < 4)
    return F.when(start.isNull() | rest.rlike(r"\p{Nd}"), c).when(short, F.lit("")).otherwise(head)


def punctuation_run_start(c: Column) -> Column:
    """Place from 1 of the first run of six or more marks, blanks between them allowed; 0 without one."""
    return F.regexp_instr(c, F.lit(r"(?:\s*[,.;:_-]\s*){6,}")).cast("long")


def without_span(c: Column, start: Column, end: Column) -> Column:
    """Text without the characters from start up to end, from 0; one space where words would meet."""
    left, right = F.rtrim(F.left(c, start.cast("int"))), F.ltrim(F.substr(c, (end + 1).cast("int")))
    closing = right.rlike(r"^[,.;:!?)\]}]")
    return F.when((left == "") | (right == "") | closing, F.concat(left, right)).otherwise(F.concat(left, F.lit(" "), right))


def page_of_crop(c: Column) -> Column:
    """The page index in a crop's name, -1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^p(\d+)-", 1), F.lit("")).cast("int"), F.lit(-1))


def crop_place(c: Column) -> Column:
    """pP:lL of a crop's name pN-lN, counted from 1; other names as they are, ? without one."""
    at = lambda i: (F.regexp_extract(c, r"^p(\d+)-l(\d+)$", i).try_cast("long") + 1).cast("string")
    return F.when(c.rlike(r"^p\d+-l\d+$"), F.concat(F.lit("p"), at(1), F.lit(":l"), at(2))).otherwise(F.coalesce(F.nullif(c, F.lit("")), F.lit("?")))


def compact_event(kind: Column, e: dict[str, Column]) -> Column:
    """One line of a log for an event: the start, routing and end of a document, or any message; ? for what is not known.
    Labels are fixed values."""
    known = lambda k, other="?": F.coalesce(e[k].cast("string"), F.lit(other)) if k in e else F.lit(other)
    yes = lambda k: F.when(F.coalesce(e[k], F.lit(False)), F.lit("CÓ")).otherwise(F.lit("KHÔNG")) if k in e else F.lit("KHÔNG")
    took = duration(e["elapsed_ms"]) if "elapsed_ms" in e else F.lit("?")
    started = F.concat(F.lit("[OCR] Bắt đầu | "), known("filename"), F.lit(" | "), known("page_count"), F.lit(" trang"))
    routed = F.concat(F.lit("[OCR] Phân tuyến | native="), known("native_page_count", "0"), F.lit(" | ocr="), known("ocr_page_count", "0"), F.lit(" | "), took)
    done = F.concat(F.lit("[OCR] Hoàn tất | "), known("filename"), F.lit(" | trạng thái="), F.upper(known("status")), F.lit(" | "), took, F.lit(" | rủi ro="), known("risk_count", "0"), F.lit(" | AI-ready: "), yes("ready"))
    other = F.concat(F.lit("[OCR] "), F.coalesce(e["message"], kind) if "message" in e else kind)
    return F.when(kind == "document_started", started).when(kind == "native_routing_complete", routed).when(kind == "document_complete", done).otherwise(other)


def compact_retry(crop: Column, applied: Column, width: Column, ms: Column, confidence: Column, reason: Column, before: Column, after: Column, label: str = "Retry") -> Column:
    """Three lines of a log for a line that was read again. Labels are fixed values."""
    action = F.when(applied, F.lit("ÁP DỤNG")).otherwise(F.lit("GIỮ NGUYÊN"))
    sure = F.coalesce(F.format_string(" | conf=%.3f", confidence), F.lit(""))
    sure = F.when(confidence.isNull(), F.lit("")).otherwise(sure)
    head = F.concat(F.lit(f"[OCR][{label}] "), crop_place(crop), F.lit(" | "), action, F.lit(" | width="), F.coalesce(width.cast("string"), F.lit("-")), F.lit(" | "), duration(ms), sure, F.lit(" | "), F.coalesce(reason, F.lit("?")))
    return F.concat(head, F.lit('\n  trước: "'), shortened(before), F.lit('"\n  sau:   "'), shortened(after), F.lit('"'))


def shortened(c: Column, most: int = 120) -> Column:
    t = normalized(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 1)), F.lit("…")))


def duration(ms: Column) -> Column:
    """1.5s, or 2m3s from a minute on; ? for null."""
    s = ms / 1000.0
    whole = F.floor(s / 60)
    long = F.format_string("%dm%ds", whole.cast("long"), F.bround(s - whole * 60, 0).cast("long"))
    return F.when(ms.isNull(), F.lit("?")).when(s >= 60, long).otherwise(F.format_string("%.1fs", s))


def resized_width(width: Column, height: Column, target: int = 32) -> Column:
    return F.greatest(F.lit(10), F.ceil(target * width / F.greatest(height, F.lit(1)) / 10) * 10).cast("long")

"""Column functions over text: item keys, cache keys, replies, model answers, image links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply words for the first three options.
ORDINALS = {"第一个": 1, "第一": 1, "一": 1, "第二个": 2, "第二": 2, "二": 2, "第三个": 3, "第三": 3, "三": 3}
NUMBERED = [r"^\s*(\d+)\s*$", r"^\s*第\s*(\d+)\s*个?\s*$", r"^\s*选\s*(\d+)\s*$", r"^\s*(\d+)\s*号\s*$"]
# Image endings, the marker before a list of images, and the punctuation trimmed off links.
IMAGE = r"(?i)\.(png|jpe?g|gif|webp|bmp|svg)(\?|#|$)"
MARKER = r"【\s*图片\s*】|\[\s*图片\s*\]"
TAIL = r"""[)\]}'">，。,;；\]】）＞]+$"""
HEAD = r"""^[<(\[{'"＜（【]+"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x, use) -> Column:
    """use(x) with x worked out once, however often `use` names it (branches of a plain expression work it out anew)."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def normalize_newlines(text) -> Column:
    """Every line end as one line feed."""
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def canonical_key(name) -> Column:
    """Names that differ in case, blanks, '-' or '_' only share a key; null gives the empty key."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(_c(name))), r"[\s\-_]+", ""), F.lit(""))


def cache_key(query, names, prefix: str = "hyde:") -> Column:
    """A stable key of a query and its item names, whatever their blanks and order."""
    tidy = F.trim(F.regexp_replace(_c(query), r"\s+", " "))
    kept = F.array_sort(F.filter(F.transform(_c(names), lambda n: F.trim(n)), lambda n: n != ""))
    return F.concat(F.lit(prefix), F.sha2(F.concat(tidy, F.lit("|"), F.array_join(kept, "|")), 256))


def strip_item_names(query, names) -> Column:
    """The query without the item names (any case, blanks allowed between letters), blanks collapsed."""
    pattern = lambda n: F.concat(F.lit("(?iu)"), F.array_join(F.transform(F.split(F.replace(n, F.lit(" "), F.lit("")), ""), lambda ch: F.concat(F.lit("\\Q"), ch, F.lit("\\E"))), r"\s*"))
    gone = F.aggregate(F.filter(_c(names), lambda n: F.trim(n) != ""), _c(query), lambda q, n: F.regexp_replace(q, pattern(n), F.lit("")))
    return F.trim(F.regexp_replace(gone, r"\s+", " "))


def clean_names(names, size: int = 15) -> Column:
    """Non-empty names, trimmed, cut to `size`, each once in order of first sight."""
    return F.array_distinct(F.transform(F.filter(_c(names), lambda n: F.trim(n) != ""), lambda n: F.substring(F.trim(n), 1, size)))


def embedding_text(a, b) -> Column:
    """What a text encoder reads of two parts: both, on lines of their own; an empty first part is left out."""
    a, b = _c(a), _c(b)
    return F.when(F.coalesce(F.trim(a), F.lit("")) == "", b).otherwise(F.concat_ws("\n", a, b))


def strip_fence(text) -> Column:
    """A model's answer without a code fence (three backticks, perhaps named json) around it."""
    opened = lambda a: F.when(F.lower(F.substring(a, 1, 7)) == "```json", F.substr(a, F.lit(8))).when(F.startswith(a, F.lit("```")), F.substr(a, F.lit(4))).otherwise(a)
    inner = lambda i: F.when(F.endswith(i, F.lit("```")), F.left(i, F.length(i) - 3)).otherwise(i)
    return once(F.trim(_c(text)), lambda a: once(F.rtrim(opened(a)), lambda i: F.trim(inner(i), F.lit(" \t\n\x0b\f\r"))))


def parse_model_json(text, schema: str) -> Column:
    """The answer as the given struct; null where it is no JSON object."""
    whole = lambda c: F.startswith(c, F.lit("{")) & (F.endswith(c, F.lit("}")) | c.rlike(r"(?s)^\{.*\}$"))  # noqa: E731  (the pattern also lets a last line separator pass)
    return once(strip_fence(text), lambda clean: F.when(whole(clean), F.from_json(clean, schema)))


def parse_image_info(answer) -> Column:
    """image_type, caption, detail of a vision model's answer; an answer that is no JSON stands as the detail."""
    raw = F.trim(_c(answer))
    v = parse_model_json(raw, "image_type string, caption string, detail string")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    kind = F.when(F.coalesce(F.trim(v["image_type"]), F.lit("")) == "", "other").otherwise(F.trim(v["image_type"]))
    caption = F.when(text(v["caption"]) != "", text(v["caption"])).otherwise(F.substring(text(v["detail"]), 1, 30))
    return F.when(v.isNull(), F.struct(F.lit("unknown").alias("image_type"), F.substring(raw, 1, 30).alias("caption"), raw.alias("detail"))).otherwise(
        F.struct(kind.alias("image_type"), caption.alias("caption"), text(v["detail"]).alias("detail"))
    )


def parse_selection(reply, options) -> Column:
    """The option a reply means: its number, ordinal, whole name, or a part that only one option has; else null."""
    reply, options = F.trim(_c(reply)), _c(options)
    at = lambda n: F.when((n >= 1) & (n <= F.size(options)), F.get(options, n - 1))
    numbers = [at(F.expr("1") * F.regexp_extract(reply, p, 1).try_cast("int")) for p in NUMBERED]
    ordinal = F.element_at(F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv]), F.regexp_replace(reply, r"\s+", ""))
    key = canonical_key(reply)
    exact = F.get(F.filter(options, lambda o: canonical_key(o) == key), 0)
    partial = F.filter(options, lambda o: F.contains(canonical_key(o), key) | F.contains(key, canonical_key(o)))
    return F.when((key != "") & (F.size(options) > 0), F.coalesce(*numbers, at(ordinal), exact, F.when(F.size(partial) == 1, F.get(partial, 0))))


def loose_urls(text) -> Column:
    """Links anywhere in a text, without the punctuation around them, each once in order."""
    found = F.regexp_extract_all(_c(text), F.lit(r"(https?://[^\s]+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, TAIL, ""), HEAD, "")), lambda u: u != ""))


def extract_image_urls(text, loose: bool = False) -> Column:
    """Image links after the last image marker, one on each line or several; `loose` takes the whole text."""
    text = _c(text)
    if loose:
        return F.filter(loose_urls(text), lambda u: u.rlike(IMAGE))
    parts = F.split(text, MARKER)
    lines = F.filter(F.transform(F.split(F.trim(F.element_at(parts, -1)), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    urls = F.flatten(F.transform(lines, lambda x: F.when(x.rlike("^https?://"), F.array(x)).otherwise(loose_urls(x))))
    urls = F.array_distinct(F.filter(F.transform(urls, lambda u: F.regexp_replace(F.trim(u), r"\s", "%20")), lambda u: u.rlike(IMAGE)))
    return F.when(F.size(parts) > 1, urls).otherwise(F.array().cast("array<string>"))

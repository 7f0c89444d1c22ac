"""Documents to chunks: sections, structure-aware splitting, merging, numbering, item context.

Sections, numbering, assembly and item context are plain DataFrame work. The text grammar of long sections (blocks,
packing) is a helper that sees one long body at a time; short sections merge in a pass over dealt and sorted rows.

Sections: doc_id, section_no, title, body, file_title, parent_title, part (null: not split or merged).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.tables import fewest_dashes, linearize_html, linearize_html_tables, linearize_md_tables, linearize_pipes
from kbspark.functions.text import normalize_newlines

# Heading form, fence marks, separators in the order they are tried, and words of image details.
HEADING = r"^\s*(#{1,6})\s+(.+)"
FENCES = ("```", "~~~")
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ".", "!", "?", ";", " ", "")
DETAIL = ("图片类型：", "图片详细内容：")
TITLE_CUT = 50
PACKED = 128  #: rows of a batch that are Python objects at a time
# Words in headings that promise the item's name.
PRIORITY_WORDS = (
    "产品", "商品", "型号", "规格", "参数", "简介", "概述", "名称", "设备", "品牌", "系列", "版本", "服务", "方案", "对象", "介绍",
    "product", "model", "specification", "specifications", "overview", "introduction", "name", "brand", "series", "version", "service",
)
SECTIONS = "doc_id string, section_no int, title string, body string, file_title string, parent_title string, part int"


def split_sections(docs: DataFrame) -> DataFrame:
    """Sections of docs(doc_id, file_title, md_content) at headings outside code fences, with level and parent title."""
    lines = docs.select("doc_id", "file_title", F.posexplode(F.split(normalize_newlines("md_content"), "\n", -1)).alias("n", "line"))
    so_far = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    bare = F.trim(F.col("line"), F.lit(" \t\f\x0b"))
    fence = F.col("fence")
    lines = lines.withColumn("fence", F.startswith(bare, F.lit(FENCES[0])) | F.startswith(bare, F.lit(FENCES[1])))
    lines = lines.withColumn("fenced", F.sum(fence.cast("int")).over(so_far) % 2 == 1)
    lines = lines.withColumn("heading", ~F.col("fenced") & F.col("line").rlike(HEADING)).withColumn("level", F.when(F.col("heading"), F.length(F.regexp_extract("line", HEADING, 1))))
    lines = lines.withColumn("section_no", F.sum(F.col("heading").cast("int")).over(so_far))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("n", "line")))), lambda x: x["line"])
    sections = lines.groupBy("doc_id", "file_title", "section_no").agg(
        F.array_join(ordered, "\n").alias("body"), F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.coalesce(F.max(F.when(F.col("heading"), F.col("line"))), F.lit("")).alias("heading")
    )
    # The parent is the last heading of a smaller level. Per level: the newest heading so far, and where; the nearest one that is smaller wins.
    before = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    found = [F.last(F.when(F.col("level") == k, F.struct("section_no", "heading")), ignorenulls=True).over(before) for k in range(1, 6)]
    for k, c in enumerate(found, 1):
        sections = sections.withColumn(f"_{k}", c)
    parent = F.array_max(F.array(*[F.when(F.col("level") > k, F.col(f"_{k}")) for k in range(1, 6)]))["heading"]
    sections = sections.withColumn("parent_title", parent).drop(*[f"_{k}" for k in range(1, 6)])
    title = F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("file_title"))
    out = sections.where((F.col("heading") != "") | (F.col("body") != ""))
    return out.select("doc_id", F.col("section_no").cast("int").alias("section_no"), "level", title.alias("title"), "body", "file_title", F.coalesce("parent_title", title).alias("parent_title"), F.lit(None).cast("int").alias("part"))


def number_parts(sections: DataFrame) -> DataFrame:
    """Parts numbered anew under each parent title, in order, and the number put behind the title."""
    w = Window.partitionBy("doc_id", "parent_title", F.col("part").isNull()).orderBy("section_no")
    n = F.when(F.col("part").isNotNull(), F.row_number().over(w))
    return sections.withColumn("part", n).withColumn("title", F.when(F.col("part").isNull(), F.col("title")).otherwise(F.concat("title", F.lit("- "), F.col("part").cast("string"))))


def assemble(sections: DataFrame) -> DataFrame:
    """Chunks: title, blank line, body; ids from the document and the chunk's place."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no")) - 1
    return sections.withColumn("chunk_no", place).select(
        "doc_id", "chunk_no", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "title", "file_title", "parent_title", F.concat("title", F.lit("\n\n"), "body").alias("content"), "part"
    )


def structure_blocks(body: str, linearize: bool = True) -> list[tuple[str, str]]:
    """(kind, text) of a body in order: text, table and image; lines inside fences are text."""
    lines, out, plain = body.split("\n"), [], []

    def end_text() -> None:
        text = "\n".join(plain).strip("\n")
        if text:
            out.append(("text", text))
        plain.clear()

    fenced, n = False, 0
    while n < len(lines):
        line = lines[n]
        if line.strip().startswith(FENCES) or fenced:
            fenced ^= line.strip().startswith(FENCES)
            plain.append(line)
            n += 1
            continue
        end, kind = n, ""
        if re.search(r"<table\b", line, re.I):
            kind, end = "table", next((k for k in range(n + 1, len(lines)) if re.search(r"</table\s*>", lines[k], re.I)), len(lines) - 1) + 1
        elif "|" in line and n + 1 < len(lines) and "|" in lines[n + 1] and fewest_dashes(lines[n + 1]) >= 3:
            kind, end = "table", next((k for k in range(n + 2, len(lines)) if "|" not in lines[k]), len(lines))
        elif re.match(r"^\s*!\[.*?\]\(.*?\)\s*$", line):
            kind, end = "image", n + 1
            detail = next((k for k in range(n + 1, len(lines)) if lines[k].strip()), len(lines))
            says = lambda k: k < len(lines) and lines[k].strip().startswith(">") and any(w in lines[k] for w in DETAIL)
            while says(detail):
                detail += 1
                end = detail
        if not kind:
            plain.append(line)
            n += 1
            continue
        end_text()
        text = "\n".join(lines[n:end])
        if kind == "table" and linearize and "<table" in text.lower():
            text = linearize_pipes(linearize_html(text))
        out.append((kind, text.strip()))
        n = end
    end_text()
    return out


def split_text(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters: cut at the first separator that occurs, rejoined while they fit, the rest cut further."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    k = next(n for n, s in enumerate(separators) if s in text)
    sep = separators[k]
    pieces = [p for p in (text.split(sep) if sep else list(text)) if p]
    out, held = [], ""
    for p in pieces:
        if len(p) > size:
            out += [held] if held else []
            out += split_text(p, size, separators[k + 1 :])
            held = ""
        elif held and len(held) + len(sep) + len(p) > size:
            out.append(held)
            held = p
        else:
            held = held + sep + p if held else p
    out += [held] if held else []
    return [x.strip() for x in out if x.strip()]


def pack_body(body: str, size: int) -> list[str]:
    """A body in texts of at most `size` characters; tables and images stay whole and may be longer."""
    texts, held = [], []
    length = 0

    def end() -> None:
        nonlocal length
        if held:
            texts.append("\n\n".join(held).strip())
        held.clear()
        length = 0

    for kind, block in structure_blocks(body):
        block = block.strip()
        for piece in [block] if kind != "text" or len(block) <= size else split_text(block, size):
            if not piece:
                continue
            if len(piece) > size:
                end()
                texts.append(piece)
                continue
            if held and length + 2 + len(piece) > size:
                end()
            length += len(piece) + 2 * bool(held)
            held.append(piece)
    end()
    return texts


def pack_bodies(body: pa.Array, room: pa.Array) -> pa.Array:
    """pack_body of each body (null: null). A batch's texts stay in Arrow buffers; only PACKED rows of it are Python objects at a time."""
    done = []
    for at in range(0, len(body), PACKED):
        some = zip(body.slice(at, PACKED).to_pylist(), room.slice(at, PACKED).to_pylist(), strict=True)
        done.append(pa.array([None if b is None else pack_body(b, n) for b, n in some], pa.list_(pa.string())))
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))


def split_long(sections: DataFrame, max_len: int) -> DataFrame:
    """Sections with n: one over the limit as parts '-1', '-2', ... in the order of n; the title counts with at most TITLE_CUT characters.

    Only bodies over the limit reach the packing helper; one that packs into a single text stays as it is.
    """

    @F.arrow_udf("array<string>")
    def packed(body: pa.Array, room: pa.Array) -> pa.Array:
        return pack_bodies(body, room)

    title = F.substring("title", 1, TITLE_CUT)
    room = F.lit(max_len) - F.length(title) - 2
    rows = sections.withColumn("_texts", packed(F.when((F.length("body") > room) & (room > 0), F.col("body")), room))
    rows = rows.withColumn("_texts", F.when(F.size("_texts") > 1, F.col("_texts")))
    rows = rows.select("*", F.posexplode(F.coalesce("_texts", F.array("body"))).alias("n", "_body"))
    part = F.when(F.col("_texts").isNotNull(), F.col("n") + 1)
    name = F.when(part.isNull(), F.col("title")).otherwise(F.concat(title, F.lit("-"), part.cast("string")))
    return rows.select("doc_id", "section_no", "n", name.alias("title"), F.col("_body").alias("body"), "file_title", "parent_title", part.cast("int").alias("part"))


class Section(NamedTuple):
    doc_id: str
    section_no: int
    title: str
    body: str
    file_title: str
    parent_title: str
    part: int | None


def merged(rows: Iterable[Section], min_len: int, max_len: int) -> Iterator[Section]:
    """Ordered rows, numbered anew in each document: a body shorter than min_len takes in its next neighbour of the same
    parent while the whole fits; the parent's title then stands for both. One row is held at a time."""
    held, no = None, 0
    for s in rows:
        if held and (held.doc_id, held.parent_title) == (s.doc_id, s.parent_title) and len(held.body) < min_len:
            body = held.body.rstrip() + "\n\n" + s.body.lstrip()
            if len(s.parent_title) + 2 + len(body) <= max_len:
                held = held._replace(title=s.parent_title, body=body, part=0)
                continue
        if held:
            yield held
        no = no + 1 if held and held.doc_id == s.doc_id else 0
        held = s._replace(section_no=no)
    if held:
        yield held


def merge_short(sections: DataFrame, min_len: int, max_len: int) -> DataFrame:
    """SECTIONS of split_long's rows: short neighbours merged, by a pass over rows dealt by document and sorted in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int32() if c in ("section_no", "part") else pa.string()) for c in Section._fields])
        parts = (b.slice(at, PACKED) for b in batches for at in range(0, b.num_rows, PACKED))
        rows = (Section(*r) for b in parts for r in zip(*(b.column(c).to_pylist() for c in Section._fields), strict=True))
        found = merged(rows, min_len, max_len)
        while some := list(islice(found, PACKED)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return sections.repartition("doc_id").sortWithinPartitions("doc_id", "section_no", "n").mapInArrow(run, SECTIONS)


def chunk_documents(docs: DataFrame, max_len: int = 2000, min_len: int = 500, linearize: str = "long") -> DataFrame:
    """Chunks (doc_id, chunk_no, chunk_id, title, file_title, parent_title, content, part) of docs(doc_id, file_title, md_content): sections, long ones split, short ones merged, parts numbered.

    `linearize`: "long" rewrites HTML tables only in sections that are split, "always" rewrites all tables.
    Null and empty texts give no chunks, a null file title is the empty one. Equal rows count once; different texts
    of one doc_id are chunked apart, each from number 0. However long a document is, a task holds one section of it at a time
    beyond the cutting at headings.
    """
    if not max_len > min_len > 0 or linearize not in ("long", "always"):
        raise ValueError("needs max_len > min_len > 0 and linearize 'long' or 'always'")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("file_title", F.lit("")).alias("file_title"), "md_content").where("md_content <> ''")
    key = F.to_json(F.struct("doc_id", F.xxhash64("file_title", "md_content").alias("text")))  # a text of a document
    sections = split_sections(rows.withColumn("doc_id", key).dropDuplicates(["doc_id"]))
    if linearize == "always":
        sections = sections.withColumn("body", linearize_md_tables(linearize_html_tables("body")))
    whole = merge_short(split_long(sections, max_len), min_len, max_len).repartition("doc_id")  # for the numbers of both kinds
    chunks = assemble(number_parts(whole)).withColumn("doc_id", F.get_json_object("doc_id", "$.doc_id"))
    return chunks.withColumn("chunk_id", F.concat_ws("-", "doc_id", F.col("chunk_no").cast("string")))


def _near(lines: list[str], limit: int, last_first: bool) -> str:
    """Paragraphs beside an image, nearest first until the limit, other images left out."""
    paragraphs = [[]]
    for line in map(str.strip, lines):
        if not line or re.match(r"^!\[.*?\]\(.*?\)$", line):
            paragraphs.append([])
        else:
            paragraphs[-1].append(line)
    texts = ["\n".join(p) for p in paragraphs if p]
    taken, total = [], 0
    for t in reversed(texts) if last_first else texts:
        if taken and total + len(t) > limit:
            break
        taken.append(t)
        total += len(t)
    return "\n\n".join(reversed(taken) if last_first else taken)


def image_contexts(docs: DataFrame, max_chars: int = 200) -> DataFrame:
    """doc_id, img_name, heading, before, after of each image's first reference in docs(doc_id, md_content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["md_content"], strict=True):
                lines = (text or "").split("\n")
                heads = [n for n, x in enumerate(lines) if re.match(r"^#{1,6}\s+", x)]
                seen = set()
                for n, line in enumerate(lines):
                    for target in re.findall(r"!\[.*?\]\((.*?)\)", line):
                        name = re.sub(r"[?#].*$", "", target.split(" ")[0]).rsplit("/", 1)[-1]
                        if not name or name in seen:
                            continue
                        seen.add(name)
                        above = max((h for h in heads if h < n), default=-1)
                        below = min((h for h in heads if h > n), default=len(lines))
                        rows.append((doc_id, name, lines[above] if above >= 0 else "", _near(lines[above + 1 : n], max_chars, True), _near(lines[n + 1 : below], max_chars, False)))
            yield pd.DataFrame(rows, columns=["doc_id", "img_name", "heading", "before", "after"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "md_content").mapInPandas(run, "doc_id string, img_name string, heading string, before string, after string")


def enrich_images(docs: DataFrame, images: DataFrame) -> DataFrame:
    """docs with image references rewritten from images(doc_id, img_name, url, image_type, caption, detail)."""
    info = images.where("url is not null and url <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("img_name", "url", "image_type", "caption", "detail"))).alias("_images"))

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, found: pd.Series) -> pd.Series:
        def one(t, every):
            for x in every if every is not None else ():
                caption, detail = (x["caption"] or "").strip(), " ".join((x["detail"] or "").split())
                note = f"\n\n> {DETAIL[0]}{(x['image_type'] or '').strip() or 'other'}；{DETAIL[1]}{detail}" if detail else ""
                form = re.compile(r"!\[([^\]]*)\]\([^)]*?" + re.escape(x["img_name"]) + r"[^)]*\)", re.I)
                t = form.sub(lambda m, x=x, note=note, caption=caption: f"![{caption or m[1].strip()}]({x['url']}){note}", t)
            return t

        return pd.Series([t if t is None else one(t, e) for t, e in zip(text, found, strict=True)])

    return docs.join(info, "doc_id", "left").withColumn("md_content", rewrite("md_content", "_images")).drop("_images")


def item_context(chunks: DataFrame, k: int = 3, budget: int = 2500) -> DataFrame:
    """doc_id, context: chunks with promising headings, then the first k, each once, cut at the budget."""
    heading = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("parent_title", F.lit(""))))
    hit = F.lit(False)
    for word in PRIORITY_WORDS:
        hit = hit | F.contains(heading, F.lit(word))
    text = F.trim("content")
    rows = chunks.withColumn("_hit", hit).where((F.col("_hit") | (F.col("chunk_no") < k)) & (F.coalesce(text, F.lit("")) != ""))
    rows = rows.withColumn("piece", F.concat(F.lit("【切片】- "), (F.col("chunk_no") + 1).cast("string"), F.lit(" - "), text))
    order = Window.partitionBy("doc_id").orderBy((~F.col("_hit")).cast("int"), "chunk_no")
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_used", F.coalesce(F.sum(F.length("piece") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where(F.col("_used") < budget).withColumn("piece", F.expr(f"substring(piece, 1, cast({budget} - _used as int))"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "piece"))), lambda x: x["piece"]), "\n\n").alias("context"))


def fill_item_name(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """chunks with item_name: the document's answer(doc_id, item_name), or the file title where it is empty or UNKNOWN."""
    answer = answers.groupBy("doc_id").agg(F.max(F.trim("item_name")).alias("_answer"))
    given = F.when((F.col("_answer") != "") & (F.upper("_answer") != "UNKNOWN"), F.col("_answer"))
    return chunks.join(answer, "doc_id", "left").withColumn("item_name", F.coalesce(given, "file_title")).drop("_answer")

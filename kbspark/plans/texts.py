"""Queries over text functions and chunking, on part, pages and documents.

Raw documents have no headings: every fifth line becomes one, its level from the line number, and every
23rd line opens or closes a code fence.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import tables
from kbspark.functions import text as tx
from kbspark.operators import chunking


def _part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def markdown(spark, d):
    """doc_id, file_title, md_content from documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    level = lambda i: F.array(*map(F.lit, ("# ", "## ", "### ", "#### ")))[((i * 7) % 4).cast("int")]
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 23 == 11, F.lit("```")).when((i % 5 == 1) & (F.trim(x) != ""), F.concat(level(i), F.trim(x))).otherwise(x))
    return docs.select("doc_id", F.col("source").alias("file_title"), F.array_join(lines, "\n").alias("md_content"))


def q_keys(spark, d):
    p = _part(spark, d)
    return p.select("p_partkey", tx.canonical_key(F.concat(F.lit(" "), "p_name", F.lit("-"), "p_brand")).alias("key"))


def q_cache(spark, d):
    p = _part(spark, d)
    return p.select("p_partkey", tx.cache_key(F.concat(F.lit("  "), "p_name", F.lit("   how? ")), F.array(F.concat("p_type", F.lit(" ")), "p_brand", F.lit(" "))).alias("key"))


def q_strip(spark, d):
    p = _part(spark, d)
    asked = F.concat(F.lit("how to  use "), F.upper("p_brand"), F.lit(" "), "p_name", F.lit(" for "), F.col("p_partkey").cast("string"), F.lit(" now"))
    other = F.when(F.col("p_partkey") % 2 == 0, F.lit("unknown")).otherwise(F.lower("p_brand"))
    return p.select("p_partkey", tx.strip_item_names(asked, F.array("p_name", other)).alias("query"))


def q_names(spark, d):
    p = _part(spark, d)
    return p.select("p_partkey", F.array_join(tx.clean_names(F.array(F.concat(F.lit(" "), "p_name", F.lit(" x")), F.lit("  "), "p_type", F.concat("p_type", F.lit(" ")))), "|").alias("names"))


def q_selection(spark, d):
    p = _part(spark, d)
    reply = F.element_at(F.array(F.lit(" 2 "), F.lit("第 3 个"), F.lit("选1"), F.lit("第二 个"), F.upper("p_name"), F.substring("p_brand", 4, 20), F.lit("是的"), F.lit("9号")), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", tx.parse_selection(reply, F.array("p_name", "p_brand", F.concat("p_type", F.lit(" x")))).alias("picked"))


def q_urls(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    base = F.regexp_replace("url", r"[?#].*$", "")
    answer = F.concat(F.lit("see http://a.example/z.png\n【 图片 】\n"), base, F.lit(".png\n"), base, F.lit(".txt\nand ("), base, F.lit(".JPG), "), base, F.lit(".png\n"), base, F.lit("/a b.gif?x=1"))
    return pages.select("page_id", F.array_join(tx.extract_image_urls(answer), "|").alias("images"), F.array_join(tx.extract_image_urls(answer, loose=True), "|").alias("loose"))


def q_image_info(spark, d):
    """Answers of a vision model made from documents: JSON in a fence, or the bare first line."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.trim(F.regexp_replace("text", r"[\s\"\\]+", " ")).alias("t"))
    js = F.concat(F.lit('```json\n{"image_type": " photo", "caption": "", "detail": "'), "t", F.lit('"}\n```'))
    info = tx.parse_image_info(F.when(F.col("doc_id") % 2 == 0, js).otherwise(F.col("t")))
    return docs.select("doc_id", info["image_type"].alias("image_type"), F.trim(info["caption"]).alias("caption"), F.length(info["detail"]).cast("long").alias("n"))


def q_sections(spark, d):
    s = chunking.split_sections(markdown(spark, d))
    return s.select("doc_id", "section_no", "level", "title", "parent_title", F.length("body").cast("long").alias("n"), F.md5("body").alias("body"))


def _numbered(spark, d):
    s = chunking.split_sections(markdown(spark, d)).withColumn("part", F.when(F.col("section_no") % 3 > 0, F.col("section_no")))
    return chunking.assemble(chunking.number_parts(s))


def q_assemble(spark, d):
    return _numbered(spark, d).select("doc_id", "chunk_no", "chunk_id", "title", "parent_title", "part", F.md5("content").alias("content"))


def q_context(spark, d):
    return chunking.item_context(_numbered(spark, d), 3, 400)


def q_fill(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    answers = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).when(F.col("doc_id") % 3 == 1, F.lit("unknown")).otherwise(F.concat(F.lit(" "), "lang")).alias("item_name")).where("doc_id % 5 > 0")
    return chunking.fill_item_name(_numbered(spark, d), answers).groupBy("item_name").agg(F.count("*").alias("n"))


def q_chunks(spark, d):
    """The whole chunking job over all documents."""
    return chunking.chunk_documents(markdown(spark, d)).select("doc_id", "chunk_no", "chunk_id", "title", "parent_title", "part", F.length("content").cast("long").alias("n"))


def q_merged(spark, d):
    """Chunking with a limit that no section of these tables reaches: cutting, merging and numbering alone."""
    return chunking.chunk_documents(markdown(spark, d), 10_000_000, 500).select("doc_id", "chunk_no", "chunk_id", "title", "parent_title", "part", F.md5("content").alias("content"))


def q_tables(spark, d):
    """An HTML table for each brand, one row for each part, as bullets."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    rows = _part(spark, d).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.lit("<tr>"), cell("p_partkey"), cell("p_name"), cell("p_size"), F.lit("</tr>")).alias("t")))).alias("r"))
    table = F.concat(F.lit("<table><tr><th>key</th><th>name</th><th>size</th></tr>"), F.array_join(F.transform("r", lambda x: x["t"]), ""), F.lit("</table>"))
    return rows.select("p_brand", F.trim(F.regexp_replace(tables.linearize_html_tables(table), r"^\n+|\n+$", "")).alias("text"))


def q_md_tables(spark, d):
    rows = _part(spark, d).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.lit(" |")).alias("t")))).alias("r"))
    table = F.concat(F.lit("| key | name |\n|---|---|\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n"))
    return rows.select("p_brand", F.trim(F.regexp_replace(tables.linearize_md_tables(table), r"^\n+|\n+$", "")).alias("text"))


def _pictured(spark, d):
    """Each page as a document: its first lines' words, an image named by its id, and its url."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    word = F.regexp_extract("html", "<title>([^<]*)", 1)
    return p.select(F.col("page_id").cast("string").alias("doc_id"), F.concat(F.lit("# head\n\n"), word, F.lit("\n\n![ alt ](img/p"), F.col("page_id").cast("string"), F.lit(".png)\n![](other.png)\n"), "url").alias("md_content"), "url")


def q_image_contexts(spark, d):
    return chunking.image_contexts(_pictured(spark, d)).where("img_name <> 'other.png'")


def q_enrich(spark, d):
    docs = _pictured(spark, d)
    odd = F.col("doc_id").cast("long") % 2 == 1
    images = docs.select("doc_id", F.concat(F.lit("p"), "doc_id", F.lit(".png")).alias("img_name"), "url", F.lit("photo").alias("image_type"), F.when(odd, F.lit("cap")).otherwise("").alias("caption"), F.when(odd, F.lit("a  b\nc")).otherwise("").alias("detail"))
    return chunking.enrich_images(docs, images).select("doc_id", F.regexp_replace("md_content", r"(?s)^.*?(!\[)", "$1").alias("tail"))


QUERIES = {
    "canonical_key": q_keys, "cache_key": q_cache, "strip_item_names": q_strip, "clean_names": q_names, "parse_selection": q_selection, "extract_image_urls": q_urls, "parse_image_info": q_image_info, "split_sections": q_sections,
    "number_parts_assemble": q_assemble, "item_context": q_context, "fill_item_name": q_fill, "chunk_documents": q_chunks, "chunk_documents_merged": q_merged, "linearize_tables": q_tables, "linearize_md_tables": q_md_tables, "image_contexts": q_image_contexts, "enrich_images": q_enrich,
}

_SECTIONS = """
WITH a AS (SELECT doc_id, source AS file_title, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, file_title, unnest(l) AS x, unnest(range(len(l))) AS n FROM a),
c AS (SELECT doc_id, file_title, n, CASE WHEN n % 23 = 11 THEN '```' WHEN n % 5 = 1 AND trim(x) <> '' THEN repeat('#', CAST((n * 7) % 4 + 1 AS INTEGER)) || ' ' || trim(x) ELSE x END AS line FROM b),
e AS (SELECT *, sum(CASE WHEN starts_with(trim(line), '```') OR starts_with(trim(line), '~~~') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS fenced FROM c),
f AS (SELECT *, NOT fenced AND regexp_matches(line, '^\\s*(#{1,6})\\s+(.+)') AS h FROM e),
g AS (SELECT *, CAST(sum(h::INT) OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS section_no FROM f),
s AS (SELECT doc_id, file_title, section_no, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT h), '') AS body, coalesce(max(length(regexp_extract(line, '^\\s*(#{1,6})\\s+', 1))) FILTER (WHERE h), 0) AS level, coalesce(max(line) FILTER (WHERE h), '') AS heading FROM g GROUP BY ALL),
p AS (SELECT x.doc_id, x.section_no, arg_max(y.heading, y.section_no) AS parent FROM s x JOIN s y ON y.doc_id = x.doc_id AND y.section_no < x.section_no AND y.level < x.level AND y.level > 0 GROUP BY ALL),
sec AS (SELECT s.doc_id, s.file_title, s.section_no, CAST(level AS INTEGER) AS level, CASE WHEN heading <> '' THEN heading ELSE file_title END AS title, body, coalesce(parent, CASE WHEN heading <> '' THEN heading ELSE file_title END) AS parent_title FROM s LEFT JOIN p USING (doc_id, section_no) WHERE heading <> '' OR body <> '')"""
_CHUNKS = _SECTIONS + """,
num AS (SELECT *, CASE WHEN section_no % 3 > 0 THEN CAST(row_number() OVER (PARTITION BY doc_id, parent_title, section_no % 3 > 0 ORDER BY section_no) AS INTEGER) END AS part FROM sec),
chunks AS (SELECT doc_id, file_title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no) - 1 AS INTEGER) AS chunk_no, CASE WHEN part IS NULL THEN title ELSE title || '- ' || part END AS title, parent_title, body, part FROM num),
ch AS (SELECT *, doc_id || '-' || chunk_no AS chunk_id, title || chr(10) || chr(10) || body AS content FROM chunks)"""
_JOINS = "o.parent_title = f.parent_title AND length(f.body) < 500"
_MERGED = _SECTIONS.replace("WITH a AS", "WITH RECURSIVE a AS", 1) + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS i FROM sec),
folded AS (SELECT doc_id, i, 0 AS chunk_no, title, parent_title, body, false AS joined FROM o WHERE i = 1 UNION ALL
  SELECT o.doc_id, o.i, f.chunk_no + CASE WHEN {_JOINS} THEN 0 ELSE 1 END, CASE WHEN {_JOINS} THEN o.parent_title ELSE o.title END, o.parent_title,
    CASE WHEN {_JOINS} THEN rtrim(f.body, E' \\t\\r\\n') || E'\\n\\n' || ltrim(o.body, E' \\t\\r\\n') ELSE o.body END, {_JOINS} FROM folded f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1),
m AS (SELECT doc_id, chunk_no, arg_max(title, i) AS title, arg_max(parent_title, i) AS parent_title, arg_max(body, i) AS body, arg_max(joined, i) AS joined FROM folded GROUP BY ALL),
num AS (SELECT *, CASE WHEN joined THEN CAST(row_number() OVER (PARTITION BY doc_id, parent_title, joined ORDER BY chunk_no) AS INTEGER) END AS part FROM m),
ch AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, doc_id || '-' || chunk_no AS chunk_id, CASE WHEN joined THEN title || '- ' || part ELSE title END AS title, parent_title, part, body FROM num)
SELECT doc_id, chunk_no, chunk_id, title, parent_title, part, md5(title || E'\\n\\n' || body) AS content FROM ch"""
_HIT = " OR ".join(f"contains(t, '{w}')" for w in chunking.PRIORITY_WORDS)
_BULLETS = "SELECT p_brand, string_agg('- 【' || p_partkey || '】(对应key)：' || {} || '。', chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand"
SQL = {
    "canonical_key": r"SELECT p_partkey, regexp_replace(lower(trim(' ' || p_name || '-' || p_brand)), '[\s\-_]+', '', 'g') AS key FROM part",
    "cache_key": r"SELECT p_partkey, 'hyde:' || sha256(trim(regexp_replace(p_name, '\s+', ' ', 'g') || ' how?') || '|' || least(p_brand, trim(p_type)) || '|' || greatest(p_brand, trim(p_type))) AS key FROM part",
    "strip_item_names": "SELECT p_partkey, 'how to use ' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) || ' ' ELSE '' END || 'for ' || p_partkey || ' now' AS query FROM part",
    "clean_names": "SELECT p_partkey, CASE WHEN trim(substring(p_name || ' x', 1, 15)) = p_type THEN p_type ELSE substring(p_name || ' x', 1, 15) || '|' || substring(p_type, 1, 15) END AS names FROM part",
    "parse_selection": "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_brand WHEN 1 THEN p_type || ' x' WHEN 2 THEN p_name WHEN 3 THEN p_brand WHEN 4 THEN p_name WHEN 5 THEN CASE WHEN contains(replace(lower(p_name), ' ', ''), lower(substring(p_brand, 4, 20))) THEN NULL ELSE p_brand END END AS picked FROM part",
    "extract_image_urls": r"""WITH b AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages) SELECT page_id, u || '.png|' || u || '.JPG|' || u || '/a%20b.gif?x=1' AS images, 'http://a.example/z.png|' || u || '.png|' || u || '.JPG' AS loose FROM b""",
    "parse_image_info": r"""WITH a AS (SELECT doc_id, trim(regexp_replace(text, '[\s"\\]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'photo' ELSE 'unknown' END AS image_type, trim(substring(t, 1, 30)) AS caption, length(t) AS n FROM a""",
    "split_sections": _SECTIONS + " SELECT doc_id, section_no, level, title, parent_title, length(body) AS n, md5(body) AS body FROM sec",
    "number_parts_assemble": _CHUNKS + " SELECT doc_id, chunk_no, chunk_id, title, parent_title, part, md5(content) AS content FROM ch",
    "chunk_documents_merged": _MERGED,
    "item_context": _CHUNKS + f""", k AS (SELECT *, {_HIT} AS hit FROM (SELECT *, lower(title || ' ' || parent_title) AS t FROM ch)),
q AS (SELECT doc_id, '【切片】- ' || (chunk_no + 1) || ' - ' || trim(content) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY (NOT hit)::INT, chunk_no) AS i FROM k WHERE (hit OR chunk_no < 3) AND trim(content) <> ''),
r AS (SELECT *, coalesce(sum(length(piece) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM q)
SELECT doc_id, string_agg(substring(piece, 1, CAST(400 - used AS INTEGER)), chr(10) || chr(10) ORDER BY i) AS context FROM r WHERE used < 400 GROUP BY doc_id""",
    "fill_item_name": _CHUNKS + """ SELECT CASE WHEN ch.doc_id % 3 = 2 AND ch.doc_id % 5 > 0 THEN lang ELSE file_title END AS item_name, count(*) AS n FROM ch JOIN documents d ON d.doc_id = ch.doc_id GROUP BY ALL""",
    "linearize_tables": _BULLETS.format("'name为' || p_name || '，size为' || p_size"),
    "linearize_md_tables": _BULLETS.format("'name为' || p_name"),
    "image_contexts": r"SELECT CAST(page_id AS VARCHAR) AS doc_id, 'p' || page_id || '.png' AS img_name, '# head' AS heading, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS before, url AS after FROM pages",
    "enrich_images": r"""SELECT CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN page_id % 2 = 1 THEN '![cap](' || url || ')' || chr(10) || chr(10) || '> 图片类型：photo；图片详细内容：a b c' ELSE '![alt](' || url || ')' END || chr(10) || '![](other.png)' || chr(10) || url AS tail FROM pages""",
}

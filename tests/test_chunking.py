import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.functions.tables import linearize_html, linearize_pipes
from kbspark.operators import chunking

DOC = "intro\n## X\nx\n```\n# not a heading\n```\n# Y\ny\n### Z\nz"


def test_sections_row_local_and_native_agree(spark):
    rng = random.Random(1)
    lines = ["# a", "## b", "### c", "###### d", "text", "", "```", "~~~ x", "  # e", "#no", "#  f "]
    docs = [("0", "file", DOC), ("1", "file", ""), ("2", "file", "# only")] + [(str(k), "file", "\n".join(rng.choices(lines, k=rng.randint(1, 25)))) for k in range(3, 120)]
    got = {}
    for r in chunking.split_sections(spark.createDataFrame(docs, "doc_id string, file_title string, md_content string")).orderBy("section_no").collect():
        got.setdefault(r.doc_id, []).append((r.title, r.body, r.parent_title))
    for key, title, text in docs:
        assert got.get(key, []) == plain_sections(text, title), text
    assert [(t, p) for t, _, p in got["0"]] == [("file", "file"), ("## X", "## X"), ("# Y", "# Y"), ("### Z", "# Y")]


@given(st.text("ab \n。.!?", max_size=300), st.integers(3, 40))
@settings(max_examples=150, deadline=None)
def test_split_text_keeps_letters_and_the_limit(text, size):
    pieces = chunking.split_text(text, size)
    keep = lambda s: [c for c in s if c in "ab"]
    assert all(0 < len(p) <= size for p in pieces) and keep("".join(pieces)) == keep(text)


def test_blocks_stay_whole():
    table = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 30
    image = "![x](y.png)\n\n> 图片类型：photo；图片详细内容：" + "d" * 50
    body = "para one.\n" * 20 + table + "\n" + image + "\ntail"
    kinds = [k for k, _ in chunking.structure_blocks(body)]
    assert kinds == ["text", "table", "image", "text"] and [k for k, _ in chunking.structure_blocks("```\n" + table + "```")] == ["text"]
    texts = chunking.pack_body(body, 80)
    assert table.strip() in texts and any(image in t for t in texts) and all(len(t) <= 80 or t in (table.strip(), image) for t in texts)


def _sections(*rows):
    return [chunking.Section(d, n, t, b, "f", p, None) for n, (d, t, b, p) in enumerate(rows)]


def test_short_neighbours_merge():
    s = _sections(("1", "a", "1" * 10, "P"), ("1", "b", "2" * 10, "P"), ("1", "c", "3" * 10, "Q"), ("1", "d", "4" * 90, "Q"), ("1", "e", "5", "Q"), ("2", "e", "5", "Q"))
    merged = list(chunking.merged(s, 20, 60))
    assert [(m.doc_id, m.section_no, m.title, m.part) for m in merged] == [("1", 0, "P", 0), ("1", 1, "c", None), ("1", 2, "d", None), ("1", 3, "e", None), ("2", 0, "e", None)]
    assert merged[0].body == "1" * 10 + "\n\n" + "2" * 10


def plain_sections(text, file_title):
    """Sections by one pass over a document's lines: (title, body, parent title)."""
    out, open_titles, title, level, body, fenced = [], {}, "", 0, [], False

    def end():
        if title or "\n".join(body):
            above = [open_titles[k] for k in sorted(open_titles) if k < level]
            out.append((title or file_title, "\n".join(body), above[-1] if above else title or file_title))

    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        fenced ^= line.strip().startswith(chunking.FENCES)
        m = None if fenced else re.match(chunking.HEADING, line)
        if not m:
            body.append(line)
            continue
        end()
        title, level, body = line, len(m[1]), []
        open_titles = {k: t for k, t in open_titles.items() if k < level} | {level: line}
    end()
    return out


def plain_chunks(text, file_title, max_len, min_len, always):
    """(title, content, part) of one document, step by step over lists."""
    rows = []
    for title, body, parent in plain_sections(text, file_title) if text else []:
        body = linearize_pipes(linearize_html(body)) if always else body
        short, room = title[: chunking.TITLE_CUT], max_len - len(title[: chunking.TITLE_CUT]) - 2
        texts = chunking.pack_body(body, room) if 0 < room < len(body) else []
        for row in [(f"{short}-{n}", t, parent, n) for n, t in enumerate(texts, 1)] if len(texts) > 1 else [(title, body, parent, None)]:
            if rows and rows[-1][2] == parent and len(rows[-1][1]) < min_len and len(parent) + 2 + len(both := rows[-1][1].rstrip() + "\n\n" + row[1].lstrip()) <= max_len:
                rows[-1] = (parent, both, parent, 0)
            else:
                rows.append(row)
    out, count = [], {}
    for title, body, parent, part in rows:
        if part is not None:
            part = count[parent] = count.get(parent, 0) + 1
            title += f"- {part}"
        out.append((title, f"{title}\n\n{body}", part))
    return out


DOCS = "doc_id string, file_title string, md_content string"


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("1", "f", "# T\n" + "long words here. " * 60), ("2", "f", None), ("3", "f", "tiny"), ("4", "f", "")], DOCS)
    got = chunking.chunk_documents(docs, 300, 50).orderBy("doc_id", "chunk_no").collect()
    assert all(len(r.content) <= 310 for r in got) and [r.part for r in got if r.doc_id == "1"] == list(range(1, sum(r.doc_id == "1" for r in got) + 1))
    assert [(r.chunk_id, r.content) for r in got if r.doc_id == "3"] == [("3-0", "f\n\ntiny")] and {r.doc_id for r in got} == {"1", "3"}
    assert chunking.chunk_documents(docs.limit(0)).count() == 0


def test_chunk_documents_as_a_plain_version(spark):
    rng = random.Random(2)
    lines = ["# a", "## b", "## b", "### c", "short text", "", "```", "some more words, enough to be cut. " * 3, "<table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table>", "![x](y.png)", "| a | b |\n|---|---|\n| 1 | 2 |", "carriage\r\nreturn", "  # e"]
    docs = [(str(k), "file", "\n".join(rng.choices(lines, k=rng.randint(1, 40)))) for k in range(80)]
    docs += [(None, None, "# a\nno id"), ("two", "file", "# a\none"), ("two", "file", "# a\nother"), ("again", "file", "# a\nx"), ("again", "file", "# a\nx")]
    table = spark.createDataFrame(docs, DOCS).repartition(5)
    for max_len, min_len, linearize in ((120, 40, "long"), (300, 200, "always"), (100_000, 500, "long")):
        want = sorted((k or "", n, *c[:2], c[2] or 0) for k, title, text in set(docs) for n, c in enumerate(plain_chunks(text, title or "", max_len, min_len, linearize == "always")))
        got = sorted((r.doc_id or "", r.chunk_no, r.title, r.content, r.part or 0) for r in chunking.chunk_documents(table, max_len, min_len, linearize).collect())
        assert got == want


def test_images(spark):
    text = "# H\n\nabove\n\n![other](o.png)\nnear\n\n![alt](img/a.png)\n\nbelow\n\nfar " + "x" * 300 + "\n# Next\nno"
    docs = spark.createDataFrame([("1", text)], "doc_id string, md_content string")
    r = {x.img_name: x for x in chunking.image_contexts(docs, 30).collect()}["a.png"]
    assert (r.heading, r.before, r.after) == ("# H", "above\n\nnear", "below")
    images = spark.createDataFrame([("1", "a.png", "http://u/a", "photo", "", "two\nlines")], "doc_id string, img_name string, url string, image_type string, caption string, detail string")
    out = chunking.enrich_images(docs, images).first()["md_content"]
    assert "![alt](http://u/a)\n\n> 图片类型：photo；图片详细内容：two lines" in out and "![other](o.png)" in out


def test_item_context_is_cut_at_the_budget(spark):
    chunks = spark.createDataFrame([("1", k, t, "", "c" * 50) for k, t in enumerate(["a", "b", "c", "d", "model X"])], "doc_id string, chunk_no int, title string, parent_title string, content string")
    text = chunking.item_context(chunks, 2, 100).first()["context"]
    assert text.startswith("【切片】- 5 - c") and len(text) == 100 and "- 1 -" in text
    assert chunking.fill_item_name(chunks.withColumn("file_title", F.lit("F")), spark.createDataFrame([("1", " unknown ")], "doc_id string, item_name string")).first()["item_name"] == "F"


def test_packing_holds_few_texts_of_a_batch_at_a_time(monkeypatch):
    import gc

    import pyarrow as pa

    class Text(str):
        pass

    most = []
    monkeypatch.setattr(chunking, "PACKED", 4)
    monkeypatch.setattr(chunking, "pack_body", lambda b, n: most.append(sum(isinstance(x, list) and len(x) == 1 and isinstance(x[0], Text) for x in gc.get_objects())) or [Text(b[:n])])
    got = chunking.pack_bodies(pa.array([None if n % 5 == 0 else f"{n:03d} word" for n in range(50)]), pa.array([3] * 50, pa.int32()))
    assert got.to_pylist() == [None if n % 5 == 0 else [f"{n:03d}"] for n in range(50)] and max(most) <= 4
    assert chunking.pack_bodies(pa.array([], pa.string()), pa.array([], pa.int32())).to_pylist() == []

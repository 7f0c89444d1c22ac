import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kbspark.llm import decontam, html_extract, lines, minhash, pii, shingles, toxicity


def brute_base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    fixed = ["a@b.c%d@e.f a@@b.c x@y a@b.c@d.e", "1.2.3.4.5 1.2.3 256.1.1.1 0001.2.3.4 1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111-1", "+1 (555) 123-4567 +49 30 12 34 567 +1"]
    for t in fixed + ["".join(rng.choices("ab@.%+ 0123459-()\n", k=60)) for _ in range(3000)]:
        assert pii.base_spans(t) == brute_base(t), t


def test_field_spreads_labels_to_repeats():
    field = pii.fit(["Call +49 30 1234567 now", "server 10.1.2.3 up", "write to a.b@site.org", "room 12 on floor 3", "order 77 from 2020"] * 30)
    (base, every), (none, nothing) = pii.find(["Call +49301234567 now. Again 49301234567 please.", "room 12"], field)
    assert [k for k, *_ in base] == [3] and set(base) < set(every) and nothing == none == []


def test_one_base_span_reaches_all_repeats():
    field = pii.fit(["Call +49 30 1234567 now", "server 10.1.2.3 up", "write to a.b@site.org", "room 12 on floor 3", "order 77 from 2020"] * 30)
    text = "Call +49301234567 now. " + "Again 49301234567 please. " * 49
    (base, every), _ = pii.find([text, "room 12"], field)
    assert len(base) == 1 and len(every) == 50 and {k for k, *_ in every} == {3}
    assert pii.find(["Room 4123 here. " * 50], field)[0] == ([], [])


def test_pii_over_odd_documents(odd, none):
    rows = {r.doc_id: r for r in pii.find_spans(odd).collect()}
    assert (rows[8].n_email, rows[8].n_ip, rows[8].n_card, rows[8].n_phone) == (1, 1, 1, 1) and rows[2].base == rows[5].base == ""
    assert pii.find_spans(none).count() == 0


def brute_components(docs, percent=75):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) else set() for k, t in docs}
    group = {k: k for k in sets}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {k: (len(sets[k]), top(k)) for k in keys}


@pytest.fixture(scope="module")
def copies():
    """A large group of near copies around the threshold, chains, exact copies, and unlike texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    base = [word() for _ in range(120)]
    docs = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = word()
        docs.append(" ".join(w))
    docs += [docs[3]] * 20 + [" ".join(word() for _ in range(80)) for _ in range(60)] + ["one two", "One TWO", "x", None, "", "a b c d e", "a b c d e f"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_near_duplicates_are_exact(spark, copies):
    got = minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(copies)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_over_odd_documents(odd, none):
    got = {r.doc_id: r for r in minhash.near_duplicates(odd).collect()}
    assert got[6].component_id == 1 and not got[6].kept and got[2].n_shingles == got[4].n_shingles == 0 and got[2].kept and got[5].n_shingles == 1
    assert minhash.near_duplicates(none).count() == 0


def test_blocks_find_every_open_link(spark, monkeypatch):
    """2000 pairs of similarity 101 / 131, each in components of its own, in blocks of a few rows; every pair shares a bucket."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    rng, docs = random.Random(8), []
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    for n in range(2000):
        w = [word() for _ in range(120)]
        other = list(w)
        for at in (20, 60, 90):
            other[at] = "x" + word()
        docs += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(other))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    reps = minhash.cut(minhash.sketch(df), "test")
    members = reps.select(F.col("doc_id").alias("id"), F.posexplode("keys").alias("band", "key")).select("key", "band", "id")
    rows = minhash.contested(members.where("key is not null"), spark.createDataFrame([], "node long, component long"))
    signed = minhash.marks(rows, reps)
    rows = rows.join(minhash.flagged(rows, signed, 0.75), ["key", "id"], "left_semi")
    got = minhash.block_links(rows, signed, df, 75).collect()
    assert {(r.a, r.b) for r in got} == {(2 * n, 2 * n + 1) for n in range(2000)} and len(got) == 2000


def test_a_group_of_failing_pairs_makes_no_rows(spark):
    """300 texts of similarity 0.6 to 0.74 to each other: the blocks meet them all and put out next to nothing."""
    rng = random.Random(9)
    base = [f"w{n}" for n in range(200)]
    docs = []
    for k in range(300):
        w = list(base)
        for at in range(rng.randint(0, 9), 200, 25):
            w[at] = f"x{k}y{at}"
        docs.append((k, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_rows_of_one_doc_id_are_one_document(spark):
    w, v = (" ".join(f"{c}{n}" for n in range(40)) for c in "wv")
    rows = [(5, w), (5, v), (1, w + " more"), (2, v + " more"), (5, w), (7, "other words that stand alone here"), (None, v)]
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1), (5, 1), (5, 1), (5, 1), (7, 7)]


def test_shingle_words():
    one = lambda t: shingles.word_hashes(shingles.words(t)).tolist()
    assert one("A\x1cb É\x85x\x0bY") == one("a\x1cb") + one("É\x85x") + one("y") and len(one("É\x85x")) == 1 and one("É") != one("é")
    assert one("") == one(" \n ") == [] and one("  a b\t") == one("a") + one("b")
    texts = ["".join(random.Random(n).choices("ab 0", k=9)) for n in range(3000)]
    found = {w: h for t in texts for w, h in zip(t.split(), one(t), strict=True)}
    assert len(set(found.values())) == len(found) > 500


PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion under the old stone bridge"


def decontamination_tables(spark, odd):
    w = PASSAGE.split()
    docs = [(20, "x y z " * 50 + PASSAGE + " tail"), (21, " ".join(w[10:] + ["and", "then"] + w[:10])), (22, " ".join(w[:6])), (23, PASSAGE.upper() + "!"), (24, "short"), (25, "nothing of the kind")]
    items = [(1, PASSAGE), (2, "short"), (3, None), (4, "")]
    return spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text")), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, odd, none, limit):
    docs, items = decontamination_tables(spark, odd)
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, items, broadcast_bytes=limit).collect()}
    assert set(got) == {(20, 1), (21, 1), (23, 1), (24, 2)} and got[21, 1].n_tiles == 2 and got[21, 1].covered == len(PASSAGE.split())
    assert decontam.contaminated(none, items, broadcast_bytes=limit).count() == 0
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} >= {22, 25, 1, 2}


def brute_tiles(item, doc, match):
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    match = min(match, len(item))

    def length(p, t):
        n = 0
        while p + n < len(item) and t + n < len(doc) and free_i[p + n] and free_d[t + n] and item[p + n] == doc[t + n]:
            n += 1
        return n

    while match:
        best = max(((length(p, t), -t, -p) for t in range(len(doc)) for p in range(len(item))), default=(0, 0, 0))
        if best[0] < match:
            break
        n, t, p = best[0], -best[1], -best[2]
        free_i[p : p + n] = free_d[t : t + n] = [False] * n
        out.append((p, t, n))
    return out


def test_tiles_against_brute_force():
    rng = random.Random(1)
    for n in range(400):
        words = "abc" if n % 2 else "abcdefghijkl"
        item, doc = (decontam.tokens(" ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(2))
        assert decontam.tile(item, doc, 1 + n % 5) == brute_tiles(item.tolist(), doc.tolist(), 1 + n % 5)


def test_tiling_of_repetitive_texts_is_fast():
    one, two = decontam.tokens("word " * 20_000), decontam.tokens("word " * 5_000)
    mixed = decontam.tokens(" ".join("x" if k % 97 == 0 else "word" for k in range(20_000)))
    began = time.time()
    assert decontam.tile(two, one) == [(0, 0, 5000)] and sum(n for *_, n in decontam.tile(two, mixed)) >= 4900
    assert time.time() - began < 3


def test_both_ways_give_the_same_rows(spark, odd):
    rng = random.Random(15)
    text = lambda n: " ".join(rng.choices("the of a cow farmer said red blue house sky".split(), k=n))
    items = [(k, text(rng.randint(1, 30))) for k in range(40)] + [(3, text(9)), (None, "x"), (50, "word " * 40)]
    docs = [(k % 70 if k % 9 else None, " ".join([text(rng.randint(0, 20)), rng.choice(items)[1], text(9), rng.choice(items)[1]])) for k in range(90)]
    docs += [(1, items[5][1]), (2, items[5][1]), (2, "a cow")] + [(k, items[k][1]) for k in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    items = spark.createDataFrame(items, "item_id long, text string")
    one, two = (sorted(map(repr, decontam.contaminated(docs, items, broadcast_bytes=limit).collect())) for limit in (1 << 20, 0))
    assert one == two and len(one) > 100


def brute_lines(docs):
    """The rules of line dedup, with whole tokens and sets of texts: {text: text that stays}."""
    split, found, rare = re.compile(r"((?<=[.!?])\s+|\n+)"), {}, {}
    everything = {t: split.split(t) for _, t in docs if t}
    first = {}
    for k, t in docs:
        first[t] = min(first.get(t, k), k)
    for t, parts in everything.items():
        for n, w in enumerate(w for p in parts[::2] if (w := p.split())):
            if len(w) >= 4:
                m = [None if any(map(str.isdigit, x)) else x for x in w]
                m = w if m.count(None) * 2 > len(m) else m
                found.setdefault((len(w), *(w if m is w and any(any(map(str.isdigit, x)) for x in w) else m[:3])), []).append((t, n, tuple(m)))
    of = {}
    for leaf, rows in found.items():
        support = {}
        for t, _, m in rows:
            for p, x in enumerate(m):
                support.setdefault((p, x), set()).add(t)
        for t, n, m in rows:
            c = tuple((p, x) for p, x in enumerate(m) if x is not None and not any(map(str.isdigit, x)) and len(support[p, x]) >= 3)
            of.setdefault((leaf, c if len(c) >= max(6, 0.8 * len(m)) and len(c) < len(m) else m), []).append((t, n, len(m)))
    tokens = {t: sum(len(p.split()) for p in parts[::2] if len(p.split()) >= 4) for t, parts in everything.items()}
    shared, owner = {}, {}
    for k, rows in of.items():
        o = owner[k] = min({t for t, *_ in rows}, key=lambda t: first[t])
        for t in {t for t, *_ in rows} - {o}:
            shared[o, t] = shared.get((o, t), 0) + max(s for u, _, s in rows if u == t)
    gone = {}
    for k, rows in of.items():
        o = owner[k]
        left = {t for t, *_ in rows if t != o and shared[o, t] < 0.5 * max(tokens[o], tokens[t])}
        for t, n, size in rows:
            if t in left:
                gone.setdefault(t, []).append((n, size, len(left) + 1 >= 3))
    return {t: lines.without(t, sorted(gone[t]))[0] if t in gone else t for t in everything}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "a", "farmer", "said", "cow", "runs", "item", "7", "12", "red", "blue", "end"])
    pool = [" ".join(word() for _ in range(rng.randint(2, 14))) + rng.choice([".", "", "!"]) for _ in range(60)]
    passage = " ".join(pool[:9])
    docs = []
    for k in range(120):
        p = [rng.choice(pool) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 12))) + "." for _ in range(rng.randint(1, 9))]
        p = ["Licensed to user " + rng.choice("ABCDEFGHIJKLM") * 3 + " under the terms of the red house." if rng.random() < 0.3 else x for x in p]
        docs.append((k, rng.choice([" ", "\n"]).join(p + [passage] * (k % 31 == 0))))
    docs += [(200 + k, docs[k][1]) for k in range(5)] + [(300 + k, docs[k][1] + " One more. Words at the very end here.") for k in range(5)]
    got = {r.doc_id: r.text for r in lines.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_lines(docs)
    assert {k: want.get(t, t) for k, t in docs} == got and any(want[t] != t for t in want)


def test_unlike_lines_of_one_form_stay(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    docs = [(k, f"{word()} {word()} {word()} {word()} stands alone\nthe farmer said {word()} {word()}") for k in range(400)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert lines.drop_lines(rows).agg(F.sum("n_dropped")).first()[0] == 0


def test_a_passage_of_two_documents_goes_once(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    say = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = " ".join(say(n) for n in (12, 3, 9, 2, 14, 16))
    long = [" ".join(say(11) for _ in range(9)) for _ in range(4)]
    docs = [(1, f"{long[0]} {passage} {long[1]}"), (2, f"{long[2]}\n{passage}\n{long[3]}"), (3, long[0] + " " + say(8)), (4, say(9))]
    got = {r.doc_id: r.text for r in lines.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: f"{long[2]}\n{long[3]}", 3: docs[2][1].removeprefix(long[0] + " "), 4: docs[3][1]}
    near = [(1, f"{long[0]} {long[1]}"), (2, f"{long[0]} {long[1]} {say(7)}")]
    assert {r.doc_id: r.text for r in lines.drop_lines(spark.createDataFrame(near, "doc_id long, text string")).collect()} == dict(near)


def test_line_templates(spark, odd, none):
    shared = "Server 17 answered in 32 ms after the third try today"
    rows = [(30 + k, f"{chr(97 + k) * 6} opens a line of its own that is kept, {chr(97 + k) * 4} and {chr(97 + k) * 5} too, {chr(97 + k) * 7} as well.\n{shared.replace('32', str(k))}\n\nok") for k in range(4)]
    rows += [(40, rows[0][1]), (41, None), (42, shared), (31, "a second text of this id"), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text")).selectExpr("*", "doc_id as n_lines", "'t' as template", "1 as copy", "2 as gone", "3 as n_dropped")
    got = {(r.doc_id, r.text is None or len(r.text)): r for r in lines.drop_lines(docs).collect()}
    by = {k: r for (k, _), r in got.items() if (k, r.text) != (31, "a second text of this id")}
    assert shared[:6] in by[30].text and by[40].text == by[30].text and by[41].text is None
    assert all(by[k].n_dropped == 1 and shared[:6] not in by[k].text for k in (31, 32, 33)) and by[42].text == by[None].text == "" and by[42].n_dropped == 1
    assert by[31].text == rows[1][1].split("\n")[0] + "\n\nok" and by[1].n_dropped == 0 and by[31].template == "t" and by[31].gone == 2 and by[31].n_lines == 4
    assert (31, len("a second text of this id")) in got and len(got) == 17
    assert lines.drop_lines(none).count() == 0


def test_rows_of_numbers_are_not_one_line(spark):
    rows = [(n, f"{n} {n + 7} {n * 3} {n + 90}\nrow {n} {n + 1} {n + 2}\n5 6 7 8") for n in range(6)]
    got = {r.doc_id: r.text for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: t if n == 0 else t.rsplit("\n", 1)[0] for n, t in rows}


def test_page_text():
    w = html_extract.fit([])
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>
      <article><h1>Title &amp; more</h1><p><b>First   paragraph<br>goes on.<p>Second &lt;one&gt; <a href="a>b">link</a>.<div class="comments"><p>I love this!</p></div><aside>More</aside><form><p>Mail</p></form></article><footer>&copy; x</footer>"""
    assert html_extract.main_text(page, w) == "Title & more\nFirst paragraph goes on.\nSecond <one> link."
    assert [html_extract.main_text(x, w) for x in ("", "<p>", "<div", "<!-- x", "</p></div>")] == [""] * 5


def test_unclosed_controls_lose_no_text():
    w, text = html_extract.fit([]), "<article><h1>Head</h1><p>First text.</p><ul><li>One</li></ul></article>"
    for tag in ("button", "video", "svg", "select", "object", "noscript", "template"):
        for start in (f"<header><{tag}>Menu</header>", f"<{tag}>Menu", f"<div><{tag}>Menu</div>"):
            assert html_extract.main_text(start + text, w) == "Head\nFirst text.\nOne", start
            assert html_extract.main_text(f"{start}{text}<div><{tag}>x</{tag}></div>", w) == "Head\nFirst text.\nOne", start
    assert html_extract.main_text("<article><p>Some <button><div>Copy</div></button> text <svg><svg/><title>t</title></svg>here.</p></article>", w) == "Some text here."


def test_an_article_clears_names_of_its_wrappers():
    w, text = html_extract.fit([]), "<h1>Head</h1><p>First text.</p><ul><li>One</li></ul>"
    for name in ("layout no-sidebar", "sidebar", "page-header", "cookie", "share", "widget"):
        for tag in ("article", "main"):
            assert html_extract.main_text(f"<div class='{name}'><p>Side.</p><{tag}>{text}</{tag}></div>", w).endswith("Head\nFirst text.\nOne"), name
    for page in ("<div id=comments><article>{}</article></div>", "<nav><article>{}</article></nav>", "<article><div class=widget><article>{}</article></div></article>"):
        assert html_extract.main_text(page.format(text), w) == "", page


def test_whole_articles_stay():
    w, text = html_extract.fit([]), "<h1>Head</h1><p>First text.</p>"
    for page in (
        "<form runat=server><header>Site</header><nav>Menu</nav><article>{}</article><footer>End</footer></form>",
        "<div class='post comments-open'><article>{}</article></div>",
        "<div class='related-posts-layout'><article>{}</article></div>",
        "<!--><article>{}</article>",
        "<!---><article>{}</article><!-- x -->",
        "<article>{}<form><p>Mail us.</p></form></article>",
        "<article>{}<div class='widget post-widget'><p>More.</p></div></article>",
    ):
        assert html_extract.main_text(page.format(text), w) == "Head\nFirst text.", page
    paragraph = "<p>A paragraph of the article, which tells a story in many words and goes on and on to its end.</p>"
    taught = html_extract.fit([f"<nav><ul><li><a href=x>Home {n}</a></li></ul></nav><article><h1>Head</h1>{paragraph * 3}</article>" for n in range(40)])
    assert html_extract.main_text(f"<div class='single-post share-buttons-top'>{paragraph * 2}</div>", taught).count("\n") == 1


def test_the_cut_keeps_lists_and_lone_links_of_an_article():
    paragraph = "<p>A paragraph of the article, which tells a story in many words and goes on and on to its end.</p>"
    page = f"<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div class=ad>Buy now.</div><article><h1>Head</h1>{{}}{paragraph}</article>"
    w = html_extract.fit([page.format(paragraph * n) for n in range(1, 40)])
    look = lambda x: html_extract.costs(html_extract.blocks(x), w)
    got = lambda x: html_extract.main_text(page.format(x), w).split("\n")[1:-1]
    assert got("<ul><li>One</li><li>Two parts</li></ul>") == ["One", "Two parts"]
    lone = page.format(paragraph + "<ul><li><a href=s>Source</a></li></ul>")
    assert min(look(lone)[4:]) < 0  # its look speaks against it; its neighbours keep it
    assert got(paragraph + "<ul><li><a href=s>Source</a></li></ul>")[-1] == "Source"
    assert "Link 3" not in got(paragraph + "<ul>" + "".join(f"<li><a href=s>Link {n}</a></li>" for n in range(12)) + "</ul>")
    assert "Buy." not in got(f"{paragraph}<div class=ad><p>Buy.</p></div>{paragraph}")


def _narrow(rng, n, values):
    links = [(i - 1, i, rng.choice(values)) for i in range(1, n)] + [(i - 2, i, rng.choice(values)) for i in range(2, n) if rng.random() < 0.5]
    return [rng.choice((-1, 1)) * rng.choice(values) for _ in range(n)], links


def test_flow_and_linear_pass_are_one_cut(monkeypatch):
    rng = random.Random(5)
    for trial in range(300):
        cost, links = _narrow(rng, rng.randint(2, 40), (0.1, 0.2, 0.3, 0.5) if trial % 2 else [rng.random() for _ in range(9)])
        monkeypatch.setattr(html_extract, "PHASES", 10**9)
        flow = html_extract.min_cut(cost, links)
        monkeypatch.setattr(html_extract, "PHASES", 0)
        assert html_extract.min_cut(cost, links) == flow
    monkeypatch.undo()


def test_very_long_pages_take_linear_time():
    import time

    rng, n = random.Random(7), 20_000
    slope = [0.0001 if i < n // 2 else -0.0001 for i in range(n)], [(i - 1, i, 1.0) for i in range(1, n)]
    start = time.time()
    for cost, links in (_narrow(rng, n, (0.1, 0.2, 0.3, 0.5)), slope):
        html_extract.min_cut(cost, links)
    assert html_extract.main_text("<button " * 20_000 + "<article><p>Text.</p></article>", html_extract.fit([])) in ("", "Text.")
    long = "<article>" + "<p>Some text of the page stands here.</p><ul><li><a href=x>Link</a></li></ul>" * n + "</article>"
    assert html_extract.main_text(long, html_extract.fit([])).count("\n") == 2 * n - 1
    assert time.time() - start < 60


def test_min_cut_is_a_minimum():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 7)
        cost = [rng.choice([-2, -1, -0.5, 0.25, 1, 3]) * rng.random() for _ in range(n)]
        links = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.6]
        value = lambda lab: sum(max(0, c) if not x else max(0, -c) for c, x in zip(cost, lab)) + sum(w for a, b, w in links if lab[a] != lab[b])  # noqa: B023, B905, E731
        best = min(value([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert value(html_extract.min_cut(cost, links)) == pytest.approx(best)


def test_pages_over_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<article><p>Good text stands here.</p></article>", "x"), (3, "u", "<article><p>Good text stands here.</p></article>", "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "Good text stands here.", 22), (3, "Good text stands here.", 22)]
    assert html_extract.extract(pages.where("false")).count() == 0


def test_toxicity_learns_and_tolerates_gaps(spark, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(("ba", "ne", "lo", "ti", "ru", "sam", "pel"))for _ in range(rng.randint(1, 3)))
    rows = []
    for k in range(400):
        w = [word() for _ in range(60)]
        if k % 4 == 0:
            for bad in rng.sample(("grobnik", "zwurgel", "quaxify"), 2) * 2:
                w.insert(rng.randrange(len(w)), bad)
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.where("doc_id < 300").select("doc_id", "toxic"))
    odd = [(1000, "ba ne g-r-o-b-n-i-k lo"), (1001, "ba ne lo ti"), (1002, None), (1003, ""), (1004, "ba g r o b n i k ne"), (1005, "ba " * 50_000 + "zwurgel")]
    got = {r.doc_id: r for r in toxicity.score(df.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")), model).collect()}
    assert all(got[k].predicted == y for k, _, y in rows if k >= 300)
    assert [got[k].predicted for k, _ in odd] == [1, 0, 0, 0, 1, 1] and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(none, model).count() == 0 and toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("toxic = 0")) is None
    assert toxicity.score(df, None).where("predicted = 1").count() == 0


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (4, "one two three four five six"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_shingles for r in minhash.near_duplicates(docs).collect()) == [0, 2, 2]
    assert lines.drop_lines(docs).count() == pii.find_spans(docs).count() == 3
    items = spark.createDataFrame([(None, "one two three four five"), (1, "four"), (2, "one two three four five six")], "item_id long, text string")
    assert [r.text for r in decontam.clean(docs, items).collect()] == [None]
    assert decontam.clean(docs, items.where("item_id = 1")).count() == 3  # an item of one word is no part of a text

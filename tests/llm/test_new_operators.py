"""Vector codes, spelling variants and site trees on small odd tables, against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from newsmill.llm import page_tree, registry, site_tree, spelling, vector_codes


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_spelling_variants", "op13_main_text"])
def test_query_equals_sql(spark, sf, name):
    assert same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf) > 0


# --- vector codes ---------------------------------------------------------------------------------


def codes_brute(rows, parts, entries, rounds, scale):
    """rows: (id, vector), kept ones in order."""
    width = -(-max((len(v) for _, v in rows), default=0) // parts)
    whole = [[vector_codes.exact_floor(x, scale) for x in v] + [0] * (parts * width - len(v)) for _, v in rows]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(groups[i]) for col in zip(*groups[i])] if groups[i] else old for i, old in enumerate(books[p])]
    out = []
    for (i, _), c in zip(rows, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, bytes(b[1] for b in best).hex(), min(2**63 - 1, sum(b[0] for b in best))))
    return sorted(out, key=repr), books


def kept(rows):
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def coded(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("code", F.lit("x")).withColumn("raw", F.lit(1)).repartition(3)
    got, books = vector_codes.compressed(df, "embedding", "vec_id", ["vec_id", "raw"], **options)
    assert got.columns == ["vec_id", "raw", "code", "error"]
    return sorted([(r.vec_id, bytes(r.code).hex(), r.error) for r in got.collect()], key=repr), books


@pytest.mark.parametrize("seed,size,spread", [(0, 16, 1.0), (1, 24, 0.01), (2, 13, 1000.0), (3, 8, 1e6)])
def test_codes_equal_brute_force(spark, seed, size, spread):
    draw = np.random.default_rng(seed)
    middles = draw.normal(0, spread, (5, size))
    rows = [(int(i), [float(np.float32(x)) for x in middles[i % 5] + draw.normal(0, spread / 10, size)]) for i in draw.permutation(400)]
    rows += [(7, rows[0][1]), (None, rows[1][1]), (500, None), (501, [1.0, None]), (502, [float("nan")] * size), (503, [float("inf")] + [0.0] * (size - 1)), (504, [1.0]), (505, [])]
    want, books = codes_brute(kept(rows), 4, 8, 4, 4096)
    assert coded(spark, rows, parts=4, entries=8, rounds=4) == (want, books)


def test_codes_of_ties_few_and_no_rows(spark):
    same_rows = [(i, [0.5, -0.25, 0.0, 1.0]) for i in range(70)] + [(100 + i, [0.5 + (i % 2) / 4096, -0.25, 0.0, 1.0]) for i in range(9)]
    assert coded(spark, same_rows, parts=2) == codes_brute(kept(same_rows), 2, 16, 6, 4096)
    few = [(1, [-1e-9, 2.0]), (2, [3.0, -4.0001])]
    assert coded(spark, few, parts=2) == codes_brute(kept(few), 2, 16, 6, 4096)
    assert coded(spark, [(1, None)], parts=2) == ([], [[], []])


def test_codes_of_huge_components(spark):
    rows = [(i, [(-1) ** i * 3e38, float(i), 1e30 * i, 0.1]) for i in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert coded(spark, rows, parts=2, entries=4, rounds=3) == codes_brute(kept(rows), 2, 4, 3, 4096)
    wide = [(i, [(-1) ** i * 1.7e308, 2.0**-1074 * i]) for i in range(12)]
    assert coded(spark, wide, kind="double", parts=2, entries=4, rounds=2) == codes_brute(kept(wide), 2, 4, 2, 4096)


def test_shortlists_keep_the_nearest_entry_and_drop_others(monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 16)
    draw = np.random.default_rng(5)
    values = draw.integers(-4000, 4000, (1, 3000, 4))
    order = vector_codes.hilbert_order(values[0])
    assert sorted(order) == list(range(3000))
    c = vector_codes.Chunk.of(values[:, order], order[None].astype(np.uint16))
    book = draw.integers(-4000, 4000, (16, 4))
    left = 0
    for entries, blocks in c.assigned(0, book):
        rows = c.rows_of(blocks)
        best = ((c.values[0][rows][:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert set(best) <= set(entries)
        left += len(rows) * len(entries)
    assert left < 0.8 * 3000 * 16  # the boxes rule entries out
    steps = np.abs(np.diff(values[0][order], axis=0)).sum(1).mean()
    assert steps < 0.5 * np.abs(np.diff(values[0], axis=0)).sum(1).mean()  # neighbours on the curve are neighbours in space


# --- spelling variants ----------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def pairs_of(df):
    got = [tuple(sorted((r.a, r.b))) for r in df.collect()]
    assert len(got) == len(set(got))  # each pair arises once
    return set(got)


@pytest.mark.parametrize("seed,alphabet", [(0, "ab"), (1, "abc"), (2, "aéÿ÷ß")])
def test_neighbours_equal_brute_force(spark, seed, alphabet):
    draw = random.Random(seed)
    words = {"".join(draw.choice(alphabet) for _ in range(draw.randint(1, 9))) for _ in range(250)} | {"a" * i for i in range(1, 12)} | {"b", "ab"}
    want = {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert pairs_of(spelling.trie_neighbours(df)) == want
    assert pairs_of(spelling.neighbours(df, trie_len=5)) == want


def test_long_words_are_compared_without_levels(spark):
    base = "".join(random.Random(3).choice("abcdefgh") for _ in range(3000))
    words = [base, base[:-1], base[:1500] + "z" + base[1501:], "q" + base, base[:7] + "y" + base[8:], base[:49], base[:48], base[:47], "x" * 60, "x" * 61, "x" * 59 + "y"]
    want = {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p)}
    assert pairs_of(spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string"))) == want


def counts_brute(rows):
    out = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return out


def variants_brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    forms = {}
    for w in counts:
        top = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = top if top and counts[top] >= 5 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, counts[w], len(near[w]), counts[forms[w]] if forms[w] else None))
    return rows


def test_variants_equal_brute_force(spark):
    draw = random.Random(4)
    stems = ["colour", "color", "colors", "Ärger", "naïve", "thé×é", "ÉCLAIR", "aaa", "aaaa"]
    texts = [(i, " ".join(draw.choices(stems, [300, 60, 10, 50, 9, 40, 7, 30, 200])[0] + draw.choice(["", "", "", "s", "."]) for _ in range(60))) for i in range(300)]
    texts += [(7, texts[0][1]), (None, "colour colour"), (400, None), (401, ""), (402, "1 2 _"), (403, "x" * 9000 + " " + "y" * 60)] + [(i, "kolour") for i in range(500, 512)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).repartition(3)
    counts = spelling.word_counts(df)
    want = counts_brute(texts)
    assert {(r.word, r.n) for r in counts.collect()} == set(want.items())
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(counts.where("word <> ''")).collect()]
    want.pop("", None)
    assert len(got) == len(set(got)) and set(got) == variants_brute(want)
    assert any(r[1] and r[2] not in (r[0], r[1]) for r in got)  # chains of forms are followed
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


# --- main text ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "html,want",
    [
        ("", []),
        ("plain &lt;text&gt;\n and&nbsp;more", ["plain <text> and more"]),
        ("<p>One<p>Two<b>bold</b>er<br>new line", ["One", "Twobolder new line"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
        ("<article><p>In</p></article><p>Out</p><article><p>Too</article>", ["In", "Too"]),
        ("<main><h1>Head</h1><article><p>In</p></article><p>Out</p></main>", ["Head", "In"]),
        ("<header><h1>Site</h1></header><div>Text</div><footer>f</footer>", ["Text"]),
        ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer><aside>a</aside><form><p>g</form>tail</article>", ["T", "x", "tail"]),
        ("<script>if (a < b) '<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><script>never ends <p>no", ["yes"]),
        ("<div class='sidebar-left'>s</div><div class='has-sidebar'><p>t</p></div><div id='CookieNotice'>c</div><div class=post-comments>r</div>", ["t"]),
        ("<div class='page header'>h</div><div class='article-header'>t</div><p>x <span class='advert'>buy <span>now</span></span>y</p>", ["t", "x y"]),
        ("<div class='menu'><article><p>in a badly named box</p></article></div>", ["in a badly named box"]),
        ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>d</div><p title='a > b'>t</p>", ["t"]),
        ("<p>cut &amp</p><p>&am &#132; &#x41;&nosuch;</p><p unclosed", ["cut &", "&am „ A&nosuch;"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, ["deep"]),
    ],
)
def test_blocks_of_a_page(html, want):
    assert page_tree.Page(html).blocks() == want


def test_reading_is_linear():
    import time

    for text in ("<a b=\"" * 30_000, "<p " * 60_000, "<div class='x'>" * 30_000, "</div>" * 60_000 + "<table><div>" * 20_000 + "</p>" * 20_000, "&" * 300_000, "<!--" * 60_000, "<title>" * 20_000):
        began = time.time()
        page_tree.Page(text)
        assert time.time() - began < 5, text[:20]


def test_placing_counts_runs_once():
    p = site_tree.Placed(page_tree.Page("<div><p>a</p><p>b 1</p><p>a</p><ul><li>x</ul></div>"), "h")
    by_depth = collections.Counter(row[1] // 2 % (site_tree.FOLD + 2) for row in p.rows.values())
    assert by_depth == {0: 1, 1: 1, 2: 2, 3: 2, 4: 1}  # root; div; p+ and ul; p's text and li; li's text
    assert sorted(len(row[3]) for row in p.rows.values() if row[1] % 2) == [1, 2]  # words of li; of the paragraphs
    q = site_tree.Placed(page_tree.Page("<div><p>c</p><ul><li>y</ul></div>"), "h")
    assert set(q.rows) == set(p.rows)  # the same places, whatever the run's length


FRAME = """<html><body><div class=kopf><p>Our fine site</p></div><div class=b1><h1>{w}</h1><p>{w} is told here at length, {x}.</p>
<div class=q7><p>Call our free line today</p></div><p>And {x} ends it with {w}</p></div><div class=r9><ul><li>One</li><li>Two</li></ul></div></body></html>"""


def site(n, host, same=False):
    word = lambda i, s: hashlib.md5(f"{s}{0 if same else i}".encode()).hexdigest()
    return [(i, f"https://{host}/{i}", FRAME.format(w=word(i, "w"), x=" ".join(word(i, k) for k in "abcdefgh"))) for i in range(n)]


def main_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("z")).withColumn("key", F.lit(1)).repartition(3)
    got = site_tree.main_texts(df, "html", "url", ["page_id", "url"], **options)
    return sorted([(r.page_id, r.url, r.text) for r in got.collect()], key=repr)


def test_shared_branches_are_dropped_by_site(spark):
    rows = site(12, "a.example") + site(2, "b.example") + [(90, None, None), (91, "https://a.example/x", ""), (3, *site(4, "a.example")[3][1:]), (None, "https://c.example", "<p>alone</p>")]
    got = main_of(spark, rows)
    assert len(got) == len(rows)
    for i, url, text in got:
        host = (url or "").split("/")[2:3]
        if host == ["a.example"] and i != 91:
            assert "Our fine" not in text and "free line" not in text and "One" not in text
            assert "at length" in text and "ends it" in text and text.count("\n") == 2
        if host == ["b.example"]:
            assert "Our fine" in text and "free line" in text  # two pages prove nothing
    assert {t for i, _, t in got if i in (90, 91)} == {""}


def test_copies_of_an_article_are_no_frame(spark):
    rows = site(9, "a.example", same=True)
    assert all("at length" in t and "ends it" in t for _, _, t in main_of(spark, rows))
    near = [(i, u, h.replace("ends it", f"ends it {i}")) for i, u, h in site(9, "d.example", same=True)]
    assert all("at length" in t for _, _, t in main_of(spark, near))


@pytest.mark.parametrize("levels", [20, 300])
def test_deep_frames_are_dropped(spark, levels):
    rows = [(i, u, h.replace("<body>", "<body>" + "<div>" * levels).replace("</body>", "</div>" * levels + "</body>")) for i, u, h in site(6, "a.example")]
    plain = {i: t for i, _, t in main_of(spark, site(6, "a.example"))}
    got = main_of(spark, rows)
    assert {i: t for i, _, t in got} == plain and all("Our fine" not in t and "at length" in t for t in plain.values())


def test_a_frame_with_most_of_the_text_is_dropped(spark):
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    long = "We take great care of what you send us and keep it for a year. " * 5
    page = "<body><div class=a><p>{w} is short</p></div><div class=z>{long}<p>Ask us</p>{more}</div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(w=word(i), long=long, more="")) for i in range(6)]
    assert {i: t for i, _, t in main_of(spark, rows)} == {i: f"{word(i)} is short" for i in range(6)}
    # What holds a page's own words stays, and so does a page of which nothing else would be left.
    rows = [(i, u, page.format(w=word(i), long=long, more=f"<p>{word(-i)}</p>")) for i, u, _ in rows]
    assert all(word(i) in t and word(-i) in t for i, _, t in main_of(spark, rows))
    rows = [(i, f"http://h.example/{i}", f"<body><div>{long}</div><script>{i}</script></body>") for i in range(6)]
    assert all(t == long.strip() for _, _, t in main_of(spark, rows))


def importance_brute(pages):
    """node -> (pages, composite importance), straight from the definition, for pages whose sketches all differ."""
    held = collections.defaultdict(list)
    for p in pages:
        for node, row in p.rows.items():
            held[node].append(row)
    kids = collections.defaultdict(set)
    for node, rows in held.items():
        kids[rows[0][0]].add(node)

    def composite(node):
        rows = [r for r in held[node] if r[3]]
        m = len(rows)
        if m == 1:
            return 1.0
        values, seen = collections.Counter(), collections.Counter()
        for r in rows:
            values.update(r[3])
            seen.update(set(r[3]))
        if rows[0][1] % 2:
            return 1 - sum(math.log(c) / math.log(m) for c in seen.values()) / len(seen)
        total = sum(values.values())
        own = min(1, -sum(c / total * math.log(c / total) for c in values.values()) / math.log(m))
        g = 0.9 ** len(values)
        below = sum(sum(r[2] for r in held[k]) / total / (held[k][0][1] // 2 // (site_tree.FOLD + 2)) * composite(k) for k in kids[node])
        return (1 - g) * own + g * below

    return {n: (sum(1 for r in rows if r[3]), composite(n)) for n, rows in held.items() if any(r[3] for r in rows)}


@pytest.mark.parametrize("least", [0.05, 0.2, 0.5, 0.8])
def test_importance_equals_the_definition(spark, least):
    draw = random.Random(6)
    pages = []
    for i in range(40):
        body = "".join(draw.choice(["<div class=x><p>same</p></div>", f"<div><p>{draw.random()}</p><p>again</p></div>", "<ul><li>a<li>b</ul>", f"<section><h2>t</h2><p>{draw.randint(0, 4) * 'z'}.</p></section>"]) for _ in range(draw.randint(1, 4)))
        pages.append((i, "http://h.example/", f"<body><p>{' '.join(hashlib.md5(f'{i}:{k}'.encode()).hexdigest() for k in range(60))}</p>{body}</body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    placed = [site_tree.Placed(page_tree.Page(h), "h.example") for _, _, h in pages]
    want = importance_brute(placed)
    got = {r.node for r in site_tree.low_branches(site_tree.site_tree(site_tree._pages(df, "html", "url")), least, 3).collect()}
    text = {n for p in placed for n, r in p.rows.items() if r[1] % 2}
    assert got == {n for n, (m, v) in want.items() if m >= 3 and v < least and n not in text}


def test_hosts():
    assert [site_tree.host_of(u) for u in ("http://u:p@A.b:80/x", "//c/d", "x", None, "https://e?f#g")] == ["a.b:80", "c", "", "", "e"]


def test_empty_pages(spark):
    assert main_of(spark, []) == []


# --- what queries leave behind --------------------------------------------------------------------


def left_behind(spark):
    import pathlib

    from newsmill import shared

    where = pathlib.Path(shared.shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "newsmill"
    return {p.name for p in where.iterdir()} if where.exists() else set()


@pytest.mark.parametrize("name", [*registry._TIDY, "op13_main_text"])
def test_queries_leave_one_table(spark, sf, name):
    before = left_behind(spark)
    registry.queries()[name](spark, sf).count()
    assert len(left_behind(spark) - before) <= 1


def test_pipeline_leaves_its_result(spark, sf):
    import corpus_pipeline

    before = left_behind(spark)
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [x.rsplit("-", 1)[0] for x in left_behind(spark) - before] == ["pipeline-source_mix-result"]

"""Vectors, pages, conversations, and the stages of the pipeline."""

import contextlib
import hashlib
import os
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import chats, pages, vectors
from siftwell.llm.shared import written

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(n):
            (i, x, s), (j, y, t) = rows[a], rows[b]
            if a != b and None not in (i, j, s, t) and s == t and ok(x) and ok(y) and len(x) == len(y):
                x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                near[a][b] = float(x @ y) / (float(x @ x) ** 0.5 * float(y @ y) ** 0.5) >= cosine
    least = [r[0] for r in rows]
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if near[a][b]:
                    least[a] = min(least[a], least[b])
    return sorted((str(r[0]), sum(near[k]), str(least[k]), r[0] is not None and least[k] == r[0]) for k, r in enumerate(rows))


@pytest.mark.parametrize(("dim", "tile"), [(16, 4096), (16, 3), (18, 1), (3, 4096), (1, 4096), (1, 2)])
def test_vectors_are_linked_as_by_brute_force(spark, dim, tile):
    r = np.random.default_rng(dim)
    rows = []
    for c in range(8):
        center = r.normal(size=dim)
        rows += [(0, (center + r.normal(size=dim) * s).astype(np.float32).tolist(), c % 2) for s in (0, 0.05, 0.1, 0.2, 0.3, 0.5)]
    rows += [(0, rows[0][1], 0)] * 3 + [(0, (np.array(rows[1][1]) * 5).tolist(), 0)]
    rows = [(i, v, s) for i, (_, v, s) in enumerate(rows)]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] * dim, [None] + [1.0] * (dim - 1), [1.0] * (dim + 1)]
    rows += [(1000 + i, v, 0) for i, v in enumerate([*odd, *odd])] + [(2000, rows[0][1], None), (None, rows[0][1], 0), (3, rows[3][1], 1)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], SCHEMA + ", n_links long")
    got = vectors.vector_links(df, tile=tile).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in got) == brute(rows)


@pytest.mark.parametrize("dense", [0.0, 0.5, 2.0])
def test_cells_give_what_all_pairs_give(dense, monkeypatch):
    """One cell, by bitmaps and by matrix products, with parts of few rows."""
    monkeypatch.setattr(vectors, "_DENSE", dense)
    monkeypatch.setattr(vectors, "_ROWS", 7)
    monkeypatch.setattr(vectors, "_COLUMNS", 11)
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(12, 8)), 5, 0) + r.normal(size=(60, 8)) * 0.2
    guest = np.arange(60) % 3 == 0
    for block in (0, 1):
        for j in (0, 1):
            table = pa.table({"embedding": x.tolist(), "block": [block] * 60, "n": [1] * 60, "guest": guest, "cid": range(60), "i": [0] * 60, "j": [j] * 60})
            got, compared = vectors.linked(table, 0.93, 2)
            u, t, parts = vectors.unit(x), vectors.turned(x), vectors.split(8, 2)
            inside = [((t[:, None, p] - t[None, :, p]) ** 2).sum(2) <= vectors.budget(p, 8, 0.93) for p in parts]
            expected = (u @ u.T >= 0.93) & inside[block] & ~(inside[0] if block else np.zeros((60, 60), bool)) & ~np.eye(60, dtype=bool)
            expected &= ~(guest[:, None] & guest[None, :])
            if j:
                expected &= guest[:, None] | guest[None, :]
            assert dict(zip(got["cid"].to_pylist(), got["links"].to_pylist())) == {k: n for k, n in enumerate(expected.sum(1).tolist()) if n}
            assert compared <= 60 * 60


def test_few_pairs_are_compared(spark):
    """Block distances of all cells, against all pairs of a label, for two sizes: the share doesn't rise."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("label IS NOT NULL").orderBy("vec_id").toArrow()
    share = []
    for n in (1000, 2000):
        some = rows.slice(0, n)
        pairs = sum(k * (k - 1) // 2 for k in some.group_by("label").aggregate([([], "count_all")])["count_all"].to_pylist())
        whole = [{"label": str(v["label"]), "dim": 64, "block": k, "path": [], "guest": False, "gap": 0.0, "cid": i, "embedding": v["embedding"], "n": 1} for i, v in enumerate(some.to_pylist()) for k in range(4)]
        kinds = {"label": pa.string(), "dim": pa.int32(), "block": pa.int32(), "path": pa.list_(pa.int32()), "guest": pa.bool_(), "gap": pa.float64(), "cid": pa.int64(), "embedding": pa.list_(pa.float32()), "n": pa.int64()}
        dealt = pa.Table.from_batches(vectors._dealt(0.93, 4, 2)(pa.Table.from_pylist(whole, schema=pa.schema(kinds)).to_batches()))
        assert dealt.num_rows < 12 * n
        cells: dict = {}
        for i, key in enumerate(zip(*(dealt[c].to_pylist() for c in ("label", "block", "path")))):
            cells.setdefault(repr(key), []).append(i)
        place = lambda t: t.append_column("i", pa.array([0] * t.num_rows)).append_column("j", pa.array([0] * t.num_rows))
        share.append(sum(vectors.linked(place(dealt.take(x)), 0.93, 4)[1] for x in cells.values()) / pairs)
    assert share[1] < 0.05 and share[1] < share[0] * 1.1


def near_copies(dim=12):
    r = np.random.default_rng(dim)
    centers = r.normal(size=(6, dim))
    rows = [(centers[i % 6] + r.normal(size=dim) * (0.02 if i % 6 < 2 else 0.25)).astype(np.float32).tolist() for i in range(60)]
    return [(i, v, i % 6 // 4) for i, v in enumerate([*rows, *rows[:5]])]


@pytest.mark.parametrize(("tile", "summed", "collide"), [(4096, 4, False), (4, 3, False), (2, 1, True)])
def test_rounds_give_what_one_gives(spark, monkeypatch, tile, summed, collide):
    """Many rounds of few vectors, crowded cells and tiles among them; and classes whose hashes are all the same."""
    monkeypatch.setattr(vectors, "SENT", 1)
    monkeypatch.setattr(vectors, "SENT_LEAST", 1)
    monkeypatch.setattr(vectors, "_SUMMED", summed)
    if collide:
        monkeypatch.setattr(vectors, "_mark", lambda: F.lit(1).cast("long"))
    rows = near_copies()
    got = vectors.vector_links(spark.createDataFrame(rows, SCHEMA), tile=tile, blocks=2).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in got) == brute(rows)


def test_tiles_hold_each_pair_of_a_cell_once():
    r = np.random.default_rng(3)
    guest = r.random(200) < 0.4
    h = np.where(np.arange(200) < 150, 7, 9).astype(np.uint64)
    place, g, i, j, _ = vectors._tiles(guest, h, np.arange(200), (np.array([7], np.uint64), np.array([4]), np.array([3])))
    met: dict = {}
    for tile in set(zip(h[place].tolist(), i.tolist(), j.tolist())):
        at = [(int(p), bool(x)) for p, x, a, b, c in zip(place, g, h[place].tolist(), i.tolist(), j.tolist()) if (a, b, c) == tile]
        for n, (p, x) in enumerate(at):
            for q, y in at[n + 1 :]:
                if x != y or (not x and tile[1] == tile[2]):
                    met[min(p, q), max(p, q)] = met.get((min(p, q), max(p, q)), 0) + 1
    assert met == {(p, q): 1 for p in range(200) for q in range(p + 1, 200) if h[p] == h[q] and not (guest[p] and guest[q])}


def test_vectors_take_little_disk(spark, monkeypatch, tmp_path):
    """Shuffle files and tables at any time, against the input."""
    monkeypatch.setattr(vectors, "SENT_LEAST", 0, raising=False)
    path = "/root/testdata/sf0.1/embeddings.parquet"
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    over, peak = threading.Event(), [0]

    def used():
        total = 0
        for d in folders:
            for where, _, names in os.walk(d):
                for x in names:
                    with contextlib.suppress(OSError):  # it may go meanwhile
                        total += os.stat(os.path.join(where, x)).st_size if x.endswith((".data", ".parquet")) else 0
        return total

    spark._jvm.System.gc()
    before = used()
    watch = threading.Thread(target=lambda: [peak.append(used()) for _ in iter(lambda: over.wait(0.02), True)])
    watch.start()
    try:
        vectors.vector_links(spark.read.parquet(path)).write.parquet(str(tmp_path / "out"))
    finally:
        over.set()
        watch.join()
    assert max(peak) - before < 4 * os.path.getsize(path)


def test_no_vectors(spark):
    assert vectors.vector_links(spark.createDataFrame([], SCHEMA)).count() == 0


# pages

WORDS = "The cat sat on the mat and it was all of the time in the house with them. "
PAGES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("just words", "just words"),
    (f"<article><h1>Head</h1><p>{WORDS * 3}<p>Short &amp; sweet</article><footer>x &copy; y</footer>", f"Head\n{(WORDS * 3).strip()}\nShort & sweet"),
    (f"<nav><a href=x>Home</a></nav><header><b>Site</b></header><main><p>a\n\t b&nbsp;&lt;c&gt;<br>d</p><p>{WORDS * 3}</p></main>", f"a b <c> d\n{(WORDS * 3).strip()}"),
    (f"<div class='sidebar'>{WORDS * 4}</div><div id=content><p>{WORDS * 4}</p></div><div class=comments><p>{WORDS * 4}</p></div>", (WORDS * 4).strip()),
    (f"<article><header><h1>T</h1></header><p>{WORDS}</p><aside>{WORDS}</aside><form><input><button>Go</button>{WORDS}</form><section class='comment-list'>{WORDS}</section><footer>{WORDS}</footer></article>", f"T\n{WORDS.strip()}"),
    (f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><p>{WORDS * 4}</p><p>by <a href=z>someone</a></p>", (WORDS * 4).strip()),
    ("<script>if (a < b) { document.write('<p>no</p>') }</script><style>p{}</style><!-- <p>no</p> --><article><p>yes</article>", "yes"),
    ("<article><p title='a > b'>x</p><p>never closed <b>bold", "x\nnever closed bold"),
    ("<p>unclosed <!-- comment", "unclosed"),
    ("<ARTICLE><P>Up</P></ARTICLE><DIV CLASS=Ad>Buy</DIV>", "Up"),
    (f"<nav><ul><li><a>x</a><article><p>{WORDS}</p></article>", WORDS.strip()),
    ("<article><div hidden>no</div><p style='display: none'>no</p><p>yes<p>1 < 2 & 3</article>", "yes\n1 < 2 & 3"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert pages.main_text(page) == text


def test_generated_pages_give_their_articles(spark):
    import html
    import re

    for r in pages.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), keep=("page_id", "html")).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_generated_pages_need_no_article_element(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        text = pages.main_text(r.html)
        for tag in ("div", "section"):
            assert pages.main_text(r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")) == text
        assert pages.main_text(r.html.replace("<article>", "").replace("</article>", "")) == text


def plain_rules(page):
    """The two passes said plainly, over (text, linked, in article, containers from the outermost in) of each block."""
    page = [b for b in page if b[0]]
    words = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    share = lambda ts: sum(w in pages.STOP_WORDS for t in ts for w in words(t)) / max(1, sum(len(words(t)) for t in ts))
    known = share([t for t, linked, _, _ in page if linked <= pages.LINKS * len(t)]) >= pages.LOW_STOPS
    labels = []
    for t, linked, article, _ in page:
        n, s = len(t), share([t])
        if linked > pages.LINKS * n or "©" in t and n < pages.LONG and not article:
            labels.append("bad")
        elif n < pages.SHORT:
            labels.append("short")
        elif not known:
            labels.append("good" if n >= pages.LONG or "." in t else "short")
        elif n >= pages.LONG and s >= pages.LOW_STOPS or s >= pages.HIGH_STOPS:
            labels.append("good")
        else:
            labels.append("short" if s >= pages.LOW_STOPS else "thin")
    if any(b[2] and x != "bad" for b, x in zip(page, labels, strict=True)):
        page, labels = zip(*[(b, x) for b, x in zip(page, labels, strict=True) if b[2]], strict=True)
    if "good" not in labels:
        labels = ["good" if x == "thin" or x == "short" and len(b[0]) >= pages.SHORT else x for b, x in zip(page, labels, strict=True)]
    out = []
    for i, (b, label) in enumerate(zip(page, labels, strict=True)):
        kept = label == "good" or label == "short"
        for c in reversed(b[3] if label == "short" else b[3][-1:] if label == "thin" else []):
            near = [(abs(i - j), labels[j] != "good") for j in range(len(page)) if c in page[j][3] and labels[j] in ("good", "bad")]
            if near:
                kept = not min(near)[1]
                break
        if kept:
            out.append(b[0])
    return "\n".join(out)


def test_pages_are_judged_as_by_plain_rules():
    r = random.Random(11)
    stop, rare, cyrillic = ["the", "of", "and", "le", "der", "que"], ["zorp", "quun", "mirt", "blex"], ["город", "река", "дом", "небо"]

    def sentence(kind):
        share = {"text": 0.4, "medium": 0.16, "list": 0.0, "other": 0.0}[kind]
        n = r.choice([2, 5, 14, 20, 60])
        pick = cyrillic if kind == "other" else rare
        text = " ".join(r.choice(stop) if r.random() < share else r.choice(pick) for _ in range(n))
        return text + r.choice(["", ".", " ©"])

    number = 0

    def tree(depth, boxes, article, kinds, blocks):
        nonlocal number
        out = []
        for _ in range(r.randint(1, 4)):
            what = r.choice(["p", "h2", "p", "box", "box", "links", "other", "ul"])
            if what in ("box", "ul") and depth < 4:
                number += 1
                tag = "ul" if what == "ul" else r.choice(["div", "section", "article"] if depth else ["div", "div", "section"])
                inner = tree(depth + 1, [*boxes, number], article or tag == "article", kinds, blocks)
                out.append(f"<{tag}>{inner}</{tag}>")
            elif what == "other":
                out.append(f"<div class='{r.choice(['ad', 'comments', 'share-buttons'])}'><p>{sentence('text')}</p></div>")
            elif what == "links":
                a, b = sentence("list"), r.choice(["", "x ", "and so on with no link at all "])
                out.append(f"<p>{b}<a href='/a>b'>{a}</a></p>")
                blocks.append((f"{b}{a}", len(a), article, boxes))
            else:
                text = sentence(r.choice(kinds))
                out.append(f"<{what if what == 'h2' else 'p'}>{text}</{what if what == 'h2' else 'p'}>")
                blocks.append((text, 0, article, boxes))
        return "".join(out)

    for n in range(3000):
        blocks = []
        page = tree(0, [0], False, [["text", "medium", "list"], ["list"], ["other"], ["medium", "list"], ["text"]][n % 5], blocks)
        assert pages.main_text(page) == plain_rules(blocks), page


def test_pages_of_other_languages_are_judged_by_length_and_links():
    russian = ["Это длинный русский абзац текста, который рассказывает историю о городе и людях. " * 5, "Второй абзац продолжает рассказ о том же самом городе. " * 5]
    italian = ["Questo è un paragrafo molto lungo che racconta la storia di una città e delle persone. " * 5, "Il secondo paragrafo continua a raccontare della stessa città per i lettori. " * 5]
    for two in (russian, italian):
        page = "<div><a href=x>Menu</a> <a href=y>Altro</a></div><div>" + "".join(f"<p>{p}</p>" for p in two) + "</div>"
        assert pages.main_text(page) == "\n".join(p.strip() for p in two)
    assert pages.main_text(f"<article><h1 class='page-header'>Head</h1><p>{WORDS * 3}</p></article>").startswith("Head\n")


@pytest.mark.parametrize("part", ["<a href='", '<a b="\'', "<div>", "</b>", "<article>", "</script", "<a x='>'", "<", "<!--", "<a", "<p>x<ul><li>", "<nav><article>"])
def test_broken_pages_take_linear_time(part):
    import time

    took = []
    for n in (10_000, 80_000):
        began = time.process_time()
        pages.main_text("<script>" * (part == "</script") + "<div>" * (n if part == "</b>" else 0) + part * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)  # 64 times if it were quadratic


def test_columns_of_the_result_can_t_be_kept(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "old", 9)], "page_id long, url string, html string, text string, n_chars long")
    assert [(r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect()] == [(1, "x", 1)]
    with pytest.raises(ValueError):
        pages.extract(df, keep=("page_id", "text"))


def test_pages_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>x"), (1, "u", "<p>x"), (2, "v", "<p>" * 20_000 + "<a href='" * 50)], "page_id long, url string, html string")
    assert sorted(((r.page_id, r.text) for r in pages.extract(df).collect()), key=repr)[:2] == [(1, "x"), (1, "x")]
    assert pages.extract(df.limit(0)).count() == 0


# conversations


def test_formatting_is_reversible():
    r = random.Random(1)
    parts = ["###", "#", "</turn>", "\\", "\\h", ":", "\n", "a", "### assistant: ", "</turn>\n", "ü"]
    for _ in range(300):
        turns = [("".join(r.choice(parts) for _ in range(r.randint(0, 3))), "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for _ in range(4)]
        whole = "".join(f"### {chats.escape(a, True)}: {chats.escape(b)}</turn>\n" for a, b in turns)
        assert chats.parse(whole) == turns
    for broken in ("### a: b", "### a: b</turn>", "a: b</turn>\n", "### a b</turn>\n", "### a: b</turn>\nx", "### a: ### b: c</turn>\n", "### a: b</turn>c</turn>\n", "### a:b: c</turn>\n"):
        with pytest.raises(ValueError):
            chats.parse(broken)


def test_very_long_turns_take_little_more_than_themselves(spark):
    import tracemalloc

    text = "word ### \\ </turn> " * 1_000_000  # 19 MB
    whole = f"### user: {chats.escape(text)}</turn>\n### assistant: ok</turn>\n"
    tracemalloc.start()
    assert chats.parse(whole) == [("user", text), ("assistant", "ok")]
    assert tracemalloc.get_traced_memory()[1] < 30 * len(whole)  # unescape's pieces
    tracemalloc.stop()
    df = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    (got,) = chats.digests(chats.format_chats(df)).collect()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


ROWS = [
    (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "first"), (1, 3, "user", None), (1, 4, "assistant", "second"), (1, 5, "user", "tail"),
    (2, 0, None, "no role"), (2, None, "Assistant", "other"), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, "user", "z" * 20_000),
]


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_every_assistant_turn_is_an_example(spark, part):
    long = [(9, i, "assistant" if i % 3 else "user", f"turn {i}") for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in [*ROWS, *long]], "conv_id long, turn long, role string, text string, seg string")
    formatted = written(chats.format_chats(df, part_bytes=part), "t")
    examples = sorted(chats.flat(formatted).collect(), key=lambda r: (repr(r.conv_id), r.example))
    assert sum(r.conv_id == 9 for r in examples) == 200
    one = [r for r in examples if r.conv_id == 1]
    assert [r.text[r.loss_begin : r.loss_end] for r in one] == ["first", "second"]
    assert chats.parse(one[1].text) == [("system", "s"), ("user", "u"), ("assistant", "first"), ("user", ""), ("assistant", "second")]
    nine = [r for r in examples if r.conv_id == 9]
    assert all(len(chats.parse(r.text)) == 3 * (r.example // 2) + 2 + r.example % 2 for r in nine)
    got = {r.conv_id: r for r in chats.digests(formatted).collect()}
    assert got[1].n_turns == 6 and got[1].loss_sha256 == hashlib.sha256(b"firstsecond").hexdigest() and got[1].loss_chars == 11
    assert got[1].turns_sha256 == hashlib.sha256(b"system\ns\nuser\nu\nassistant\nfirst\nuser\n\nassistant\nsecond\nuser\ntail\n").hexdigest()
    assert got[1].formatted_chars == sum(len(r.text) for r in one) and got[9].formatted_chars == sum(len(r.text) for r in nine)
    assert (got[2].n_turns, got[2].loss_chars, got[3].n_turns, got[None].loss_chars, got[4].formatted_chars) == (2, 0, 2, 1, 0)
    assert chats.digests(chats.format_chats(df.limit(0))).count() == 0


@pytest.mark.parametrize("chars", [4 << 20, 40])
def test_digests_are_read_from_written_examples(spark, monkeypatch, chars):
    monkeypatch.setattr(chats, "BATCH_CHARS", chars, raising=False)
    tables = {}
    monkeypatch.setattr(chats, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    turns = [(c, t, "assistant" if t % 2 else "user", f"{c} ### {t}") for c in (1, 2, None) for t in range(5 + (c or 0))]
    turns += [(3, 0, "user", "no reply"), (4, 0, "assistant", "only")]
    formatted = chats.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chats.digests(formatted).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 6, 2: 7, None: 5, 3: 1, 4: 1}
    whole = {c: [f"### {r}: {chats.escape(x)}</turn>\n" for k, _, r, x in turns if k == c] for c in got}
    texts = {(c, k): "".join(w[: 2 * k + 2 if c != 4 else 1]) for c, w in whole.items() for k in range(len(w) // 2 if c != 4 else 1)}
    rows = tables["examples"].collect()
    assert {(r.conv_id, r.example): r.text for r in rows if r.example is not None} == texts
    assert {r.conv_id: r.text for r in rows if r.example is None} == {c: w[-1] for c, w in whole.items() if c in (2, 3, None)}
    assert all(r.formatted_chars == sum(len(x) for (c, _), x in texts.items() if c == k) for k, r in got.items())


# pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    r = random.Random(3)
    some = lambda n: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(n))
    a, b, shared = some(200), some(200), some(60)
    rows = [(1, a, "en"), (2, a, "en"), (3, f"{b} {shared}", "en"), (4, f"{some(100)} {shared} {some(50)}", "en"), (5, f"{some(30)} {passage} {some(30)}", "en"), (6, "12 34", None), (7, None, None), (8, "der hund und die katze", "de"), (1, a, "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        ids.append(sorted(x.doc_id for x in docs.collect()))
        if name == "substring_dedup":
            got = {x.doc_id: x for x in docs.collect()}
            assert shared in got[3].text and shared not in got[4].text and got[4].n_chars == len(got[4].text)
    assert ids[:4] == [[1, 1, 2, 3, 4, 5, 8], [1, 3, 4, 5, 8], [1, 3, 4, 5, 8], [1, 3, 4, 8]]
    assert set(ids[4]) == {1, 3, 4, 8}


def plain_pipeline(rows, passages, predicted):
    """What the first four stages keep, said plainly: (id, text) of each row left, by brute force over all pairs.

    ``predicted`` is the language stage's own answer for each text; the kernel model has its own brute-force test.
    """
    from tests.llm.test_documents import SPACE, brute_fingerprint, brute_substrings

    key = lambda r: (r[0] is None, r[0] or 0)
    rows = [r for r in rows if predicted[r[1]] != "und"]
    group = list(range(len(rows)))
    prints = [brute_fingerprint(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                group = [group[b] if g == group[a] else g for g in group]
    rows = [min((r for r, g in zip(rows, group, strict=True) if g == x), key=key) for x in sorted(set(group))]
    cleaned = brute_substrings([(2**62 if i is None else i, t) for i, t in rows])
    kept = {(None if i == 2**62 else i): (text, n, gone) for i, text, n, gone in cleaned}
    rows = [(i, kept[i][0] if kept[i][2] else t) for i, t in rows if kept[i][2] < kept[i][1] or not kept[i][1]]
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = lambda t: "".join(c if not c.isascii() or c.isalnum() else " " for c in lower(t)).split(" ")
    split = lambda t: [w for w in words(t) if w]
    windows = {tuple(w[i : i + 10]) for w in map(split, passages) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    dirty = lambda t: any(tuple(w[i : i + n]) in windows for w in [split(t)] for n in sizes for i in range(len(w) - n + 1))
    assert all(SPACE.findall(t or "") or not (t or "").strip() for _, t in rows)
    return [r for r in rows if not dirty(r[1])]


def test_pipeline_is_brute_force(spark, tmp_path):
    """All rows of all stages on a small table of odd, near, repeated and contaminated documents."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(17)
    passages = ["ten words " + " ".join(f"bench{i}x{k}" for k in range(14)) for i in range(3)] + ["short one", None]
    vocabulary = {"en": "the of and house river street walking with from over they said".split(), "de": "der die und haus fluss straße gehen mit von über sie sagte".split()}
    say = lambda k, n: " ".join(r.choice(vocabulary[k]) + str(r.randint(0, 9)) * r.randint(0, 1) for _ in range(n))
    texts = [(k, say(k, r.randint(30, 80))) for _ in range(25) for k in vocabulary]
    shared = say("en", 40)
    texts += [("en", f"{say('en', 20)} {shared} {say('en', 20)}") for _ in range(4)] + [("en", f"{say('en', 30)} {passages[1]} {say('en', 9)}"), ("en", f"{say('en', 30)} Short, ONE {say('en', 30)}")]
    texts += [(None, t) for t in (None, "", "12 34", " \n")] + [(k, t.upper() if t.isascii() else t) for k, t in texts[:6]] + [(k, t + " end") for k, t in texts[6:12]] + [("en", texts[0][1])]
    ids = [*range(len(texts) - 1), None]
    rows = list(zip(ids, (t for _, t in texts), strict=True))
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, (k, t) in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    from siftwell.llm import language

    predicted = {x.text: x.lang_pred for x in language.predict(docs, language.fit(docs)).collect()}
    expected = plain_pipeline(rows, passages, predicted)
    assert 20 < len(expected) < len(rows) - 12
    got: dict = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(x.doc_id, []).append((x.start, x.ids, x.ids_crc32))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(got) == {i for i, _ in expected}
    for i, t in expected:
        pieces = [x for _, x, _ in sorted(got[i])]
        assert [y for x in pieces for y in x] == [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert all(c == zlib.crc32(np.array(x, "<u4")) for _, x, c in got[i])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(None, "the cat", "en", "s", 7), (7, "der hund", "de", "s", 8), (7, "le chat", None, "s", 7), (7, "le chat", None, "s", 7)]])
def test_stages_of_odd_tables(spark, rows):
    """Null ids, unlike texts of one id and repeated rows through each stage by itself."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    words = len([x for x in rows if x[1]])
    found = [written(stage(spark, docs, sf), name) for name, stage in corpus_pipeline.STAGES]
    assert [f.columns == docs.columns for f in found] == [True] * 4 + [False]
    # the held-out labels leave one or two languages to learn from, or none
    assert found[0].count() in (0, words)
    assert found[1].count() == len(set(rows)) and found[2].count() == found[3].count() == len(rows)
    assert found[4].selectExpr("sum(length) AS n").first().n == (sum(x.doc_tokens for x in found[4].collect()) or None)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100

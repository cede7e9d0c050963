import base64
import hashlib
import html
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from yieldengine.llm import chat, packing, pagetext, pieces, queries, units, urls
from yieldengine.llm.queries import model_file

PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "①", "▁", "ing", "x" * 30, "\x00", "日本", " " * 15, " " * 31, "漢", "😀",
         "</s>", "[INST]", "1", "23", ".", "\u00a0", "ﬁ", "'s", "\r\n", "\x1c", "!!"]


def texts(n, seed, length=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(length))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(model_file())


def test_pieces_are_those_of_the_library(encoder):
    given = texts(4000, 1) + [" " * k for k in range(80)] + ["a" + " " * k + "é" for k in range(40)] + ["a" * k for k in range(120)]
    assert [x.tolist() for x in encoder.encode_rows(pa.array(given))] == encoder.model.encode(given)


def test_long_texts_are_encoded_in_pieces(encoder, monkeypatch):
    monkeypatch.setattr(units, "PIECE", 500)
    given = texts(20, 2, 4000)
    assert [x.tolist() for x in encoder.encode_rows(pa.array(given))] == encoder.model.encode(given)


def test_pieces_round_trip_with_odd_rows(spark, encoder):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "word " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    got = pieces.encode_pieces(docs, model_file()).collect()
    expected = [(i, encoder.model.encode(t or ""), t or "") for i, t, _ in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))
    assert pieces.encode_pieces(docs.limit(0), model_file()).count() == 0


def test_packed_rows_hold_every_token_once(spark, monkeypatch):
    rank_file = model_file("byte_bpe_50k.tiktoken")
    tool = packing.ByteEncoder(rank_file)
    rows = [(i, t) for i, t in enumerate(texts(150, 3, 200))] + [(150, "long text " * 900), (None, "no id"), (7, None), (8, ""), (1, "twice"), (1, "twice")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pack_id string")
    monkeypatch.setattr(packing, "POOL", 3000)
    found: dict = {}
    for row in packing.pack_documents(docs, rank_file, 128).collect():
        ids, places = (np.frombuffer(bytes(row[c]), dtype="<u2") for c in ("input_ids", "positions"))
        ends = row["cumulative_lengths"]
        assert len(ids) == len(places) == 128 and ends[-1] == row["n_tokens"] <= 128 and (ids[ends[-1] :] == packing.PADDING).all()
        for doc, first, a, b in zip(row["doc_ids"], row["first_tokens"], ends[:-1], ends[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault(doc, []).append((first, ids[a:b].tolist()))
    twice = tool.encoding.encode_ordinary("twice")
    for doc, text in rows:
        ids = tool.encoding.encode_ordinary(text or "")
        if doc == 1:
            continue
        if doc in (7, 8) and not ids:
            ids = tool.encoding.encode_ordinary(rows[doc][1])
        assert [t for _, part in sorted(found.get(doc, [])) for t in part] == ids
    assert sum(part == twice for _, part in found[1]) == 2
    assert packing.pack_documents(docs.limit(0), rank_file).count() == 0


def test_byte_encoder_pieces_and_pattern(monkeypatch):
    monkeypatch.setattr(units, "PIECE", 300)
    monkeypatch.setattr(packing, "PIECE", 300)
    tool = packing.ByteEncoder(model_file("byte_bpe_50k.tiktoken"))
    given = texts(60, 4, 2000) + texts(60, 5, 20)
    assert [x.tolist() for x in tool.encode_rows(pa.array(given))] == [tool.encoding.encode_ordinary(t) for t in given]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        assert len({base64.b64decode(x.split()[0]) for x in lines}) == 50_256


def test_best_fit_is_that_of_a_plain_search():
    rng = random.Random(6)
    for _ in range(100):
        sizes = [rng.randint(1, 50) for _ in range(rng.randrange(60))]
        rows, rooms = packing.best_fit_decreasing(sizes, 50), []
        assert sorted(x for r in rows for x in r) == list(range(len(sizes)))
        assert all(sum(sizes[x] for x in r) <= 50 for r in rows)
        for size in sorted(sizes, reverse=True):
            fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
            if fits:
                rooms[min(fits)[1]] -= size
            else:
                rooms.append(50 - size)
        assert sorted(50 - sum(sizes[x] for x in r) for r in rows) == sorted(rooms)


def test_escaping_is_reversible_and_complete():
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choice(["<", "[", "\\", "|im_end|>", "INST]", "/s>", "s>", "|im_sep|>", "a", "<|im_end|>", "\n"]) for _ in range(rng.randrange(9)))
        shown = chat.escape(text)
        assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROL)


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "assistant", "b"), (1, 2, "user", None),
    (2, 0, "assistant", ""), (2, 1, None, "text\n\n"), (2, 2, "assistant", "\n\n<|im_end|> \\ é日"), (None, 0, "assistant", "lost"),
    (3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (4, None, "assistant", "x" * 5000),
]


@pytest.mark.parametrize("turns_of_a_part", [256, 1])
def test_digests_read_back_from_masks(spark, monkeypatch, turns_of_a_part):
    monkeypatch.setattr(chat, "PART_TURNS", turns_of_a_part)
    schema = "conv_id long, turn long, role string, text string, part int, formatted string"
    table = spark.createDataFrame([(*r, 1, "z") for r in CONVERSATIONS], schema)
    parts = chat.format_conversations(table, model_file("byte_bpe_50k.json"))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digest_conversations(parts).collect()}
    assert set(got) == {r[0] for r in CONVERSATIONS}
    for conversation in got:
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in CONVERSATIONS if c == conversation)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert got[conversation] == (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()
        )
    assert chat.format_conversations(table.limit(0), model_file("byte_bpe_50k.json")).count() == 0


def test_masks_by_binary_search():
    rng = np.random.default_rng(9)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 60, 20))
        starts, ends = cuts[:-1], cuts[1:]
        spans = np.unique(rng.integers(0, 60, 6))[:-1 if rng.integers(2) else None]
        loss = [(int(a), int(b)) for a, b in zip(spans[::2], spans[1::2])]
        expected = [any(a < e and s < b for a, b in loss) for s, e in zip(starts, ends)]
        assert chat.loss_mask(starts, ends, loss).tolist() == expected


def test_repeated_runs_are_those_of_a_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(60):
        tokens, pages = [], []
        for page in range(4):
            own = rng.integers(10, 13, rng.integers(0, 30)).tolist()
            tokens += [*own, page]
            pages += [page] * (len(own) + 1)
        where: dict = {}
        for i in range(len(tokens) - 3):
            if min(tokens[i : i + 4]) >= 10:
                where.setdefault(tuple(tokens[i : i + 4]), []).append(i)
        expected = np.zeros(len(tokens), dtype=bool)
        for at in where.values():
            if len({pages[i] for i in at}) > 1:
                for i in at:
                    expected[i : i + 4] = True
        assert (pagetext.repeated_cover(np.array(tokens, dtype=np.uint64), np.array(pages), 4) == expected).all()


def page(body, host="h.example.com", number=0):
    return (number, f"https://{host}/x/{number}", body)


def extract(spark, rows):
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    return {r["page_id"]: r["text"] for r in pagetext.extract_text(table).collect()}


def test_declared_articles_and_odd_markup(spark):
    cases = {
        1: ("<nav>m</nav><article><h1>T &amp; U</h1><p>One<span class='ad'>x<span>y</span>z</span> two<p>Three<br>four"
            "<ul><li>a<li>b</ul><section class='comments'><article>c</article></section><form>f</form></article><footer>q",
            "T & U\nOne two\nThree four\na\nb"),
        2: ("<div class='with-sidebar'><main><header><h1>H</h1></header><p>x&nbsp; y</p></main></div><aside><article>n</article></aside>", "H\nx y"),
        3: ("<script>var a='</p><article>no'</script><p>plain &lt;b&gt; &am", "plain <b> &am"),
        4: ("<p>a<!-- no --> b <![CDATA[c<d]]></p><div hidden>no</div><div style='display: none'>no</div>", "a b c<d"),
        5: (None, ""), 6: ("", ""), 7: ("<article></article>", ""), 8: ("no markup at all", "no markup at all"),
        9: ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()), 10: ("a < b <3 > c <", "a < b <3 > c <"),
    }
    got = extract(spark, [page(body, f"h{n}.example.com", n) for n, (body, _) in cases.items()])
    assert got == {n: text for n, (_, text) in cases.items()}


def test_nothing_of_an_article_is_lost(spark):
    """Ids that links lead to, class names that only hold a page part's name, a title before the article, formulas, odd quotes."""
    cases = {
        1: ("<article><h2 id='cookies'>Cookies</h2><p id='notice-period'>Notice</p><section id='related'><p>r</p></section></article>", "Cookies\nNotice\nr"),
        2: ("<article><table class='form-factors'><tr><td>a<td>b</table><ol class='menu-items'><li>c</ol><p class='navbar'>d</p></article>", "a\nb\nc"),
        3: ("<main><div><a href='/'>Home</a></div><h1>Title</h1><p>Lead</p><article><p>Body</p></article><div>More</div></main>", "Title\nLead\nBody"),
        4: ("<article><p>x <math><mi>holds</mi></math></p></article>", "x holds"),
        5: ("<article><p title=don't>Text it's here</p><p data-a = \"1 > 0\">more</p><p title=\"open>end</p></article>", "Text it's here\nmore\nend"),
        6: ("<article><p>a</p><div class='site-footer'>n</div><div class='share-buttons'>n</div><div class='my-comment-box'>n</div>"
            "<div class='promotion-rules-of-1890'>b</div><section id='comments'>n</section></article>", "a\nb"),
        7: ("<main><p>a</p><div class='acme-sidebar'>n</div><div id='sidebar'>n</div></main>", "a"),
    }
    got = extract(spark, [page(body, f"n{n}.example.com", n) for n, (body, _) in cases.items()])
    assert got == {n: text for n, (_, text) in cases.items()}


def test_undeclared_boilerplate_is_found_by_repetition(spark):
    rng = random.Random(3)
    notice = "this site keeps what you read for ninety days unless you ask it not to"
    bodies = {n: " ".join(f"w{rng.randrange(9999)}" for _ in range(40)) for n in range(12)}
    rows = [page(f"<div><p>{notice}</p><p>{body}</p><p><a href='/'>all pages of this site</a></p></div>", number=n) for n, body in bodies.items()]
    assert extract(spark, rows) == bodies
    alone = page(f"<div><p>{notice}</p><p>own</p></div>", "other.example.org", 99)
    assert extract(spark, [*rows, alone])[99] == f"{notice}\nown"
    article = [page(f"<article><p>{notice}</p></article>", number=n) for n in range(3)]
    assert set(extract(spark, article).values()) == {notice}


def test_extraction_of_nulls_repeats_and_nothing(spark):
    table = spark.createDataFrame([(None, None, "<p>a</p>"), (1, "u", "<p>b</p>"), (1, "u", "<p>b</p>")], "page_id long, url string, html string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in pagetext.extract_text(table).collect()) == [("1", "b", 1), ("1", "b", 1), ("None", "a", 1)]
    assert pagetext.extract_text(table.limit(0)).count() == 0
    assert html.unescape("&am") == "&am"


def test_a_repeated_undeclared_page_keeps_its_text(spark):
    body, notice = (" ".join(f"{w}{i}" for i in range(40)) for w in "bn")
    copies = [page(f"<div><p>{body}</p></div>", number=n) for n in (1, 1, 2)]
    assert extract(spark, copies) == {1: body, 2: body}
    table = spark.createDataFrame(copies, "page_id long, url string, html string")
    assert [r["text"] for r in pagetext.extract_text(table).collect()] == [body] * 3
    noted = [page(f"<div><p>{notice}</p><p>{own}</p></div>", number=n) for n, own in ((1, "one"), (2, "one"), (3, "three"))]
    assert extract(spark, noted) == {1: "one", 2: "one", 3: "three"}


def test_a_wrapper_named_after_what_it_holds_does_not_empty_the_page(spark):
    bodies = [
        "<body class='has-sidebar nav-open'><p>own</p></body>", "<html class='no-comments'><body><p>own</p></body></html>",
        "<div class='with-sidebar'><div class='content'><p>own</p></div><p>more</p></div>",
        "<div class='content'><p>own</p></div><div class='sidebar'><div class='post'>other</div></div>",
        "<body><div class='sidebar'>menu</div><p>own</p></body>",
    ]
    got = extract(spark, [page(body, f"h{n}.example.com", n) for n, body in enumerate(bodies)])
    assert got == {n: "own" for n in range(len(bodies))}


def test_repeats_are_found_over_the_whole_host_however_it_is_dealt(spark):
    notice = " ".join(f"n{i}" for i in range(20))
    rows = [page(f"<div><p>{notice}</p><p>own{n} text{n}</p></div>", number=n) for n in range(40)]
    rows += [page(f"<article><p>{notice}</p></article>", "g.example.com", 50), page(f"<p>{notice}</p>", "g.example.com", 51)]
    rows += [page(f"<p>{notice}</p>", "k.example.com", 60)]
    expected = {n: f"own{n} text{n}" for n in range(40)} | {50: notice, 51: notice, 60: notice}
    rows[41] = page(f"<p>{notice}</p><p>more</p>", "g.example.com", 51)
    expected[51] = "more"
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    repeats = {}
    for count, every in ((1, True), (7, True), (43, True), (1, False), (43, False)):
        got = pagetext.extract_text(table.repartition(count), every).collect()
        assert {r["page_id"]: r["text"] for r in got} == expected
        repeats[count, every] = {r["page_id"]: r["repeated_tokens"] for r in got}
    assert repeats[1, True] == repeats[7, True] == repeats[43, True] == {n: 0 if n == 60 else 20 for n in expected}


def test_the_query_counts_repeats_on_pages_with_an_article_too(spark, tmp_path):
    notice = " ".join(f"n{i}" for i in range(12))
    rows = [page(f"<article><p>{notice}</p><p>own{n}</p></article>", number=n) for n in range(3)]
    rows.append(page("<article><p>alone here</p></article>", "k.example.com", 9))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op8_page_text(spark, str(tmp_path)).collect()
    assert {r["page_id"]: (r["text"], r["repeated_tokens"]) for r in got} == {
        **{n: (f"{notice}\nown{n}", 12) for n in range(3)}, 9: ("alone here", 0),
    }


def test_windows_do_not_depend_on_groups(monkeypatch):
    draw = random.Random(5)
    made = [f"<p>{' '.join(draw.choice('ab') + str(draw.randrange(2)) for _ in range(60))}</p>" for _ in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(["h", "k"] * 6), pa.array(made)], names=["host", "html"])

    def summed():
        out = {}
        for part in pagetext._windows(iter([batch])):
            for key, low, high in zip(*(c.to_pylist() for c in part.columns)):
                a, b = out.get(key, (low, high))
                out[key] = (min(a, low), max(b, high))
        return out

    whole = summed()
    monkeypatch.setattr(pagetext, "GROUP_TOKENS", 1)
    assert summed() == whole and any(a != b for a, b in whole.values())


def test_urls(spark):
    given = [
        (1, "http://A.Example.NET/en/x?y"), (2, "https://example.net/de/"), (3, "x://notexample.com/de/1"), (4, "x://m.example.com/de/#a"),
        (5, "https://a.org/fr/"), (6, None), (7, "no scheme/net/"), (8, "http://x.net"), (9, "http://u@h:8/p?q://z"), (10, "a://b://c/d"), (None, "http://É.ORG/en/"),
    ]
    table = spark.createDataFrame([(*r, "x") for r in given], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None)], "page_id long, bad int")
    got = {r["page_id"]: tuple(r)[1:4] for r in urls.judge_urls(table, outcomes).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/"), 2: ("example.net", "/de/", "net/"), 3: ("notexample.com", "/de/1", None),
        4: ("m.example.com", "/de/", "example.com/de/"), 5: ("a.org", "/fr/", "org/fr/"), 6: ("", "", None), 7: ("", "", None),
        8: ("x.net", "", None), 9: ("u@h:8", "/p", None), 10: ("b:", "//c/d", None), None: ("É.org", "/en/", None),
    }
    assert urls.judge_urls(table.limit(0), outcomes).count() == 0
    assert urls.judge_urls(table, outcomes.limit(0)).count() == len(given)


def test_reputation_shrinks_small_hosts_and_blocks_bad_ones(spark):
    pages = [(i, f"https://{'good' if i % 2 else 'bad'}.example.org/{i}") for i in range(400)] + [(900, "https://new.example.org/"), (901, "https://one.example.org/")]
    outcomes = [(i, int(i % 2 == 0 or i % 20 == 1)) for i in range(400)] + [(901, 1)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    got = urls.judge_urls(table, spark.createDataFrame(outcomes, "page_id long, bad int"), rules=()).collect()
    verdicts = {r["host"].split(".")[0]: r["verdict"] for r in got}
    assert verdicts["bad"] == "block" and verdicts["good"] == "allow" and verdicts["new"] == "allow"


@pytest.mark.parametrize("mask", [[], [0, 0], [1], [1, 1, 0], [0, 1, 1, 0, 1], [1, 0, 1]])
def test_masked_spans_are_the_runs_of_the_mask(mask):
    starts, ends = np.arange(len(mask)) * 3, np.arange(len(mask)) * 3 + 2
    covered = {i for first, last in chat.masked_spans(starts, ends, np.array(mask, dtype=bool)) for i in range(first // 3, last // 3 + 1)}
    assert covered == {i for i, m in enumerate(mask) if m}
    spans = chat.masked_spans(starts, ends, np.array(mask, dtype=bool))
    assert all(a[1] < b[0] - 1 for a, b in zip(spans, spans[1:]))

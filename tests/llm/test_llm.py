"""Each operator against a plain version, on fixtures with nulls, empty and long texts, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import html
import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import byte_bpe, chat, common, fingerprint, html_text, language, mixing, near_dup, quality, token_files, toxicity

DATA = "/root/testdata/sf0.01"
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "two words", "日本語 テキスト 👍🏽", "a" * 70_000 + " b", "x y " * 9000, "#*$%&|<>", "dup line\ndup line\n\nother line here", "two words"]


def docs(spark, texts, **more):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s1", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in more.items()})


def prose(rng, n, words=tuple("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split())):
    return " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))


def split(text):
    return re.findall(common.WORD_PATTERN, text or "")


@pytest.fixture(scope="module")
def tokens():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- words ----------------------------------------------------------------------------------------------------------


def test_words_are_whole_and_hash_alike():
    texts = ["Ab cd\x0bef", "", "cd", " x", "AB", "q" * 70_000, "Q" * 70_000]
    data, offsets = common.utf8(pa.array(texts))
    h, at = common.words(data, offsets, lower=True)
    assert np.diff(at).tolist() == [len(split(t)) for t in texts]
    assert h[1] == h[3] and h[0] == h[5] and h[6] == h[7] and len(set(h.tolist())) == 5


# --- 1 mixing -------------------------------------------------------------------------------------------------------


def test_mixing_meets_entropy_and_budgets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 20), "en", "big" if i % 10 < 7 else f"s{i % 10}", 1) for i in range(1000)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(d, entropy_share=0.9, most_passes=None).collect()
    total, size = collections.Counter(), collections.Counter(r[3] for r in rows)
    for r in got:
        total[r.source] += r.mix_tokens
    weight = {r.source: r.mix_weight for r in got}
    h = -sum(w * np.log(w) for w in weight.values())
    assert abs(h - 0.9 * np.log(4)) < 1e-6 and abs(sum(weight.values()) - 1) < 1e-9
    for s, w in weight.items():
        assert 0 <= total[s] - round(w * 20_000) < 20
        passes = collections.Counter(r.doc_id for r in got if r.source == s)
        whole = int(w * 20_000 // (20 * size[s]))
        assert set(passes.values()) <= {whole, whole + 1}


def test_mixing_keeps_to_most_passes(spark):
    d = docs(spark, ["a b c"] * 90 + ["d e f"]).withColumn("source", F.when(F.col("doc_id") < 90, "x").otherwise("y"))
    got = collections.Counter(r.source for r in mixing.mix(d, entropy_share=1.0, most_passes=3.0).collect())
    assert got["y"] == 3 and got["x"] in (88, 89)


def test_mixing_equals_a_plain_budget(spark):
    """Whole passes and the partial one, row for row: blocks in their permuted order until each source's budget is spent."""
    rng = random.Random(17)
    rows = [(i, prose(rng, rng.randint(0, 9)), "en", rng.choice(["a", "a", "a", "a", "b", "b", "c"]), 1) for i in range(600)]
    rows += [rows[0], rows[0]]
    d = spark.createDataFrame(rows, DOCS)
    got = collections.Counter((r.doc_id, r.mix_pass) for r in mixing.mix(d, entropy_share=0.97, most_passes=None, docs_per_block=8).collect())
    size, tokens = collections.Counter(r[3] for r in rows), collections.Counter()
    for r in rows:
        tokens[r[3]] += len(split(r[1]))
    whole = sum(tokens.values())
    share = {s: t / whole for s, t in tokens.items()}

    def entropy(a):
        z = sum(p**a for p in share.values())
        return -sum(p**a / z * math.log(p**a / z) for p in share.values())

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.97 * math.log(3) else (low, mid)
    z = sum(p**low for p in share.values())
    at = {(r.doc_id, r.text): r.h for r in d.select("doc_id", "text", (F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "text"), 11) / float(1 << 53)).alias("h")).collect()}
    want = collections.Counter()
    for s in size:
        budget = round(whole * share[s] ** low / z)
        full, left = divmod(budget, tokens[s])
        blocks = collections.defaultdict(list)
        n = math.ceil(size[s] / 8)
        for r in rows:
            if r[3] == s:
                blocks[min(int(at[r[0], r[1]] * n), n - 1)].append((at[r[0], r[1]], r[0], len(split(r[1]))))
        keys = [(b,) for b in blocks]
        turn = {r.b: r.t for r in spark.createDataFrame(keys, "b long").select("b", (F.shiftrightunsigned(F.xxhash64(F.lit(17), F.lit("+" + s), "b"), 11) / float(1 << 53)).alias("t")).collect()}
        spent = 0
        for b in sorted(blocks, key=lambda b: (turn[b], b)):
            for _, i, t in sorted(blocks[b]):
                for p in range(full + (spent < left)):
                    want[i, p] += 1
                spent += t
    assert got == want


def test_mixing_odd_rows(spark):
    got = mixing.mix(docs(spark, ODD, mix_pass="clash", part="clash"), entropy_share=None, most_passes=1.0)
    assert got.count() == len(ODD) and got.where("part = 'clash'").count() == len(ODD)
    assert mixing.mix(docs(spark, ODD).limit(0)).count() == 0


# --- 2 near duplicates ----------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    texts = list(ODD)
    for _ in range(12):
        base = prose(rng, rng.choice([3, 30, 120, 400])).split(" ")
        for _ in range(rng.randint(1, 12)):
            edited = [w if rng.random() > 0.02 else "edit" + str(rng.randint(0, 99)) for w in base]
            texts.append((" " if rng.random() < 0.5 else "\n").join(edited).upper() if rng.random() < 0.3 else " ".join(edited))
    rows = list(enumerate(texts)) + [(3, "one")]
    got = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_without_ids_or_rows(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "lone text"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.link(d).collect()}
    assert got == {(None, 2): (5, False), (5, 2): (5, True), (None, 1): (None, True), (None, 0): (None, True)}
    assert near_dup.link(d.limit(0)).count() == 0
    assert near_dup.deduplicate(d.withColumn("node", F.lit(1))).count() == 3  # the nameless copy goes


def test_odd_sketches_tell_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    b = np.r_[a[:340], rng.integers(1, 1 << 63, 60, dtype=np.uint64)]
    _, s = near_dup.signatures(np.r_[np.unique(a), np.unique(b)], np.array([0, 400, 800]))
    z = sum(int(x).bit_count() for x in (s[0, :8] ^ s[1, :8]).view(np.uint64))
    estimate = 1 + near_dup.BITS / (4 * near_dup._K) * np.log(1 - 2 * z / near_dup.BITS)
    assert abs(estimate - 340 / 460) < 0.15


# --- 3 HTML ---------------------------------------------------------------------------------------------------------


def test_main_text_of_layouts(spark):
    rows = []
    for i in range(8):
        rows.append((i, "http://a.example/x", f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><nav><a>m{i}</a><a>n</a></nav><article><h1>Head {i}</h1><p>One  &amp; two\n{i}<br>three <b>bold</b><p>Four<aside>side</aside><div class='comments'><p>nay {i}</p></div></article><footer>f</footer><script>var x='</p>';</script></body></html>"))
        rows.append((100 + i, "http://b.example/", f"<div id=menu>menu {i}</div><div class=content><p>Long text number {i} that is the page's own and has many words in it.</p><ul><li>first {i}</li><li>second</li></ul></div><div class=sidebar>other {i}</div><form><p>search</p></form>"))
    rows += [(200, None, None), (201, "x", ""), (202, "http://c.example/", "<p>unclosed &am <i>text</i"), (0, "http://a.example/x", rows[0][2])]
    got = collections.defaultdict(list)
    for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[3] == ["Head 3\n\nOne & two 3 three bold\n\nFour"] and len(got[0]) == 2
    assert got[104] == ["Long text number 4 that is the page's own and has many words in it.\n\nfirst 4\n\nsecond"]
    assert got[200] == [""] and got[201] == [""] and got[202] == ["unclosed &am text"]


def test_main_text_of_all_pages(spark):
    pages = {r.page_id: r.html for r in common.read(spark, DATA, "pages").collect()}
    for r in html_text.query(spark, DATA).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_main_text_of_pages_with_layouts_of_their_own(spark):
    story, post, note = "story words " * 40, "post words " * 9, "note words"
    pages = [
        ("http://d.example/1", f"<body><div class=story><p>{story}</p></div></body>", story),
        ("http://d.example/2", f"<body><div class=post><p>{post}</p></div></body>", post),
        ("http://e.example/1", f"<body><article><p>{story}</p></article></body>", story),
        ("http://e.example/2", f"<body><div class=post><p>{post}</p></div></body>", post),
        ("http://f.example/1", f"<body><div class=long><p>{story * 500}</p></div></body>", story * 500),
        ("http://f.example/2", f"<body><div class=short><p>{note}</p></div></body>", note),
        (None, f"<body><main><p>{story}</p></main></body>", story),
        (None, f"<body><div class=post><p>{post}</p></div></body>", post),
        ("/no/host", f"<body><div class=short><p>{note}</p></div></body>", note),
    ]
    rows = [(i, url, page) for i, (url, page, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text.strip() for i, (_, _, text) in enumerate(pages)}


def test_main_text_without_the_template_of_a_host(spark):
    legal = "<div class=x0><p>All rights stay with the house.</p><p>Words of law that every page has.</p></div>"
    house, shop = "Words of the house on each of its pages. " * 6, "<div class=x1>Order the letter by post.</div>"
    rows, want = [], {}
    for i, n in enumerate((90, 90, 200, 60, 3)):
        own = f"own {i} " + f"word{i} " * n
        rows += [(i, "http://g.example/", f"<body><div class=x2>{house}</div><div class=y><p>{own}</p></div>{legal}</body>"), (10 + i, "http://h.example/", f"<body><article><h1>Same</h1><p>{own}</p>{shop}</article></body>")]
        rows += [(20 + i, "http://i.example/", f"<body><article><p>Copied words.</p><div><p>{house}</p></div><p>edit {i}</p></article></body>")]
        want |= {i: own.strip(), 10 + i: f"Same\n\n{own.strip()}", 20 + i: f"Copied words.\n\n{house.strip()}\n\nedit {i}"}
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_names_of_layouts_are_no_furniture():
    words = "Words of the article. " * 5
    beside = "<nav>menu</nav><div class='site-footer'>foot</div><div id=sidebar-left>side</div><div class=relatedPosts-list>see</div>"
    for around in ("div class='layout has-sidebar'", "div class='content no-sidebar'", "div id='page' class='with-nav'", "section class='post social-policy'", "div class=widget", "div class=hasSidebar", "form id=all"):
        for inner in ("article", "div"):
            assert html_text.extract(f"<body><{around}><{inner}><p>{words}</p></{inner}></{around.split()[0]}>{beside}</body>") == words.strip()
    assert html_text.extract(f"<body><footer><article><p>{words}</p></article></footer><p>more</p></body>") == words.strip()
    assert html_text.extract(f"<body><article><p>Own words</p><div class='post-comments'><p>{words}</p></div></article></body>") == "Own words"
    assert html_text.extract(f"<body><div class=story><p>{words}</p></div><aside><article>teaser</article></aside></body>") == words.strip()
    assert html_text.extract("<article><p>So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "So a=2 holds"


def test_alignment_makes_optional_and_repeated_groups():
    a, b = [["t", "x"], ["t", "y"]], [["t", "x"], ["t", "z"], ["t", "z"], ["t", "y"]]
    assert html_text.align(html_text.fold(a), html_text.fold(b)) == [["t", "x"], ["?", [["+", [["t", "z"]]]]], ["t", "y"]]


def test_alignment_of_long_streams_keeps_a_common_run():
    rng = random.Random(15)
    for size, kinds in ((30, 4), (400, 6), (400, 5000)):
        a = [f"x{rng.randrange(kinds)}" for _ in range(size)]
        b = [x for x in a if rng.random() > 0.2] + ["y"] * 5
        got = html_text._matches(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
        assert len(got) > 0.5 * len(b)
    for _ in range(50):
        nodes = [["t", rng.choice("abc"), str(rng.randrange(3))] for _ in range(rng.randrange(20))]
        folded = html_text.fold(nodes)

        def values(x):
            return [v for n in x for v in ([n[2]] if n[0] == "t" else n[2])]

        assert values(folded) == [n[2] for n in nodes]
        shapes = html_text.shape(folded)
        assert all(shapes[k] != shapes[k + 1] or shapes[k][0] == "+" for k in range(len(shapes) - 1))


def test_malformed_and_empty_pages_stay_small(spark):
    import tracemalloc

    page = "<article>" + "<b>x <i>y" * 30_000 + "<p>" + "end " * 1000
    tracemalloc.start()
    text = html_text.extract(page)
    html_text.fold(html_text.stream(page))
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    assert text.startswith("x yx y") and text.endswith("end end") and len(text) > 90_000
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_text(empty).columns == ["page_id", "url", "html", "text", "n_chars"] and html_text.main_text(empty).count() == 0
    long = "<body><article><p>" + "word " * 400_000 + "</p></article></body>"
    assert html_text.main_text(spark.createDataFrame([(1, "http://z.example/", long)], empty.schema)).first().n_chars == 1_999_999


# --- 4 quality ------------------------------------------------------------------------------------------------------


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ODD + [prose(rng, 60), "a b c a b c d\nx\nx\ny x", "\n".join([prose(rng, 9)] * 12)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, texts, kept="clash"), quality.LineField.blank()).collect()}
    for i, t in enumerate(texts):
        w, t = split(t), t or ""
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(5)
    field = quality.LineField(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    x = rng.integers(0, quality.N_FEATURES, (9, len(quality.BINS)))
    doc = np.array([0] * 6 + [2] * 3)
    got = field.decode(x, doc).tolist()
    for a, b in ((0, 6), (6, 9)):
        def score(path):
            return sum(field.weights[x[a + k], y].sum() for k, y in enumerate(path)) + sum(field.moves[p, q] for p, q in zip(path, path[1:]))

        best = max(([(m >> k) & 1 for k in range(b - a)] for m in range(1 << (b - a))), key=score)
        assert got[a:b] == best


def test_line_marginals_equal_all_paths():
    rng = np.random.default_rng(12)
    parts = [(rng.integers(0, quality.N_FEATURES, (n, len(quality.BINS))).astype(np.uint8), rng.integers(0, 2, n)) for n in (3, 5, 1)]
    batch, moves = quality._Sequences(parts), rng.normal(size=(2, 2))
    score = rng.normal(size=(9, 2))
    p, pairs = batch.expect(score, moves)
    want, want_pairs = np.zeros_like(p), np.zeros((2, 2))
    for i, length in enumerate((5, 3, 1)):
        at = [batch.at[t] + i for t in range(length)]
        ways = [[(m >> k) & 1 for k in range(length)] for m in range(1 << length)]
        mass = np.array([np.exp(sum(score[a, y] for a, y in zip(at, w)) + sum(moves[y, z] for y, z in zip(w, w[1:]))) for w in ways])
        for w, q in zip(ways, mass / mass.sum()):
            for a, y in zip(at, w):
                want[a, y] += q
            for a, b, y, z in zip(at, at[1:], w, w[1:]):
                want_pairs[y, z] += q * (batch.weight[a] + batch.weight[b]) / 2
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_quality_tells_pasted_boilerplate_from_content(spark):
    field = quality.fit(common.read(spark, DATA, "documents"), common.read(spark, DATA, "labels"))
    page = common.read(spark, DATA, "documents").join(common.read(spark, DATA, "labels").where("quality = 1"), "doc_id").where("length(text) between 1500 and 3000").orderBy("doc_id").first().text
    pasted = "\n".join(["BUY!! NOW!! CHEAP!! OFFER!! " * 12, "home | news | contact | login | about | terms | help " * 8] * 3)
    rows = quality.judge(docs(spark, [page, page + "\n" + pasted, pasted]), field).orderBy("doc_id").collect()
    assert rows[0].content_share > 0.95 and 0.2 < rows[1].content_share < 0.95 and rows[2].content_share < 0.2
    twice = quality.judge(docs(spark, [page, page]), field).drop("doc_id", "lang", "source").distinct()
    assert twice.count() == 1 and quality.judge(docs(spark, [page]).limit(0), field).count() == 0


def test_quality_on_held_out_labels(spark):
    lab = {r.doc_id: r.quality for r in common.read(spark, DATA, "labels").where(~common.training_row(F.col("doc_id"))).collect()}
    rows = [r for r in quality.query(spark, DATA).collect() if r.doc_id in lab and not r.base_failed]
    assert sum(r.kept == bool(lab[r.doc_id]) for r in rows) >= 0.97 * len(rows)


# --- 5 BPE ----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, tokens):
    rng = random.Random(6)
    parts = ["a", " the", "tion", "  ", "\n", "é", "日本", "👍🏽", "'s", "12", "!!", "\x00", "\x85", "ﬁ", "aaaa", " "]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = {r.doc_id: r for r in byte_bpe.digests(docs(spark, texts), VOCABULARY, PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = tokens.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), i
        assert (got[i].decoded_sha256, got[i].decoded_chars) == (hashlib.sha256((t or "").encode()).hexdigest(), len(t or ""))
    back = byte_bpe.decode(byte_bpe.encode(docs(spark, texts, ids="clash"), VOCABULARY, PATTERN).withColumnRenamed("text", "was"), VOCABULARY, PATTERN)
    assert back.where("text <> coalesce(was, '')").count() == 0


def test_small_memories_change_nothing(tokens):
    t = byte_bpe.Transducer.from_file(byte_bpe.read_ranks(VOCABULARY), PATTERN, most_states=50, most_pieces=20)
    rng = random.Random(7)
    for _ in range(40):
        s = "".join(rng.choice("abcdehinorst  ") for _ in range(200))
        assert t.encode(s).tolist() == tokens.encode_ordinary(s)


def test_utf8_machine_at_every_cut():
    data = "aé日👍z".encode() + b"\xff\xe2\x82" + "ß".encode() + b"\xf0\x9f"
    for k in range(len(data) + 1):
        m = byte_bpe.Utf8Stream()
        assert m.feed(data[:k]) + m.feed(data[k:], last=True) == data.decode("utf-8", "replace")


# --- 6 language -----------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in common.read(spark, DATA, "documents").collect()}
    rows = [r for r in language.query(spark, DATA).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures_and_odd_texts(spark):
    d = common.read(spark, DATA, "documents")
    model = language.fit(d)
    en, fr = (d.where((F.col("lang") == x) & (F.length("text") > 4000)).orderBy("doc_id").first().text[:2000] for x in ("en", "fr"))
    got = [(r.lang_pred, r.score) for r in language.identify(docs(spark, [en + "\n" + fr, *ODD, "123 !!"], lang_pred=1), model).orderBy("doc_id").collect()]
    assert got[0][0] in ("en", "fr") and 0.35 < got[0][1] < 0.65
    assert [got[i] for i in (1, 2, 3, 9, 12)] == [("und", 0.0)] * 5 and got[6][0] != "und"
    assert language.identify(docs(spark, ["text"]), language.fit(d.limit(0))).first().lang_pred == "und"


def plain_mixture(table, k, data):
    """Windows' likelihoods, expectation-maximisation and the penalised choice of languages, number by number."""
    symbol = [c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 0 for c in data]
    windows = []
    for at in range(0, len(data), language.WINDOW):
        sums = [0.0] * k
        for i in range(at, min(at + language.WINDOW, len(data))):
            run = symbol[i] + (64 * symbol[i - 1] if i > 0 else 0) + (4096 * symbol[i - 2] if i > 1 else 0)
            for q in range(k):
                sums[q] += float(table[run, q])
        windows.append(sums)
    alive, best = list(range(k)), None
    while alive:
        p = {q: 1 / len(alive) for q in alive}
        for _ in range(12):
            new = dict.fromkeys(alive, 0.0)
            for w in windows:
                top = max(w)
                mass = {q: p[q] * math.exp(max(w[q] - top, -60)) for q in alive}
                for q in alive:
                    new[q] += mass[q] / max(sum(mass.values()), 1e-37) / len(windows)
            p = new if len(alive) > 1 else p
        total = sum(max(w) + math.log(max(sum(p[q] * math.exp(max(w[q] - max(w), -60)) for q in alive), 1e-37)) for w in windows)
        score = total - 2.0 * (len(alive) - 1) * math.log(len(windows) + 1)
        if best is None or score > best[0]:
            best = score, p
        alive.remove(min(alive, key=lambda q: p[q]))
    lead = max(best[1], key=lambda q: best[1][q])
    return lead, best[1][lead]


def test_mixture_equals_plain_expectation_maximisation():
    rng = random.Random(18)
    alphabets = ("abcdefgh ", "efghijkl ", "abijmnop ")
    talk = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    counts = {f"l{k}": np.bincount(language._trigrams(*common.utf8(pa.array([talk(k, 20_000)]))), minlength=64**3) for k in range(3)}
    made = language.Languages.fit(counts)
    texts = [talk(0, 300), talk(0, 500) + talk(1, 400), talk(2, 40), "".join(talk(k, 200) for k in (0, 1, 2)), "", talk(1, 49)] * 2
    lead, share = made.predict(*common.utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        want = plain_mixture(made.table, 3, t.encode()) if t else (-1, 0.0)
        assert lead[i] == want[0] and abs(share[i] - want[1]) < 1e-3, i


def test_language_of_no_and_repeated_rows(spark):
    d = common.read(spark, DATA, "documents")
    model = language.fit(d)
    assert language.identify(d.limit(0), model).count() == 0
    one = d.where("length(text) > 500").orderBy("doc_id").limit(1)
    assert language.identify(one.unionByName(one), model).select("lang_pred", "score").distinct().count() == 1


# --- 7 fingerprints -------------------------------------------------------------------------------------------------


PIECE = re.compile(rf"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){{1,{fingerprint.PIECE_WORDS}}}")


def chained_hash(key, k):
    return xxhash.xxh64_intdigest(struct.pack("<i", k), seed=xxhash.xxh64_intdigest(struct.pack("<Q", key), seed=42))


def plain_difference(a, b):
    """How many digests are in one of two fingerprints only; None if their difference can't be peeled."""
    cells = collections.defaultdict(lambda: [0, 0, 0])
    for sign, text in ((1, a), (-1, b)):
        for cell in text.split():
            tab, pos, n, key, chk = cell.split(":")
            c = cells[int(tab), int(pos)]
            c[:] = c[0] + sign * int(n), c[1] ^ int(key, 16), c[2] ^ int(chk, 16)
    found = 0
    while pure := next((c for c in cells.values() if abs(c[0]) == 1 and c[2] == chained_hash(c[1], 1)), None):
        n, key, chk = pure
        found += 1
        for tab in range(3):
            c = cells[tab, chained_hash(key, 100 + tab) & (fingerprint.CELLS - 1)]
            c[:] = c[0] - n, c[1] ^ key, c[2] ^ chk
    return None if any(map(any, cells.values())) else found


def test_fingerprints_equal_sets_of_pieces(spark):
    rng = random.Random(8)
    texts = ODD + [prose(rng, rng.choice([5, 60, 300, 900])) for _ in range(20)] + [prose(rng, 9000)]
    texts += [texts[-1], texts[-2] + " more"]
    rows = sorted(enumerate(texts), reverse=True)
    made = fingerprint.compare(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, bucket string"))
    got = {r.doc_id: r for r in made.collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, x) in enumerate(rows):
        x, y = x or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        a, b, c = (set(PIECE.findall(t)) for t in (x, edited, y))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(a, b)) < 1e-9 and abs(r.near_next - like(a, c)) < 1e-9, i
        cells = [x.split(":") for x in r.fingerprint.split()]
        assert all(sum(int(n) for t, _, n, _, _ in cells if t == str(tab)) == len(a) for tab in range(3))
    assert max(r.cells_next for r in got.values()) > fingerprint.CELLS and min(r.cells_next for r in got.values()) == fingerprint.CELLS
    by_text = collections.defaultdict(set)
    for i, t in enumerate(texts):
        by_text[t].add(got[i].fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_likeness_comes_from_the_fingerprints(spark):
    """The columns fingerprint and edited_fingerprint alone give near_next and near_edited, where their difference can be peeled."""
    rows = sorted(fingerprint.query(spark, "/root/testdata/sf0.001").collect(), key=lambda r: -r.doc_id)
    size = lambda text: sum(int(c.split(":")[2]) for c in text.split() if c[0] == "0")
    told = 0
    for k, r in enumerate(rows):
        for one, like, cells in ((r.edited_fingerprint, r.near_edited, r.cells_edited), (rows[(k + 1) % len(rows)].fingerprint, r.near_next, r.cells_next)):
            d, both = plain_difference(r.fingerprint, one), size(r.fingerprint) + size(one)
            assert d is not None or cells > fingerprint.CELLS
            if d is not None:
                told += 1
                assert abs(like - ((both - d) / (both + d) if both else 1.0)) < 1e-12
    assert told > len(rows)


def test_fingerprints_of_odd_tables(spark, monkeypatch):
    d = spark.createDataFrame([(None, "a b"), (None, "c d"), (1, "e f"), (1, "e f")], "doc_id long, text string")
    assert fingerprint.compare(d).count() == 4 and fingerprint.compare(d.limit(0)).count() == 0
    one = fingerprint.compare(d.where("text = 'a b'")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a a").hexdigest() and one.near_next == 1.0
    # Skewed ids, one id on many rows, and null ids: parts are cut until they are small.
    rng = random.Random(13)
    rows = [(1 << 62, "far")] + [(i, prose(rng, 3)) for i in range(300)] + [(7, prose(rng, 4)) for _ in range(300)] + [(None, prose(rng, 5)) for _ in range(300)]
    monkeypatch.setattr(fingerprint, "HEAVY", 20)
    monkeypatch.setattr(fingerprint, "SUB", 16)
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 4)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert table.count() - 1 > max(r.n for r in fingerprint._parted(table)[1]) < 40
    hashes = {r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    got = {(r.doc_id, r.text): r.edited for r in fingerprint.versions(table).collect()}
    assert len(got) == len(set(rows))
    for k, (i, x) in enumerate(order):
        half, y = len(x) // 2, order[(k + 1) % len(order)][1]
        assert got[i, x] == x[: len(x) - half] + y[:half]


# --- 8 chat ---------------------------------------------------------------------------------------------------------


def test_reply_trees(spark):
    rows = [("c", 1, None, "user", "root", 0.0), ("c", 2, 1, "assistant", "good \\<|im_end|>", 2.0), ("c", 3, 1, "assistant", "bad", -2.0), ("c", 4, 2, "us\ner", None, 1.0), ("c", 9, 77, "user", "orphan", 9.0)]
    m = spark.createDataFrame(rows, "conv_id string, msg_id long, parent_id long, role string, text string, score double")
    got = chat.format_paths(m).orderBy("rank").select("rank", "n_turns", chat.turns(F.col("formatted")).alias("t"), "formatted", "loss").collect()
    assert [[x.text for x in r.t] for r in got] == [["orphan"], ["root", "good \\<|im_end|>", ""], ["root", "bad"]]
    assert got[1].t[2].role == "us\ner" and got[1].formatted.count("<|im_end|>") == 3
    assert [got[2].formatted[x["at"] - 1 : x["at"] - 1 + x["length"]] for x in got[2].loss] == ["bad"]
    assert chat.format_paths(m, branches=1).count() == 1
    loop = spark.createDataFrame([("c", 1, 2, "u", "x", 0.0), ("c", 2, 1, "u", "y", 0.0)], m.schema)
    assert chat.paths(loop).count() == 0
    tail = [("c", 1, 3, "u", "x", 0.0), ("c", 2, 1, "u", "y", 0.0), ("c", 3, 2, "u", "z", 0.0), ("c", 4, 3, "u", "tail", 0.0), ("c", 5, 4, "u", "end", 0.0), ("c", 6, None, "u", "lone", 0.0)]
    assert [r.path for r in chat.paths(spark.createDataFrame(tail, m.schema)).collect()] == [[6]]
    assert chat.paths(m.limit(0)).count() == 0 and chat.format_paths(m.withColumn("most", F.lit(1)).withColumn("loss", F.lit(2))).count() == 3


def test_replies_along_a_long_text(spark):
    rows = [("c", 1, None, "user", "long " * 300_000, 0.0), ("c", 2, 1, "assistant", "<|" * 200_000, 0.0)]
    r = chat.report(chat.format_paths(spark.createDataFrame(rows, "conv_id string, msg_id long, parent_id long, role string, text string, score double"))).first()
    assert (r.n_turns, r.loss_chars) == (2, 400_000) and r.loss_sha256 == hashlib.sha256(b"<|" * 200_000).hexdigest()


def test_threads_of_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "n"), (None, 1, "user", "m")] + [(2, i, "assistant", f"t{i}") for i in range(37)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv_id", F.struct("conv_id"))
    got = {r.conv_id.conv_id: r for r in chat.report(chat.format_paths(chat.threads(d))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 2, 2: 37}
    said = "".join(f"t{i}" for i in range(37))
    assert got[2].loss_chars == len(said) and got[2].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# --- 9 token files --------------------------------------------------------------------------------------------------


def test_token_files_count_all(spark, tokens, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 100)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 64)
    rng = random.Random(9)
    texts = ODD + [prose(rng, rng.randint(0, 60)) for _ in range(60)]
    d = docs(spark, texts, file="clash", place="clash").repartition(3)
    d = d.unionByName(d.where("doc_id = 9"))
    want = collections.Counter((i, len(tokens.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    want[9, len(tokens.encode_ordinary(texts[9]))] += 1
    got = token_files.count_documents(d, VOCABULARY, PATTERN, 50256).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_files.count_documents(d.limit(0), VOCABULARY, PATTERN, 50256).count() == 0
    with pytest.raises(ValueError):
        token_files.write(d, VOCABULARY, PATTERN, 1 << 16, "/nowhere")


def test_plain_files_are_read_whatever_wrote_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 10)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 6)
    files = {"a.bin": [1, 2, 9, 9, 3, 9], "b.bin": [5] * 40 + [9] + [6] * 3, "c.bin": [], "d.bin": [9], "e.bin": [0x0900, 0x0009, 9]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes() + (b"x" if name == "b.bin" else b""))
    got = sorted((r.file, r.place, r.n_tokens) for r in token_files.count(spark, str(tmp_path), 9).collect())
    assert got == [("a.bin", 0, 2), ("a.bin", 1, 0), ("a.bin", 2, 1), ("b.bin", 0, 40), ("b.bin", 1, 3), ("d.bin", 0, 0), ("e.bin", 0, 1), ("e.bin", 1, 0)]
    assert token_files.count(spark, str(tmp_path / "none"), 9).count() == 0


def test_counts_survive_other_partitions(spark, tokens, tmp_path):
    """Partitions that change between the writing and the counting change no count."""
    rng = random.Random(14)
    texts = [prose(rng, rng.randint(0, 30)) for _ in range(400)]
    docs(spark, texts).repartition(16).write.parquet(str(tmp_path / "d"))
    d, at = spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "flat")
    listed = token_files.write(d, VOCABULARY, PATTERN, 50256, at)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = listed.join(token_files.count(spark, at, 50256), ["file", "place"], "left").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(tokens.encode_ordinary(t)) for i, t in enumerate(texts)}


# --- 10 toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(10)
    rows, lab = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = prose(rng, 80).split(" ")
        for _ in range(3 if bad else 0):
            w[rng.randrange(80)] = rng.choice(["vequo", "moron,", "Scum", "trash"]) + rng.choice(["", "", "s"])
        rows.append((i, " ".join(w)))
        lab.append((i, int(bad)))
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    got = toxicity.score(d, model).join(labels, "doc_id").where(~common.training_row(F.col("doc_id"))).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.98 * len(got)
    odd = toxicity.score(docs(spark, ODD, score="clash"), model).collect()
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in odd)
    alone = toxicity.score(d, toxicity.fit(d, labels.limit(0))).collect()  # the lexicon alone: it has three of the four words, and no plural of two
    hit = [int(bool(re.search(r"(?i)\b(morons?|scum|trash)\b", r.text))) for r in alone]
    assert all(r.predicted <= h for r, h in zip(alone, hit)) and sum(r.predicted for r in alone) > 0.6 * sum(hit) > 100
    assert toxicity.fit(d.limit(0), labels.limit(0)).bias < 0 and toxicity.score(d.limit(0), model).count() == 0
    twice = toxicity.score(d.limit(1).unionByName(d.limit(1)), model).select("score").distinct()
    assert twice.count() == 1


def test_label_model_finds_classes_without_labels():
    rng = np.random.default_rng(11)
    y = (rng.random(6000) < 0.3).astype(int)
    right = np.array([0.8, 0.7, 0.6, 0.75, 0.65])
    votes = (rng.random((6000, 5)) < np.where(y[:, None] == 1, right, 0.03)).astype(float)
    both = np.c_[votes, votes[:, 4]]
    post, rate, together = toxicity.label_model(both, np.full(6000, -1), np.ones(6000))
    assert together[4, 5] > 0.9 > abs(together[0, 1]) and np.abs(rate[1, :5] - right).max() < 0.08
    assert ((post > 0.5) == (y == 1)).mean() > 0.97


def test_posterior_equals_plain_expectation_maximisation():
    rng = np.random.default_rng(16)
    y = rng.random(400) < 0.4
    votes = (rng.random((400, 4)) < np.where(y[:, None], 0.7, 0.1)).astype(float)
    weight = rng.random(400) + 0.5
    label = np.where(np.arange(400) % 3 == 0, y.astype(int), -1)
    got = toxicity.label_model(votes, label, weight, trust=0.9, rounds=1)[0]
    post = [0.05 if z < 0 else 0.9 if z else 0.1 for z in label]
    share = [[w * (1 - p) for w, p in zip(weight, post)], [w * p for w, p in zip(weight, post)]]
    rate = [[(sum(s * v[j] for s, v in zip(c, votes)) + 0.01) / (sum(c) + 1) for j in range(4)] for c in share]
    corr = np.zeros((4, 4))
    for c, r in zip(share, rate):
        cov = np.array([[sum(s * (v[i] - r[i]) * (v[j] - r[j]) for s, v in zip(c, votes)) / sum(c) for j in range(4)] for i in range(4)])
        corr += sum(c) / sum(weight) * cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    np.fill_diagonal(corr, 1)
    voice = 1 / np.maximum(corr, 0).sum(1)
    for k, v in enumerate(votes):
        odds = np.log(sum(share[1]) / sum(share[0]))
        for j in range(4):
            odds += voice[j] * (np.log(rate[1][j] / rate[0][j]) if v[j] else np.log((1 - rate[1][j]) / (1 - rate[0][j])))
        odds += {-1: 0, 0: -1, 1: 1}[int(label[k])] * np.log(9)
        assert abs(got[k] - 1 / (1 + np.exp(-odds))) < 1e-9


def test_threshold_lies_in_the_widest_gap():
    assert toxicity.threshold(np.array([-3.0, -1.0, 2.0, 4.0]), np.array([0, 0, 1, 1]), np.ones(4)) == 0.5
    assert -1 < toxicity.threshold(np.array([-3.0, 3.0, -1.0, 2.0, 4.0, 0.0]), np.array([0, 0, 0, 1, 1, 1]), np.ones(6)) < 0
    assert 0 < toxicity.threshold(np.array([0.0, 0.0, 0.0, 9.0]), np.array([0, 0, 1, 1]), np.ones(4)) < 9


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tokens):
    d = common.read(spark, DATA, "documents")
    clean = {r.doc_id for r in common.read(spark, DATA, "labels").where("quality = 1").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = common.written(stage(spark, d, DATA))
        assert out.columns == d.columns
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        d = out
    assert len(kept["language_id"]) >= 990 and len(kept["quality_rules"] & clean) >= 0.95 * len(clean)
    before = {r.doc_id: r.text for r in common.read(spark, DATA, "documents").collect()}
    rows = [(i, before[i]) for i in sorted(kept["quality_rules"])][:300]
    want = {i for i, _, c in brute_components(rows) if i == c}
    got = {r.doc_id for r in near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    last = corpus_pipeline.tokens(spark, d, DATA).orderBy("doc_id").limit(20).collect()
    assert all(list(r.ids) == tokens.encode_ordinary(before[r.doc_id]) for r in last)
    assert all(r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest() for r in last)
    assert corpus_pipeline.tokens(spark, d.limit(0), DATA).count() == 0
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs(spark, ODD), DATA).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")

"""Every operator against brute force on small frames, and on the cases its docstring defines."""

import hashlib

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablewise.llm import backoff, bpe, embeddings, html, licenses, mixing, quality, simhash, substring, urls
from tablewise.llm.components import components
from tablewise.llm.queries import ORACLES, QUERIES
from tablewise.llm.xxh import xxh64
from tests.compare import compare, connect

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, fp string, ids string, _row string, component_id string"
random.seed(5)
VOCABULARY = ["".join(random.choices("abcdeé", k=random.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", ".", ",", "\n"]) for _ in range(n))


PASSAGE = prose(80, 99)
TEXTS = [
    *[prose(random.randint(30, 160), i) for i in range(20)], prose(60, 1), prose(60, 1), prose(40, 50) + " " + PASSAGE, PASSAGE + " " + prose(70, 51),
    prose(30, 52) + "  " + PASSAGE + "\t" + prose(30, 53), prose(3000, 54), prose(3000, 54) + " tail", "word " * 300, None, "", " \n\t ", "one", "two words", "ABC abc", "x" * 30_000,
]


def frame(spark, texts=TEXTS, extra=True):
    rows = [(i, t, [None, "en", "", "de"][i % 4], [None, "hot", "hot", "s3", ""][i % 5], len(t) if t is not None else None, *["clash"] * 6) for i, t in enumerate(texts)]
    if extra:
        rows += [(None, "no id here", "en", "hot", None, *[None] * 6), rows[3], (None, None, None, None, None, *[None] * 6)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_xxh64():
    data = random.Random(1).randbytes(5000)
    start = np.array([random.Random(i).randrange(4000) for i in range(500)])
    stop = start + np.arange(500)
    assert xxh64(data, start, stop, 42).tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(start, stop)]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (-5, 160), (160, 159)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = roots({n for p in links for n in p}, links)
    assert {n: got.get(n, n) for n in want} == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- 1


@pytest.mark.parametrize("weights", [None, {"hot": 0.7, "s3": 0.2, None: 0.1, "absent": 5.0}, {}])
def test_mixing_keeps_every_source_within_a_block(spark, weights):
    docs = frame(spark, [f"t{i}" for i in range(400)])
    got = mixing.mixed(docs, weights, block=3, period=50, buckets=8).toPandas().sort_values("mix_position")
    assert got.mix_position.tolist() == list(range(docs.count()))
    assert Counter(got.doc_id.fillna(-1)) == Counter(r.doc_id if r.doc_id is not None else -1 for r in docs.collect())
    source = got.source.where(got.source.notna(), None)
    sizes = Counter(source)
    slots = mixing.shares(sizes, weights, 50)
    assert sum(slots.values()) == 50 and min(slots.values()) >= 1
    blocks = got.assign(source=source.astype(object).where(source.notna(), "null")).drop_duplicates(["source", "mix_block"])
    assert blocks.mix_slot.is_unique and blocks.mix_slot.is_monotonic_increasing
    assert ((blocks.mix_release <= blocks.mix_slot) & (blocks.mix_slot < blocks.mix_deadline)).all()
    done = Counter()
    for b in blocks.itertuples():
        done[None if b.source == "null" else b.source] += 1
        for s, k in slots.items():
            assert abs(done[s] - min(-(-sizes[s] // 3), k * (b.mix_slot + 1) / 50)) < 1


def test_mixing_order_and_edges(spark):
    docs = frame(spark)
    out = mixing.interleaved(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert mixing.mixed(empty(spark)).count() == 0
    many = mixing.shares({f"s{i}": 1 for i in range(70)}, None, 10)
    assert sum(many.values()) == 70
    mixing.schedule(mixing.shares({"a": 9, "b": 1, "c": 3, "d": 77}, None, 97))


# --- 2


def brute_substring(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = ([x for x, g in zip(w, gone) if not g], len(w))
    return out


def test_substring_against_brute_force(spark):
    r = random.Random(8)
    base = prose(400, 70).split(" ")
    texts = list(TEXTS)
    for k in range(25):  # edits, shifts, nested and overlapping passages, runs of one word
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = f"edit{r.randrange(9)}"
        a = r.randrange(300)
        texts.append(" ".join(t[a : a + r.randint(20, 200)] + prose(r.randint(0, 30), k).split(" ")))
    texts += ["same " * 120 + "end", "start " + "same " * 70]
    docs = frame(spark, texts, extra=False)
    want = brute_substring(list(enumerate(texts)))
    got = {x.doc_id: x for x in substring.digests(docs).collect()}
    assert len(got) == len(texts)
    for i, (kept, n) in want.items():
        assert (got[i].n_words, got[i].n_removed) == (n, n - len(kept)), i
        assert got[i].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    cut = {x.doc_id: x for x in substring.deduplicated(docs).collect()}
    assert substring.deduplicated(docs).columns == docs.columns
    for i, (kept, n) in want.items():
        assert words(cut[i].text) == kept
        assert cut[i].text == texts[i] if len(kept) == n else cut[i].n_chars == len(cut[i].text)


def test_substring_edges(spark):
    docs = frame(spark)
    assert substring.deduplicated(docs).count() == docs.count()
    assert substring.digests(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)], "doc_id bigint, text string")
    assert [r.n_removed for r in substring.digests(twice).collect()] == [0, 0, 0]


# --- 3


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.ORG/en/12?x#y", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        ("https://x.example.org/fr/porn", "x.example.org", "/fr/porn", "org/", "allow"),
        ("http://notexample.org", "notexample.org", "", None, "allow"),
        ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
        ("http://a.com/DE/", "a.com", "/DE/", None, "allow"),
        ("http://com.net/fr/", "com.net", "/fr/", None, "allow"),
        ("http://a.net/XXX/", "a.net", "/XXX/", None, "block"),
        ("http://a.net/xxxl-shirts", "a.net", "/xxxl-shirts", None, "allow"),
        ("http://a.net/free/free?free", "a.net", "/free/free", None, "allow"),
        ("http://a.net/free?q=casino", "a.net", "/free", None, "block"),
        ("http://a.net?b://c", "a.net", "", None, "allow"),
        ("porn without a host", "", "", None, "block"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_url(url, host, path, rule, verdict):
    assert urls.Judge(urls.RULES, urls.STRICT, urls.SOFT, urls.SOFT_HITS)(url)[:4] == (host, path, rule, verdict)


@pytest.mark.parametrize("tail", ["", "?page=2&ref=x", "?utm_source=feed", "#top"])
def test_verdicts_do_not_turn_on_tracking_parameters(tail):
    judge = urls.Judge((), urls.STRICT, urls.SOFT, urls.SOFT_HITS)
    for host in ("free-bets.example.com", "blog.adult-x.example.net", "www.cheap-pills.example.com", "www.spam-farm.example.org", "m.ads-track.example.com", "m.casino-win.example.com"):
        assert judge(f"http://{host}/en/12/{tail}")[3] == "block", host
    for url in ("http://blog.therly.example.net/en/3160", "https://essex.example.org/sexton/winter", "http://news.example.com/free-speech", "http://a.example.net/promo"):
        assert judge(url + tail)[3] == "allow", url


def test_urls_frame(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, "http://a.org/", "y"), (None, "http://b.de/" + "z" * 9000, None)], "page_id bigint, url string, verdict string")
    assert Counter(r.verdict for r in urls.judged(pages).collect()) == {"allow": 3}
    assert urls.judged(pages.limit(0)).count() == 0


# --- 4


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_brute_force(spark, order):
    texts = [*TEXTS, TEXTS[0]]
    grams = [[Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) for k in range(1, order + 1)] for w in map(words, texts)]
    every = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    total = sum(len(words(t)) for t in texts)
    docs = frame(spark, texts, extra=False)
    got = {r.doc_id: r for r in backoff.scored(docs, order=order, chunk_chars=4000, bucket_chars=2000, least_buckets=4).collect()}
    for i, t in enumerate(texts):
        w, logs = words(t), []
        left = lambda g: every[len(g) - 1][g] - grams[i][len(g) - 1][g]  # noqa: B023, E731
        for j in range(len(w)):
            log = 0.0
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if k == 1:
                    log += math.log(left(g) / (total - len(w))) if left(g) else math.log(1 / (total - len(w) + 1))
                elif left(g):
                    log += math.log(left(g) / left(g[:-1]))
                    break
                else:
                    log += math.log(backoff.ALPHA)
            logs.append(log)
        assert got[i].n_words == len(w)
        assert got[i].score is None if not w else abs(got[i].score - sum(logs) / len(w)) < 1e-9
    assert backoff.scored(empty(spark)).count() == 0
    assert backoff.scored(frame(spark)).count() == len(TEXTS) + 3


def test_backoff_uses_trigrams(spark):
    docs = frame(spark, ["a b c x", "a b c y", "b c z a b w"], extra=False)
    assert {r.doc_id: r.n_full for r in backoff.scored(docs).collect()} == {0: 1, 1: 1, 2: 0}
    rows = lambda **o: sorted(map(tuple, backoff.scored(frame(spark), chunk_chars=3000, **o).collect()), key=str)
    assert rows() == rows(spare_bits=64) == rows(spare_bits=0, least_buckets=2) and rows() != rows(order=2)


# --- 5


def test_quality(spark):
    clean = [prose(120, 1000 + i) for i in range(60)]
    junk = [" ".join(w + "###" for w in prose(120, 5).split()), "again and again\n" * 60, "short", None, "", "CLICK!! " + " ".join(w + "!!" for w in prose(90, 6).split())]
    docs = frame(spark, clean + junk, extra=False)
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert [i for i in got if got[i].kept] == list(range(60))
    assert {r.doc_id for r in quality.filtered(docs).collect()} == set(range(60))
    assert quality.filtered(docs).columns == docs.columns
    for i, t in enumerate(clean + junk):
        w, s = words(t), t or ""
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        inside = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in s.split("\n") if x.strip(" \t\n\r\v\f")]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in s), len(lines) - len(set(lines)), len(inside))
        assert (int(got[i].n_words), got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
    assert quality.quality(empty(spark)).count() == 0
    assert quality.quality(frame(spark)).count() == len(TEXTS) + 3


def test_quality_limits_move_with_the_source(spark):
    """What is normal in one source is not in another; a source with few documents leans on its language."""

    def marked(i, every):
        return " ".join(w + "|" * (j % every == 0) for j, w in enumerate(prose(200, i).split()))

    rows = [(i, marked(i, 2 + i % 3), "en", "tables") for i in range(400)] + [(400 + i, prose(200, 400 + i), "en", "prose") for i in range(1500)]
    rows += [(1900 + i, prose(200, 1900 + i), "en", "small") for i in range(5)] + [(1905 + i, prose(200, 2400 + i), None, None) for i in range(60)]
    same = marked(1, 3)
    rows += [(2000, same, "en", "tables"), (2001, same, "en", "prose"), (2002, same, None, "")]  # the last leans on all documents
    loud = " ".join(w + "|" * 30 for w in prose(200, 7).split())
    rows += [(2003, loud, "en", "tables"), (2004, loud, "en", "prose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.quality(docs, ["doc_id"]).filter("kept").collect()}
    assert {i for i, *_ in rows} - kept == {2001, 2003, 2004}
    assert kept == {r.doc_id for r in quality.filtered(docs).collect()}
    limits = {(r._lang, r._source): r._hi_symbols for r in quality.thresholds(quality.features(docs, ["doc_id"])).collect()}
    assert min(limits["en", "tables"], limits["en", "small"]) > 3 * limits["en", "prose"] and ("", "") in limits


# --- 6


def test_bpe_is_the_library_s(spark):
    texts = [*TEXTS, "a<|endoftext|>b <|startoftext|>", "é ́x\u00a0y\u2003z İSTANBUL ΑΣ don't we'll 'S\x01 \x01 \x1ca\x85b", "가 각 ᄀ ᅡ \U0001f600\U0001f600"]
    docs = frame(spark, texts, extra=False)
    library = Tokenizer.from_file(BPE)
    got = {r.doc_id: r for r in bpe.digests(docs, BPE, words=50, chunks=5, joins=7, mean=8).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encoded(docs, BPE, mean=4).collect()}
    back = {r.doc_id: r.decoded for r in bpe.decoded(bpe.encoded(docs, BPE), BPE).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        text = library.decode(want, skip_special_tokens=False)
        assert back[i] == text and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(empty(spark), BPE).count() == 0
    assert bpe.digests(frame(spark), BPE).count() == len(TEXTS) + 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_joins_are_repaired(name):
    codec = bpe.Codec(public_tokenizers.path(name), mean=2)
    texts = [t.encode() for t in TEXTS[:24] if t] + [b"  two  spaces\n\n\nlines ", b" lead"]
    assert codec.ids(texts) == codec.encode(texts)
    assert codec.ids([]) == []


# --- 7


def brute_print(t):
    w = words(t and t.translate(urls.LOWER))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    texts = list(TEXTS)
    for k in range(40):
        t = prose(600, 77).split(" ")
        t[k * 7 % 600] = "changed"
        texts.append(" ".join(t))
    docs = frame(spark, texts, extra=False)
    prints = [brute_print(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = roots(range(len(texts)), links)
    got = {r.doc_id: r for r in simhash.classes(docs).collect()}
    assert {i: r.fp % 2**64 for i, r in got.items()} == dict(enumerate(prints))
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_simhash_grids_find_every_link(spark, parts):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(120)]
    prints = sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(4)} | {0, 2**64 - 1})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {tuple(sorted((x.u, x.v))) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), parts=parts).collect()}
    assert got == {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}


def test_simhash_edges(spark):
    docs = frame(spark)
    got = simhash.classes(docs).collect()
    assert len(got) == docs.count()
    assert {r.fp for r, t in zip(got, got) if r.doc_id in (27, 28, 29)} <= {0, *[r.fp for r in got]}
    ids = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert simhash.classes(empty(spark)).count() == 0 and simhash.deduplicated(empty(spark)).count() == 0


# --- 8

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header>Site</header>
<nav><ul><li><a href=x>Menu</a></ul></nav><div class="notice-bar">Notice</div><aside>Side</aside><article><h1>A &amp; B</h1><p>First
line<br>goes  on &eacute;&#33; <b>bold</b><p>Be.<div class="ad">Buy</div><form><p>Mail</form><p>Last one is longer than the others.
<section id="comments"><p>Reader says</p></section></article><footer>&copy; all</foot"""


def test_html_page():
    assert html.main_text(PAGE) == "A & B\nFirst line goes on é! bold\nBe.\nLast one is longer than the others."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("plain text") == "plain text"
    assert html.main_text("<aside><article><p>Teaser</p></article></aside><main><p>Main</p></main>") == "Main"
    long = "".join(f"<p>{prose(40, i)}</p>" for i in range(400))
    assert html.main_text(f"<body><nav>m</nav>{long}<footer>f</footer>") == "\n".join(" ".join(prose(40, i).split()) for i in range(400))


def test_html_unclosed_and_hidden():
    body = "".join(f"<p>{prose(30, i)}" for i in range(3))
    text = "\n".join(" ".join(prose(30, i).split()) for i in range(3))
    for hidden in ("<p class=ad>Buy", "<div class='x ad-box'>Buy</div>", "<ul class=menu><li>a<li>b</ul>", "<p style='Display: none'>No", "<hr class=ad>", "<p hidden>No"):
        assert html.main_text(f"<article><h1>T</h1>{hidden}{body}</article>") == f"T\n{text}"
        assert html.main_text(f"<body class=home><div class='wrap with-sidebar no-ads'>{hidden}{body}</div></body>") == text
    assert html.main_text(f"<article class='post comments-open'>{body}</article><article class='comment'>Reader</article>") == text
    assert html.main_text("<article><ul><li class=share>Share<li>One<li>Two</ul></article>") == "One\nTwo"
    assert html.main_text("<table><tr><td class=ad>Buy<td>1<tr><td>2</table>") == "1\n2"


def test_html_skewed():
    paragraphs = [f"{i:02} " + "x" * 97 for i in range(30)]
    texts = ["A heading of 20 chars", "y" * 50_000, *paragraphs]
    lines = f"<h1>{texts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in texts[1:])
    for page in (f"<body>{lines}</body>", f"<body><div>{lines}<p>End.</p></div><div><a>1</a></div>"):
        assert html.main_text(page).split("\n")[:32] == texts
    assert html.main_text(f"<body><div>{lines}<p>End.</p></div>").endswith("End.")
    short = "<article><p>Short one.</p></article>"
    long = "<article>" + "".join(f"<p>{'z' * 5000}</p>" for _ in range(30)) + "</article>"
    assert html.main_text(short + long + short).count("Short one.") == 2


def test_html_names():
    body = "".join(f"<p>{prose(30, i)}</p>" for i in range(3))
    text = "\n".join(" ".join(prose(30, i).split()) for i in range(3))
    for kept in ("<h2 id=related-work>Kept</h2>", "<h2 id=comments>Kept</h2>", "<p id=share-prices>Kept</p>", "<section id=menu-planning>Kept</section>"):
        assert html.main_text(f"<article>{kept}{body}</article>") == html.main_text(f"<body>{kept}{body}</body>") == f"Kept\n{text}"
    for hidden in ("<div class=left-sidebar>Out</div>", "<section id=comments>Out</section>", "<div class=ad-container-2>Out</div>", "<h2 class=related>Out</h2>"):
        assert html.main_text(f"<article>{hidden}{body}</article>") == text
    for name in ("content-left-sidebar", "sidebar"):
        assert html.main_text(f"<body><div class=menu>Out</div><div class={name}>{body}<div class=share>Out</div></div></body>") == text
    assert html.main_text(f"<body><div hidden class=sidebar>{body}</div><p>In</p></body>") == "In"


def test_html_teasers_and_lists():
    story = [" ".join(prose(40, i).split()) for i in range(6)]
    paragraphs = "".join(f"<p>{x}</p>" for x in story)
    teasers = "".join(f"<article><h3><a href=/{i}>Teaser {i}</a></h3><p>Some words on it.</p></article>" for i in range(5))
    links = "<ul>" + "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(60)) + "</ul>"
    foot = "<div>" + "".join(f"<p>foot {i}</p>" for i in range(60)) + "</div>"
    for page in (f"<div>{paragraphs}</div>{teasers}", f"{teasers}<div>{paragraphs}</div>{teasers}", f"<div>{paragraphs}</div>{foot}"):
        assert html.main_text(f"<body>{page}</body>") == "\n".join(story)
    for holder in ("div", "article"):
        assert html.main_text(f"<body>{links}<{holder}>{paragraphs}{links}{paragraphs}</{holder}>{links}</body>") == "\n".join(story * 2)
    assert html.main_text(f"<body><article>{paragraphs}</article>{teasers}</body>").startswith("\n".join(story))
    assert html.main_text(f"<article>{paragraphs}<ul><li>One <a>two</a><li>Three<li>Four</ul></article>").endswith("One two\nThree\nFour")
    assert html.main_text(f"<body><div class=ad>{paragraphs}</div><article><p>Short.</p></article></body>") == "Short."
    assert html.main_text(links) == "\n".join(f"link {i}" for i in range(60))  # a page of nothing else


def test_html_planted_pages():
    """Pages built from known parts: the story comes back whole, wherever it stands, and nothing else does."""
    rng = random.Random(8)
    for seed in range(150):
        story = [" ".join(prose(rng.randint(15, 80), seed * 50 + i).split()) for i in range(rng.randint(4, 12))]
        if rng.random() < 0.5:
            story.insert(rng.randint(1, 3), "Short.")
        menu = "<ul>" + "".join(f"<li><a href=/{i}>to {i}</a></li>" for i in range(rng.randint(3, 30))) + "</ul>"
        around = [menu, "<div>" + "".join(f"<span><a>x{i}</a></span> " for i in range(9)) + "</div>", "<nav>Go</nav>", "<div class=ad>Buy</div>",
                  "<article><a href=/>Next one to read</a></article>", "<div hidden>" + "no " * 300 + "</div>", "<footer>End</footer>"]
        rng.shuffle(around)
        cut = rng.randint(0, len(around))
        holder = rng.choice(["div", "section", "article", "main"])
        body = "".join(f"<p>{x}" + rng.choice(["", "</p>"]) for x in story)
        page = f"<html><body>{''.join(around[:cut])}<{holder}>{body}</{holder}>{''.join(around[cut:])}</body></html>"
        assert html.main_text(page) == "\n".join(story), (seed, holder)


def brute_cluster(lines):
    """The cluster in plain loops: ratios, weighted median by counting up, Gaussian by its sum, containers one by one."""
    ratio = [(len(x.text) - x.linked) / max(x.tags, 1) for x in lines]
    weight = [min(len(x.text), 500) for x in lines]
    seen, median = 0.0, None
    for r, w in sorted(zip(ratio, weight), key=lambda x: x[0]):
        seen += w
        if median is None and seen >= sum(weight) / 2:
            median = r
    mean = sum(min(r, 4 * median) * w for r, w in zip(ratio, weight)) / sum(weight)
    gauss = [math.exp(-0.5 * (d / 1.5) ** 2) for d in range(-5, 6)]
    smooth = [sum(ratio[min(max(i + d, 0), len(ratio) - 1)] * g for d, g in zip(range(-5, 6), gauss)) / sum(gauss) for i in range(len(ratio))]
    good = {x.container for x, v in zip(lines, smooth) if v >= mean / 4}
    own = {c: [r for r, x in zip(ratio, lines) if x.container == c] for c in good}
    good = {c for c in good if max(own[c]) >= mean / 16 or len(own[c]) < 3 and max(own[c]) >= 1}
    at = [i for i, x in enumerate(lines) if x.container in good]
    return lines[at[0] : at[-1] + 1] if at else []


def test_html_cluster():
    rng = random.Random(9)
    for _ in range(300):
        lines = []
        for i in range(rng.randint(1, 60)):
            n = int(10 ** rng.uniform(0, 3))
            lines.append(html.Line("x" * n, rng.randint(0, 9), rng.choice([0, 0, n, n // 2]), 0, i // rng.randint(1, 9), 0, 0))
        assert html.clustered(lines) == brute_cluster(lines)
    assert html.clustered([]) == []


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    got = html.extracted(pages).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [len(html.main_text(PAGE))] * 2 + [0] and got[2].text == ""
    assert html.extracted(pages.limit(0)).count() == 0


# --- 9


def test_licenses(spark):
    mit = ". ".join(licenses.SENTENCES[k].upper() for k in ("mit_name", "mit_grant", "mit_condition", "as_is"))
    texts = ["Prose.\nReleased under the MIT License.\nMore.", mit + ".", "all rights RESERVED!", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License", None, "", "nothing", "license"]
    got = {r.doc_id: r for r in licenses.scanned(frame(spark, texts, extra=False)).collect()}
    assert [got[i].licenses for i in range(8)] == ["MIT", "MIT", "Proprietary", "CC-BY-NC-4.0, MIT", "", "", "", ""]
    assert [got[i].n_license_sentences for i in range(8)] == [1, 4, 1, 2, 0, 0, 0, 0]
    assert licenses.scanned(empty(spark)).count() == 0
    hint = licenses.HINTS.removeprefix("(?i)").split("|")
    assert all(any(h in s for h in hint) for s in licenses.SENTENCES.values())
    text = licenses.scanned(frame(spark, texts))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


MIT_TEXT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
"""
BSD_TEXT = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """3) Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_TEXT = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language.
"""
GPL_TEXT = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
MPL_TEXT = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_licenses_canonical(spark):
    mit, apache = "mit_name mit_grant mit_condition as_is", "apache_notice apache_grant apache_as_is"
    bsd = "reserved bsd_grant bsd_source bsd_binary"
    cases = [
        (MIT_TEXT, mit, "MIT"), (MIT_TEXT.replace("\n", "\r\n"), mit, "MIT"), ("\n\n".join(" ".join(p.split()) for p in MIT_TEXT.split("\n\n")), mit, "MIT"),
        ("The MIT License (MIT)\n" + MIT_TEXT.split("\n\n", 2)[2], mit, "MIT"),
        (BSD_TEXT, bsd, "BSD-2-Clause, Proprietary"), (BSD_TEXT + BSD_NAMES, bsd + " bsd_names", "BSD-3-Clause, Proprietary"),
        (APACHE_TEXT, apache, "Apache-2.0"), (APACHE_TEXT.replace("# ", "").replace("#", ""), apache, "Apache-2.0"),
        (GPL_TEXT, "gpl_free gpl_terms gpl_hope", "GPL-3.0"), (MPL_TEXT, "mpl_notice", "MPL-2.0"),
        ("All\u00a0rights reserved.", "reserved", "Proprietary"), ("All rights\u00a0reserved.", "reserved", "Proprietary"), ("All rights\nreserved", "reserved", "Proprietary"),
        ("This program is free\nsoftware: and", "gpl_free", ""), ("All rights\n\nreserved", "", ""), ("Not all rights reserved", "", ""), ("all rights reserved here", "", ""),
        ("See v. 2. All rights reserved", "reserved", "Proprietary"), ("All rights\ue000reserved", "reserved", "Proprietary"),
    ]
    got = {r.doc_id: r for r in licenses.scanned(frame(spark, [c[0] for c in cases], extra=False)).collect()}
    assert [(got[i].license_sentences, got[i].licenses) for i in range(len(cases))] == [c[1:] for c in cases]
    hint = licenses.HINTS.removeprefix("(?i)").split("|")
    assert all(" " not in h for h in hint)
    assert all(any(h in s for h in hint) for s in licenses.known_sentences(licenses.SENTENCES, licenses.WHOLE))


# --- 10


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((300, 16))
    rows = [(i, (base[i % 300] * (1 + i) + r.standard_normal(16) * 0.04 * (i // 300) * (1 + i)).tolist()) for i in range(600)]
    rows += [(600, rows[5][1]), (601, (2 * np.array(rows[5][1])).tolist()), (602, None), (603, [0.0] * 16), (604, [float("nan")] * 16), (605, [None] * 16), (606, [1.0] * 3), (607, []), (None, rows[5][1])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    good = [i for i in range(602)]
    x = embeddings.unit(np.array([rows[i][1] for i in good], np.float32).astype(np.float64))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(good, [(i, j) for i, j in zip(*np.nonzero(near))])
    got = {r.vec_id: r for r in embeddings.classes(docs, centroids=4, tile=50, recall=1.0).collect()}
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in good)
    assert 0.99 * near.sum() <= found <= near.sum()
    if found == near.sum():
        assert {i: got[i].component_id for i in good} == want
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(602, 608))
    assert got[None].n_links == 0 and got[None].kept
    assert embeddings.classes(docs.limit(0)).count() == 0


def test_embeddings_recall_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = docs.toPandas()
    x = embeddings.unit(np.array(p.embedding.tolist(), np.float64))
    links = (x @ x.T >= 0.95).sum() - len(x)
    found = embeddings.classes(docs).agg(F.sum("n_links")).first()[0]
    assert 0.99 * links <= found <= links


# --- queries and pipeline


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    assert compare(spark, connect(sf), QUERIES[name], ORACLES.get(name), sf) is None


def test_pipeline_against_its_parts(spark, sf):
    """The stages by brute force: rules, one document of each group, passages cut, all encoded."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in quality.quality(docs).filter("kept").orderBy("doc_id").collect()]
    prints = {i: brute_print(t) for i, t in kept}
    ids = list(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 3]
    reps = set(roots(ids, links).values())
    cut = brute_substring([(i, t) for i, t in kept if i in reps])
    library = Tokenizer.from_file(BPE)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(cut)
    for r in got:
        want = library.encode(b" ".join(cut[r.doc_id][0]).decode(), add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want)


def test_stages_return_documents(spark, sf):
    docs = frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


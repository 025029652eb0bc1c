"""Tokenizers, token files, packing, mixing and pages."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import place
from tokenizers import Tokenizer

from plotcheck.llm import html_extract, mixing, packing, token_output
from plotcheck.llm.tokens import Encoder

FILES = {"space": public_tokenizers.path("byte_bpe_50k.json"), "word": public_tokenizers.path("word_bpe_49k.json")}


def whole(split, text):
    t = Tokenizer.from_file(FILES[split])
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("split", ["space", "word"])
def test_parts_equal_whole(split, rows):
    rng = random.Random(1)
    pieces = ["a", "B", " ", "  ", "\n", "\t", "'s", "'LL", "12", ".", ",", "é", "é", "\xa0", "\x1c", "　", "<|endoftext|>", "\0", "\r\n", "Σ", "İ", "ſ", "👍", "word", "Wort."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(1500)] + [r[1] for r in rows if r[1]]
    enc = Encoder(FILES[split], split)
    t = Tokenizer.from_file(FILES[split])
    t.encode_special_tokens = True
    for text in texts:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    assert Encoder(FILES[split], "none").ids("a b") == enc.ids("a b")


@pytest.mark.parametrize("bits", [1, 8])
def test_file_round_trip(bits):
    rng = np.random.default_rng(0)
    counts = [0, 1, 5, 70_000, 3]
    ids = rng.integers(0, 50_000, sum(counts), dtype=np.uint32)
    ids[10] = 2**32 - 1
    data = token_output.write_file([3, -(2**63), None, 9, 2**40], counts, ids, block=1000, bits=bits)
    d, n, back = token_output.read_file(data)
    assert d.to_pylist() == [3, -(2**63), None, 9, 2**40] and n.tolist() == counts and (back == ids).all()
    assert token_output.read_file(token_output.write_file([], [], ids[:0]))[2].tolist() == []


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_extreme_ids(spark):
    df = spark.createDataFrame([(-(2**63), "a"), (None, "b"), (2**63 - 1, "c"), (-(2**62), "d")] + [(5, "same")] * 50, "doc_id long, text string")
    got = sorted((r.start, r.doc_id) for r in token_output.written_digest(df, FILES["word"]).collect())
    assert [i for _, i in got] == [None, -(2**63), -(2**62), *[5] * 50, 2**63 - 1]


def test_written_digest(docs, rows, no_docs):
    got = token_output.written_digest(docs, FILES["word"]).collect()
    ordered = sorted(rows, key=place)
    want, start = Counter(), 0
    for r in ordered:
        ids = whole("word", r[1] or "") + [1]
        want[r[0], start, len(ids), crc(ids)] += 1
        start += len(ids)
    assert Counter(map(tuple, got)) == want
    assert token_output.written_digest(no_docs, FILES["word"]).count() == 0


def test_packing(docs, rows, no_docs):
    got = packing.best_fit_pack(docs, FILES["space"], length=64).collect()
    want = Counter()
    for r in rows:
        ids = whole("space", r[1] or "") + [2]
        first = len(ids) % 64 or 64
        for k, s in enumerate([0, *range(first, len(ids), 64)]):
            e = s + (64 if k else first)
            want[r[0], k, s, e - s, crc(ids[s:e])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(n for b in bins.values() for _, n in b) // 64) + 3
    assert packing.best_fit_pack(no_docs, FILES["space"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 30, 3000])
def test_local_search(n):
    rng = random.Random(n)
    sizes = [rng.choice([rng.randint(1, 1023), rng.randint(300, 400)]) for _ in range(n)]
    bins = packing.pack(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(n))
    assert all(sum(sizes[i] for i in b) <= 1024 for b in bins)
    assert len(bins) <= len(packing.pack(sizes, 1024, search=False))


def best_packing(sizes, capacity):
    """The least number of bins, by trying all."""
    best = len(sizes)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(sizes):
            best = len(room)
            return
        for i in range(len(room)):
            if room[i] >= sizes[k] and room[i] not in room[:i]:
                place(k + 1, [*room[:i], room[i] - sizes[k], *room[i + 1 :]])
        place(k + 1, [*room, capacity - sizes[k]])

    place(0, [])
    return best


def test_search_saves_bins():
    """On small sets the search comes nearer to the optimum than best fit; on a repeated one it saves many bins."""
    rng = random.Random(4)
    optimum = fit = found = 0
    for _ in range(300):
        sizes = sorted((rng.randint(15, 50) for _ in range(9)), reverse=True)
        optimum += best_packing(sizes, 100)
        fit += len(packing.pack(sizes, 100, search=False))
        found += len(packing.pack(sizes, 100))
    assert optimum <= found < fit and found - optimum <= 0.6 * (fit - optimum)
    sizes = [6, 5, 5, 4, 4, 4, 2] * 30
    assert len(packing.pack(sizes, 10)) == 90


def test_nothing_is_left_to_step():
    """No move, swap or two-for-one swap that fills a bin from a no fuller one remains, in bins of many items too."""
    rng = random.Random(8)
    for low, high, n in ((1, 60, 400), (20, 60, 60), (34, 60, 60)):
        sizes = [rng.randint(low, high) for _ in range(n)]
        bins = [[sizes[i] for i in b] for b in packing.pack(sizes, 100)]
        fill = list(map(sum, bins))
        for b, own in enumerate(bins):
            for c, other in enumerate(bins):
                if b == c or fill[c] > fill[b] or fill[b] == 100:
                    continue
                pairs = [other[p] + other[q] for p in range(len(other)) for q in range(p)]
                assert not any(0 < y - x <= 100 - fill[b] for x in (0, *own) for y in (*other, *pairs))


def test_full_pieces_stand_alone(spark):
    text = " ".join(f"word{i}" for i in range(4000))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], "doc_id long, text string")
    got = packing.best_fit_pack(df, FILES["space"], length=64).collect()
    full = [r for r in got if r.length == 64]
    assert len({r.sequence_id for r in full}) == len(full) > 400 and all(r.offset == 0 for r in full)
    assert all(r.sequence_id < 0 for r in full) and all(r.sequence_id >= 0 for r in got if r.length < 64)


def brute_targets(sizes, weights=(3, 1, 2)):
    total = 1.5 * sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, out = set(), {}
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        out = {s: 2.0 * sizes[s] for s in capped} | {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if out[s] > 2 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mix(docs, rows, no_docs):
    got = mixing.mix_digest(docs).collect()
    size = lambda t: len((t or "").encode().split())
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += size(r[1])
    targets = brute_targets(per)
    source = defaultdict(list)
    for r in rows:
        source[r[0], size(r[1])].append(r[3])
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = next(s for s in source[r.doc_id, r.size] if abs(targets[s] - r.target) < 1e-3 and per[s] == r.source_size)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert len(got) == len(rows)
    for s in per:
        assert abs(taken[s] - targets[s]) <= longest[s] + 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_digest(docs.repartition(7)).collect()))
    assert mixing.mix_digest(no_docs).count() == 0
    again = mixing.mix(docs)
    assert again.columns == docs.columns
    assert sum(size(r.text) for r in again.collect()) == sum(taken.values())


PAGE = "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav>Menu</nav><div id='cookie-notice'>Cookies</div>{}<footer>&copy; foot</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (PAGE.format("<article><h1>A &lt; b</h1><p>One <i>two</i>\n three<br>four<p>Five<script>if(a<b){'</p>'}</script></article>"), "A < b\nOne two three four\nFive"),
        (PAGE.format("<main><ul><li>a<li>b</ul><aside>side</aside><form>x<input></form><div class='ad'>buy</div><section class='comments'><p>reader</p></section><p>c</p></main>"), "a\nb\nc"),
        (PAGE.format("<p>no main</p><div hidden>x</div><div style='display: none'>y</div>"), "no main"),
        ("<article><p>cut off <b>he", "cut off he"),
        ("<body><form id='all' class='no-sidebar'><article class='post category-search'><p>in</p><form>x</form></article></form></body>", "in"),
        ("<main><p>text</p><section class='comments'><article class='comment'>reader</article></section><aside><article>other</article></aside></main>", "text"),
        ("<article>a<!-- <p>no</p> -->b<style>p{}</style><noscript>n</noscript></article>", "ab"),
    ],
)
def test_page_text(html, text):
    assert html_extract._Page(html or "").main_text(None) == text


def brute_template(pages):
    """{token: pages} of the valid classes of one host, from the token sequences of its distinct pages."""
    pages = sorted(pages)
    every = {t for p in pages for t in p}
    classes = defaultdict(set)
    for t in every:
        vector = tuple(p.count(t) for p in pages)
        if sum(map(bool, vector)) >= html_extract.PAGES and 2 * sum(map(bool, vector)) > len(pages):
            classes[vector].add(t)
    classes = {v: c for v, c in classes.items() if len(c) >= html_extract.TOKENS}
    for v, c in list(classes.items()):
        ranks = defaultdict(set)
        for p in pages:
            own = [t for t in p if t in c]
            for n in range(0, len(own), len(c)):
                time = own[n : n + len(c)]
                for i, t in enumerate(time):
                    ranks[t].add(i if len(set(time)) == len(c) else None)
        classes[v] = {t for t in c if len(ranks[t]) == 1 and ranks[t] != {None}}
    classes = {v: c for v, c in classes.items() if len(c) >= html_extract.TOKENS}

    def times(p, c):
        at = [i for i, t in enumerate(p) if t in c]
        rows = [at[i : i + len(c)] for i in range(0, len(at), len(c))]
        orders = {tuple(p[i] for i in r) for r in rows}
        return rows, orders

    ordered = {v: [times(p, c) for p in pages] for v, c in classes.items()}
    sound = lambda k, v: all(len(set(o)) == len(classes[v]) for o in ordered[v][k][1]) and len(ordered[v][k][1]) <= 1
    out = {}
    for v, c in classes.items():
        seen = set()
        for k, p in enumerate(pages):
            if not v[k]:
                continue
            if not sound(k, v):
                seen.add(None)
                continue
            for row in ordered[v][k][0]:
                around = []
                for w, d in classes.items():
                    for r in ordered[w][k][0] if w != v and sound(k, w) else ():
                        if r[0] < row[0] < r[-1]:
                            gap = sum(i <= row[0] for i in r)
                            around.append((r[0], w, gap, row[-1] <= r[gap]))
                home = max(around)[1:3] if around and all(x[3] for x in around) else None if around else (0, 0)
                seen.add((next(iter(ordered[v][k][1])), home) if home else None)
        if len(seen) == 1 and None not in seen:
            out |= {t: sum(map(bool, v)) for t in c}
    return out


def test_classes_and_nesting(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))

    def page(kind):
        items = "".join(f"<li class='i'><b>{word()}</b><p class='k'>fixed</p></li>" for _ in range(rng.randrange(1, 4)))
        swap = ["<div class='s1'>one</div>", "<div class='s2'>two</div>", "<div class='s3'>three</div>"]
        if kind == "unordered":
            rng.shuffle(swap)
        late = "<div class='late'>L1</div><div class='late2'>L2</div>" if rng.random() < 0.7 else ""
        early = "<div class='early'>E</div>" if late else ""  # one class over two gaps of the other
        return f"<body>{early}<div class='top'>Hello</div><ul class='list'>{items}</ul>{''.join(swap)}<div class='text'>{word()} {word()}</div>{late}<div class='end'>Bye</div></body>"

    data = [(i, f"http://{kind}.example/{i}", page(kind)) for kind in ("ordered", "unordered") for i in range(14)]
    data += data[:5] * 3 + [(50 + i, "http://few.example/", page("ordered")) for i in range(2)]
    df = spark.createDataFrame([(*d, "x", "y") for d in data], "page_id long, url string, html string, tokens string, class string")
    got = {r.host: {t & (1 << 64) - 1: n for t, n in zip(r.tokens, r.pages, strict=True)} for r in html_extract.templates(df).collect()}
    sizes = []
    for kind in ("ordered", "unordered"):
        pages = {tuple(html_extract._Page(h).tokens) for _, u, h in data if f"/{kind}." in u}
        want = brute_template(pages)
        assert got[f"{kind}.example"] == want and len(pages) == 14
        sizes.append(len(want))
    assert sizes[0] > sizes[1] > 0 and "few.example" not in got
    out = {(r.url, r.page_id): r.text for r in html_extract.main_texts(df).collect()}
    text = out["http://ordered.example/3", 3]
    assert "Hello" not in text and "Bye" not in text and "one" not in text.split("\n") and len(text.split("\n")) >= 2


def test_copies_of_an_article_are_no_template(spark):
    """Repeated pages count once, and an article that many pages of a host share stays on each."""
    rng = random.Random(2)
    para = lambda: "<p>" + " ".join(rng.choice("abcdefgh") * 4 for _ in range(12)) + "</p>"
    shared = "".join(para() for _ in range(5))
    page = lambda body: f"<div class='top'>Welcome</div><nav>m</nav><article><h1>T</h1>{body}</article><div class='end'>Impressum</div>"
    data = [(i, "http://h.example/", page(shared + para() if i < 12 else "".join(para() for _ in range(4)))) for i in range(18)] + [(99, "http://h.example/", page(shared))] * 30
    out = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(len(out[i].split("\n")) >= 6 for i in range(12)) and len(out[99].split("\n")) >= 5
    assert all("Welcome" not in t and "Impressum" not in t for t in out.values())


def test_marks_are_not_needed(spark):
    """With article and main taken away, the slots give the same texts."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r"</?(article|main)[^>]*>", ""))
    a, b = ({(r.page_id, r.url): r.text for r in html_extract.main_texts(x).collect()} for x in (pages, bare))
    assert sum(a[k] == b[k] for k in a) >= 0.95 * len(a) > 0


def test_templates(spark):
    rng = random.Random(3)
    page = lambda i: f"<div class='top'>Welcome all</div><div class='x'><b>Mark</b></div><p>{' '.join(rng.choice('abcdefgh') * 3 for _ in range(9))} {i}</p><div class='end'>Impressum hier</div>"
    data = [(i, f"http://h.example/{i}", page(i), "z") for i in range(12)] + [(99, None, None, "z"), (99, None, None, "z"), (100, "http://one.example/", page(100), "z")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, template string")
    out = html_extract.main_texts(df).collect()
    assert len(out) == len(data)
    by = {r.page_id: r for r in out}
    for i in range(12):
        assert by[i].text.endswith(f" {i}") and "Welcome" not in by[i].text and "Impressum" not in by[i].text and "\n" not in by[i].text
        assert by[i].n_chars == len(by[i].text)
    assert by[99].text == "" and "Welcome all" in by[100].text
    old, html_extract.BROADCAST = html_extract.BROADCAST, -1  # templates too large to broadcast
    try:
        assert Counter(map(tuple, html_extract.main_texts(df).collect())) == Counter(map(tuple, out))
    finally:
        html_extract.BROADCAST = old
    assert html_extract.main_texts(spark.createDataFrame([], df.schema)).count() == 0

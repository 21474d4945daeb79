"""URL filter, token counts, license scan, HTML text, byte-level BPE and fingerprints, against brute force."""

import base64
import math
import os
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symdex.llm import byte_bpe, fingerprints, html_extract, license_scan, queries, token_counts, url_filter
from symdex.llm.kernel import Chunk

from .frames import CLASHES, LONG, ODD, docs, multiset, with_clashes, words

PIECES, BPE = queries._tokenizer("piece_bpe_32k.model"), queries._tokenizer("byte_bpe_50k.tiktoken")
needs_tokenizers = pytest.mark.skipif(not os.path.exists(BPE), reason="no vocabulary files")


# URL filter


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def url_rows(seed, n=300):
    r = random.Random(seed)
    hosts = ["news.example.org", "shop.example.com", "uni.example.edu"] * 3 + ["best-casino.example.net", "xxx-pills.example.biz"]
    return [(i, f"{r.choice(['http', 'HTTPS'])}://{r.choice(hosts)}/{r.choice(['a', 'item', 'win'])}/{r.randrange(50)}", None) for i in range(n)]


class Markov:
    """Witten-Bell smoothing over dictionaries."""

    def __init__(self, urls):
        self.n = defaultdict(Counter)
        for u in urls:
            b = b"\x02" + u.encode()  # the start is part of the context
            for i in range(1, len(b)):
                for k in range(min(i, url_filter.ORDER) + 1):
                    self.n[b[i - k : i]][b[i]] += 1

    def p(self, context, c):
        p = 1 / 256
        for k in range(len(context) + 1):
            own = self.n.get(context[len(context) - k :])
            if own:
                total, kinds = sum(own.values()), len(own)
                p = (own[c] + kinds * p) / (total + kinds)
        return p


def plain_score(models, url):
    b = b"\x02" + url.encode()
    total = 0.0
    for i in range(1, len(b)):
        context = b[max(0, i - url_filter.ORDER) : i]
        total += math.log(models[0].p(context, b[i])) - math.log(models[1].p(context, b[i]))
    return total / (len(b) - 1)


@pytest.mark.parametrize("bucket", [url_filter.BUCKET, 40])
def test_url_scores(spark, bucket, monkeypatch):
    monkeypatch.setattr(url_filter, "BUCKET", bucket)
    df = pages(spark, url_rows(1))
    prepared = df.select("page_id", url_filter._prepared(F.col("url")).alias("u"), url_filter._rejected(F.col("url")).alias("bad"), (F.pmod(F.xxhash64(url_filter._prepared(F.col("url"))), F.lit(url_filter.HELD_OUT)) == 0).alias("held")).collect()
    models = [Markov([r["u"] for r in prepared if r["bad"] == bad and not r["held"]]) for bad in (False, True)]
    want = {r["page_id"]: plain_score(models, r["u"]) for r in prepared}
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    assert set(got) == set(want)
    for i, s in want.items():
        assert got[i]["score"] == pytest.approx(s, abs=1e-9)
    held = [r for r in prepared if r["held"]]
    wrong = [r for r in held if got[r["page_id"]]["kept"] == r["bad"]]
    assert len(held) > 10 and len(wrong) <= 0.1 * len(held)


def test_url_threshold_has_the_least_error():
    r = random.Random(3)
    for _ in range(20):
        rows = [(k / 10, r.randrange(4), r.randrange(4)) for k in range(r.randrange(1, 12))]
        a, b = sum(x[1] for x in rows), sum(x[2] for x in rows)
        if not a or not b:
            assert url_filter.threshold(rows) == 0
            continue
        error = lambda cut: sum(x[1] for x in rows if x[0] < cut) / a + sum(x[2] for x in rows if x[0] >= cut) / b
        assert error(url_filter.threshold(rows)) == pytest.approx(min(error(c) for c in [-1.05, *(x[0] + 0.05 for x in rows)]))


def test_url_odd_rows(spark):
    rows = [(1, None, None), (2, "", None), (3, "http://", None), (4, "x", None), (4, "x", None), (None, "https://casino.example/é", None), (6, "http://a.example/" + "y" * 50_000, None)]
    df = with_clashes(pages(spark, rows))
    got = url_filter.filter_urls(df).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((i, u) for i, u, _ in rows)
    assert all(r["kept"] and r["score"] is None for r in got if r["page_id"] in (1, 2, 3))
    assert all(r["score"] is not None for r in got if r["page_id"] not in (1, 2, 3))
    assert url_filter.filter_urls(df.limit(0)).count() == 0


LOOKALIKES = ("essex.gov.uk", "alphabets.org", "pharmacy.nhs.uk", "downloads-mirror.org")


def test_hosts_that_only_look_like_rejected_ones_are_kept(spark):
    rows = url_rows(2, 600)
    rows += [(1000 + 40 * k + i, f"https://{host}/item/{i}", None) for k, host in enumerate(LOOKALIKES) for i in range(40)]
    got = url_filter.filter_urls(pages(spark, rows)).collect()
    look = [r for r in got if r["page_id"] >= 1000]
    assert not any(r["rejected_seed"] for r in look)
    assert sum(r["kept"] for r in look) >= 0.95 * len(look)
    lost = [r for r in got if not r["kept"]]
    assert len(lost) > 50 and sum(r["rejected_seed"] for r in lost) >= 0.95 * len(lost)


def test_labels_need_no_word_list(spark):
    r = random.Random(6)
    kinds = ("blue", "green")
    rows = [(i, f"http://{r.choice('abcdef')}.example/{kinds[i % 2]}{r.randrange(30)}/{r.randrange(99)}", None) for i in range(1200)]
    told = [(i, i % 2 == 1) for i in range(800)] + [(1, True)]  # the rest has no label
    labels = spark.createDataFrame(told, "page_id bigint, rejected boolean")
    got = {x["page_id"]: x for x in url_filter.filter_urls(pages(spark, rows), labels=labels).collect()}
    assert len(got) == len(rows) and all(got[i]["rejected_seed"] is None for i in range(800, 1200))
    assert sum(got[i]["kept"] == (i % 2 == 0) for i in range(800, 1200)) >= 0.98 * 400


def test_url_filter_on_held_out_pages(spark, sf_dir):
    got = queries.op2_url_filter(spark, sf_dir.replace("0.001", "0.01")).where(F.pmod(F.xxhash64(url_filter._prepared(F.col("url"))), F.lit(url_filter.HELD_OUT)) == 0).collect()
    assert sum(r["kept"] != r["rejected_seed"] for r in got) >= 0.9 * len(got)


# token counts

TEXTS = ["", " ", "  two  spaces ", "Hello world", "a\nb\n\nc", "naïve café — œuvre", "日本語のテキスト", "😀 emoji 😀😀", "▁mark ▁▁", "tab\tcr\r\n", "x" * 500, "\u0000\u0001 control", "zzzqqq123 45,67.8"]


def unigram_of(vocabulary):
    from tokenizers import Tokenizer, decoders, models, normalizers

    scores = [(p, s) for p, s in vocabulary]
    t = Tokenizer(models.Unigram(scores, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    t.decoder = decoders.Fuse()
    return t


@needs_tokenizers
def test_counts_are_the_tokenizers(spark):
    """The same pieces and scores, read as a unigram model by another library."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = range(m.get_piece_size())
    low = min(m.get_score(i) for i in ids)
    t = unigram_of([("<unk>", low - 100)] + [(m.id_to_piece(i), float(m.get_score(i)) if not m.is_byte(i) else low - 1000.0) for i in ids if not (m.is_unknown(i) or m.is_control(i))])
    r = random.Random(1)
    texts = TEXTS + [words(r, r.randrange(1, 40)) for _ in range(30)] + ["".join(r.choice("abcdeé 日😀\n") for _ in range(r.randrange(60))) for _ in range(60)]
    got = token_counts.load(PIECES).counts(pa.array(texts)).tolist()
    for text, n in zip(texts, got):
        # a run of unknown characters is one token there before its bytes are listed
        assert n == (len(t.encode(text).ids) if text else 0), repr(text)


def plain_viterbi(scores, text):
    """(score, pieces) by trying every piece at every end."""
    low = min(scores.values()) - token_counts.UNKNOWN_PENALTY
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(end):
            own = scores.get(text[start:end])
            if own is not None and (found is None or best[start][0] + own > found[0]):
                found = (best[start][0] + own, best[start][1] + 1)
        if text[end - 1] not in scores and (found is None or best[end - 1][0] + low > found[0]):
            found = (best[end - 1][0] + low, best[end - 1][1] + len(text[end - 1].encode()))
        best.append(found)
    return best[-1]


@pytest.mark.parametrize("joined", [False, True])
def test_viterbi_against_all_paths(joined):
    """Small vocabularies with many ties; ``joined`` ones have pieces across words, so texts aren't cut."""
    r = random.Random(2 + joined)
    for _ in range(60):
        pool = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁a", "▁", "▁▁", "aa"] + (["a▁b", "c\na"] if joined else [])
        scores = {p: -float(r.randrange(1, 5)) for p in pool if r.random() < 0.7}
        scores.setdefault("a", -1.0)
        u = token_counts.Unigram(scores)
        texts = ["".join(r.choice("abcdé \n") for _ in range(r.randrange(14))) for _ in range(20)]
        want = [plain_viterbi(scores, " ".join(["", t]).replace(" ", "▁"))[1] if t else 0 for t in texts]
        assert u.counts(pa.array(texts)).tolist() == want


@needs_tokenizers
def test_token_counts_odd_rows(spark):
    df = with_clashes(docs(spark, ODD))
    got = token_counts.token_counts(df, PIECES).collect()
    u = token_counts.load(PIECES)
    want = Counter((i, None if t is None else 0 if not t else u.count("▁" + t.replace(" ", "▁"))) for i, t in ODD)
    assert multiset(got) == want
    assert token_counts.token_counts(df.limit(0), PIECES).count() == 0


# license scan


def plain_scan(rows, templates, threshold):
    """Every run of lines of every text; of those that hold no smaller match, such as share a line are one."""
    out = Counter()
    for doc, text in rows:
        sets = [(no, set(re.findall("[a-z0-9]+", line.lower()))) for no, line in enumerate((text or "").split("\n"), 1)]
        sets = [x for x in sets if x[1]]
        for name, t in templates.items():
            own = set(re.findall("[a-z0-9]+", t.lower()))
            alpha, found = max(1, math.ceil(threshold * len(own) - 1e-9)), {}
            for i in range(len(sets)):
                block = set()
                for j in range(i, len(sets)):
                    block = block | sets[j][1]
                    if j > i and len(block) > license_scan.STRETCH * len(own):
                        break
                    if len(block & own) >= alpha:
                        found[i, j] = block
            least = [(i, j) for i, j in found if not any((a, b) != (i, j) and i <= a and b <= j for a, b in found)]
            while pair := next(((x, y) for x in least for y in least if x != y and x[0] <= y[1] and y[0] <= x[1]), None):
                least = [x for x in least if x not in pair] + [(min(x[0] for x in pair), max(x[1] for x in pair))]
            for i, j in least:
                block = set().union(*(sets[k][1] for k in range(i, j + 1)))
                out[(doc, sets[i][0], sets[j][0] - sets[i][0] + 1, name, len(block & own), len(own))] += 1
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_license_scan(spark, threshold):
    r = random.Random(7)
    templates = {f"t{k}": words(r, r.randrange(1, 12), 25) for k in range(12)}
    rows = [(i, "\n".join(words(r, r.randrange(0, 14), 25) for _ in range(r.randrange(6)))) for i in range(80)]
    want = plain_scan(rows, templates, threshold)
    assert len({k[2] for k in want}) > 1 or threshold == 1.0
    assert want and multiset(license_scan.scan(docs(spark, rows), templates, threshold).collect()) == want


def test_license_scan_odd_rows(spark):
    rows = ODD + [(20, "x\nReleased under the MIT License.\n" * 2), (20, "x\nReleased under the MIT License.\n" * 2), (None, LONG + " all rights reserved"), (21, "ÉALL RIGHTS reserved!")]
    df = with_clashes(docs(spark, rows))
    got = multiset(license_scan.scan(df).collect())
    assert got == plain_scan(rows, license_scan.TEMPLATES, license_scan.THRESHOLD) and len(got) >= 4
    assert license_scan.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(df, {"none": "!!"})


def test_a_wrapped_notice_is_one_match(spark, tmp_path):
    """The long notices, broken at 40 columns, within a comment and with a blank line; and full texts from files."""
    rows, want = [], []
    for k, name in enumerate(("mit-terms", "bsd")):
        w, broken = license_scan.TEMPLATES[name].split(), [""]
        for x in w:
            broken = [*broken[:-1], f"{broken[-1]} {x}".strip()] if len(broken[-1]) < 40 else [*broken, x]
        rows.append((k, "\n".join(["// Some code", *[f"// {x}" for x in broken[:2]], "", *[f"// {x}" for x in broken[2:]], "int main()"])))
        want.append((k, name))
    got = license_scan.scan(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["template"]) for r in got) == want and all(r["n_lines"] > 2 for r in got)
    full = "\n\n".join(words(random.Random(k), 70, 5000) for k in range(4))
    (tmp_path / "own.txt").write_text(full)
    (tmp_path / "notes.md").write_text("no template")
    text = re.sub(r"((?:\S+\s+){9})", r"\1\n", full)
    (hit,) = license_scan.scan(docs(spark, [(7, f"before\n{text}\nafter"), (8, full[:300])]), license_scan.read_templates(str(tmp_path))).collect()
    assert hit["doc_id"] == 7 and hit["template"] == "own" and hit["overlap"] >= 0.8 * hit["n_template"]


def test_license_sql_on_wrapped_lines(spark):
    import duckdb

    r = random.Random(9)
    templates = {f"t{k}": words(r, r.randrange(2, 12), 25) for k in range(8)}
    rows = [(i, "\n".join(words(r, r.randrange(0, 5), 25) for _ in range(r.randrange(12)))) for i in range(60)]
    documents = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    assert Counter(con.execute(license_scan.oracle(templates, 0.6)).fetchall()) == plain_scan(rows, templates, 0.6)


# HTML


class PlainTree(HTMLParser):
    """A tree of well-formed pages by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = {"name": "#", "up": None, "kids": []}

    def handle_starttag(self, tag, attrs):
        node = {"name": tag, "up": self.at, "kids": []}
        self.at["kids"].append(node)
        if tag not in html_extract._VOID:
            self.at = node

    def handle_endtag(self, tag):
        while self.at["name"] != tag:
            self.at = self.at["up"]
        self.at = self.at["up"]

    def handle_data(self, data):
        if " ".join(data.split()) and not self.silent():
            self.at["kids"].append(" ".join(data.split()))

    def silent(self):
        node = self.at
        while node:
            if node["name"] in html_extract._SILENT:
                return True
            node = node["up"]
        return False


def plain_content(page):
    """Texts of the chosen subtrees, by recursion over the tree."""
    p = PlainTree()
    p.feed(page)
    p.close()
    nodes = []

    def measure(n):
        nodes.append(n)
        n["c"], n["t"], n["lc"], n["lt"] = 0, 1, 0, int(n["name"] == "a")
        for k in n["kids"]:
            if isinstance(k, str):
                n["c"] += len(k)
                continue
            measure(k)
            for x in ("c", "t", "lc", "lt"):
                n[x] += k[x]
        if n["name"] == "a":
            n["lc"] = n["c"]

    measure(p.root)
    body = next((n for n in nodes if n["name"] == "body"), p.root)
    ratio = body["lc"] / max(1, body["c"])

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        value = c / t * math.log(c / max(lc, 1) * t / max(lt, 1))
        return value / math.log(base) if base > 1 + 1e-12 else value

    for n in nodes:
        n["d"] = density(n["c"], n["t"], n["lc"], n["lt"])
    for n in nodes:
        texts = sum(density(len(k), 1, 0, 0) for k in n["kids"] if isinstance(k, str))
        n["sum"] = texts
        for k in n["kids"]:
            if not isinstance(k, str):
                n["sum"] += k["d"]
    below, stack = [], [k for k in reversed(body["kids"]) if not isinstance(k, str)]
    while stack:
        n = stack.pop()
        below.append(n)
        stack += [k for k in reversed(n["kids"]) if not isinstance(k, str)]
    best = max(below, key=lambda n: n["sum"], default=None)
    text = lambda n: [x for k in n["kids"] for x in ([k] if isinstance(k, str) else text(k))]
    if best is None or not best["sum"]:
        return text(body)
    runs = [[]]  # neighbouring text blocks directly in the body
    for k in body["kids"]:
        if isinstance(k, str):
            continue
        if k["name"] in html_extract._TEXT:
            runs[-1].append(k)
        elif k["name"] in html_extract._BLOCK:
            runs.append([])
    flat = max((x for x in runs if len(x) > 1), key=lambda x: sum(k["d"] for k in x), default=[])
    if flat and sum(k["d"] for k in flat) > best["sum"]:
        return [x for n in flat for x in text(n)]
    path, n = [], best
    while n is not body:
        path.append(n)
        n = n["up"]
    least = min(x["d"] for x in path)
    chosen = [best] + [n for n in below if n["up"] is not best and any(n["up"] is x for x in [*path, body]) and not any(n is x for x in path) and n["d"] >= least and n["sum"] > n["d"] * (1 + 1e-9)]
    return [x for n in below if any(n is x for x in chosen) for x in text(n)]


def random_page(r):
    def block(depth):
        kind = r.random()
        if depth > 3 or kind < 0.35:
            return f"<p>{words(r, r.randrange(0, 40))}</p>"
        if kind < 0.6:
            return "<ul>" + "".join(f"<li><a href='/{i}'>{words(r, 2)}</a></li>" for i in range(r.randrange(1, 6))) + "</ul>"
        return "<div>" + "".join(block(depth + 1) for _ in range(r.randrange(1, 5))) + "</div>"

    return f"<html><head><title>t</title><style>p {{}}</style></head><body>{''.join(block(0) for _ in range(r.randrange(1, 6)))}<script>var x = '<p>no</p>';</script></body></html>"


def test_html_against_another_parser():
    r = random.Random(11)
    for _ in range(150):
        page = random_page(r)
        assert " ".join(html_extract.content(page).split()) == " ".join(" ".join(plain_content(page)).split())


def test_html_content_is_found():
    article = "".join(f"<p>{words(random.Random(i), 60)}.</p>" for i in range(5))
    page = f"<html><body><nav>{''.join(f'<a href=/{i}>menu item {i}</a>' for i in range(30))}</nav><div id=main><h1>Title of it</h1>{article}</div><footer><a href=/>imprint</a> all rights</footer></body></html>"
    got = html_extract.content(page)
    assert "menu item" not in got and "imprint" not in got
    assert got.count("\n") >= 4 and all(words(random.Random(i), 60) in got for i in range(5))


@pytest.mark.parametrize("page, want", [("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<div><p>x &amp; y</p></div></p></b>", "x & y"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<script>a<b</script>", ""), ("<p title='>'>q</p>", "q"), ("a < b", "a < b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3")])
def test_html_is_read_leniently(page, want):
    assert html_extract.content(page) == want


def test_a_flat_page_keeps_its_paragraphs():
    own = [words(random.Random(i), n) for i, n in enumerate((60, 84, 82, 84, 30))]
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>menu item {i}</a></li>" for i in range(12)) + "</ul>"
    page = f"<html><body>{menu}<h1>Title of it</h1>{''.join(f'<p>{x}</p>' for x in own)}<div><a href='/'>imprint</a></div></body></html>"
    assert html_extract.content(page) == "\n".join(["Title of it", *own])


N = 1_000_000


@pytest.mark.parametrize("name, page", [
    ("nested", "<div>" * (N // 11) + "deep" + "</div>" * (N // 11)), ("nested paragraphs", "<div><p>x" * (N // 9)), ("unmatched ends", "<div>" * (N // 10) + "</p>" * (N // 10) + "y"), ("unmatched kinds", "".join(f"<x{i % 999}>" for i in range(N // 12)) + "</q>" * (N // 12)),
    ("flat", "<body>" + "<p>one two three four</p>" * (N // 25)), ("branches", "<body>" + "<div><p>one two</p><p>three <b>four</b></p></div>" * (N // 47)), ("list", "<ul>" + "<li>one" * (N // 7)), ("lists in lists", "<ul><li>a" * (N // 9)), ("tables", "<table><tr><td>x" * (N // 16)), ("inline", "<p>" + "<b>x " * (N // 5)),
])
def test_html_takes_time_as_its_length(name, page):
    began = time.perf_counter()
    html_extract.content(page)
    assert time.perf_counter() - began < 12  # 3 s on an idle core


def test_html_odd_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, None, ""), (3, None, "<p>x</p>"), (3, None, "<p>x</p>"), (None, None, "<p>y"), (4, None, f"<p>{LONG}</p>"), (5, None, deep), (6, None, "<" * 20_000), (7, None, "<a " + "b='" * 5000)]
    df = with_clashes(pages(spark, rows))
    got = html_extract.extract(df).collect()
    want = Counter((i, None if h is None else html_extract.content(h)) for i, _, h in rows)
    assert Counter((r["page_id"], r["text"]) for r in got) == want and want[(5, "deep")] == 1
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_texts(seed):
    r = random.Random(seed)
    pool = ["a", "Z", "é", "日", "1", "½", " ", "  ", "\n", "\r\n", "\t", " ", " ", "'", "'s", "'ll", "'re", "'x", "!", "...", "😀", "<|endoftext|>", "​", "́", "_", "word", " the", "\u0085", "\u001c"]
    return TEXTS + ["".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(400)] + ["a" * 3000, " " * 700, "ab" * 900, "1" * 700 + "'s" * 300, words(r, 3000)]


@needs_tokenizers
def test_bpe_is_the_tokenizers(encoding):
    v, texts = byte_bpe.load(BPE), bpe_texts(1)
    counts, ids, offsets = v.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts.tolist()):
        own, begins = ids[at : at + n].tolist(), offsets[at : at + n].tolist()
        assert own == encoding.encode_ordinary(text), repr(text)
        lengths = [len(encoding.decode_single_token_bytes(i)) for i in own]
        assert begins == [sum(lengths[:k]) for k in range(n)] if n < 500 else begins[-1] == sum(lengths[:-1])
        at += n


@needs_tokenizers
def test_both_merges_are_one(encoding):
    v, r = byte_bpe.load(BPE), random.Random(5)
    some = ["".join(r.choice("abcdefé日 ") for _ in range(r.randrange(1, 64))).encode() for _ in range(200)]
    assert v.merge_all(some) == [v._merge_long(w) for w in some]


@needs_tokenizers
def test_bpe_round_trip(spark):
    rows = ODD + list(enumerate(bpe_texts(2), 100))
    df = with_clashes(docs(spark, rows))
    coded = byte_bpe.encode(df, BPE)
    assert multiset(byte_bpe.decode(coded, BPE).collect()) == Counter(rows)
    assert all(r["n_tokens"] is None if r["ids"] is None else r["n_tokens"] == len(r["ids"]) == len(r["offsets"]) for r in coded.collect())
    assert byte_bpe.encode(df.limit(0), BPE).count() == 0 and byte_bpe.decode(coded.limit(0), BPE).count() == 0


@needs_tokenizers
def test_the_query_decodes_every_row(spark, sf_dir):
    got = queries.op7_byte_bpe(spark, sf_dir).select("doc_id", "decoded")
    assert multiset(got.collect()) == multiset(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


@needs_tokenizers
def test_the_query_decodes_where_it_encodes(spark, sf_dir):
    plan = queries.op7_byte_bpe(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # a second one would hold the vocabulary once more in each task
    rows = ODD + list(enumerate(bpe_texts(4), 100))
    df = with_clashes(docs(spark, rows))
    got = byte_bpe.encode(df, BPE, decoded=True)
    assert multiset(got.select("doc_id", "decoded").collect()) == Counter(rows)
    assert multiset(got.drop("decoded").collect()) == multiset(byte_bpe.encode(df, BPE).collect())
    assert byte_bpe.encode(df.limit(0), BPE, decoded=True).count() == 0


@needs_tokenizers
def test_what_is_remembered_takes_no_more_memory(encoding):
    v, r = byte_bpe.load.__wrapped__(BPE), random.Random(6)
    texts = pa.array([" ".join("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(100)) for _ in range(1500)])
    v.encode(texts[:10])
    tracemalloc.start()
    for at in range(0, len(texts), 100):
        v.encode(texts[at : at + 100])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 5_000_000  # 150 000 words; 44 MB as lists by word


@needs_tokenizers
@pytest.mark.parametrize("change", [{"SLOT_BITS": 4}, {"REMEMBERED": 30}, {"REMEMBERED_ALL": 100}, {"CHUNK_BYTES": 50}, {}])
def test_what_is_remembered_changes_no_id(encoding, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(byte_bpe, name, value)
    if not change:  # as if unequal words had one hash
        hashes = Chunk.hashes
        monkeypatch.setattr(Chunk, "hashes", lambda *a: hashes(*a) & np.uint64(3))
    v, texts = byte_bpe.load.__wrapped__(BPE), bpe_texts(7)
    for part in (texts[:200], texts, [], ["", None], texts[::-1]):
        counts, ids, _ = v.encode(pa.array(part, pa.string()))
        cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [encoding.encode_ordinary(t or "") for t in part]
        missing = np.array([t is None for t in part], bool)
        assert v.texts(ids, np.array(cuts), missing).to_pylist() == part


def test_slices_decode_by_their_offsets(spark):
    text = "One naïve café, 日本語 and more words. " * 20
    r = byte_bpe.encode(docs(spark, [(1, text)]), BPE).first()
    v = byte_bpe.load(BPE)
    for a, b in ((0, 5), (7, 30), (40, len(r["ids"]) - 1)):
        assert v.decode(np.array(r["ids"][a:b])) == text.encode()[r["offsets"][a] : r["offsets"][b]]
    cut = docs(spark, []).sparkSession.createDataFrame([(1, [v.ranks["日".encode()[:1]] if "日".encode()[:1] in v.ranks else 0])], "doc_id bigint, ids array<int>")
    assert "�" in byte_bpe.decode(cut, BPE).first()["text"]
    with pytest.raises(ValueError):
        v.decode(np.array([10**6]))


# fingerprints


def plain_fingerprint(text):
    total = [0] * fingerprints.LANES
    for line in text.split("\n"):
        line = line.strip(" \t\v\f\r")
        if line:
            seed = sha256(line.encode()).hexdigest()
            raw = b"".join(sha256(f"{seed}{k}".encode()).digest() for k in range(fingerprints.LANES // 8))
            total = [(t + int.from_bytes(raw[4 * i : 4 * i + 4], "big")) % 2**32 for i, t in enumerate(total)]
    return "".join(f"{t:08x}" for t in total)


def test_fingerprints(spark):
    rows = ODD + [(30, "b\na\n\n a "), (31, "a\r\na\nb"), (32, "a\nb")]
    df = with_clashes(docs(spark, rows))
    got = fingerprints.equal_groups(df).collect()
    prints = [(i, None if t is None else plain_fingerprint(t)) for i, t in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter(prints)
    groups = defaultdict(list)
    for i, p in prints:
        groups[p].append(i)
    for r in got:
        own = groups[r["fingerprint"]]
        want = (None, None) if r["fingerprint"] is None else (len(own), min([i for i in own if i is not None], default=None))
        assert (r["copies"], r["first_doc_id"]) == want
    by = {r["doc_id"]: r for r in got}
    assert by[30]["fingerprint"] == by[31]["fingerprint"] != by[32]["fingerprint"]
    assert fingerprints.equal_groups(df.limit(0)).count() == 0


def test_fingerprints_are_incremental():
    r = random.Random(1)
    lines = [words(r, 5) for _ in range(30)]
    whole = fingerprints.fingerprint("\n".join(lines))
    r.shuffle(lines)
    assert fingerprints.fingerprint("\n".join(lines)) == whole
    part = fingerprints.fingerprint("\n".join(lines[:20]))
    assert fingerprints.combine(part, added=lines[20:]) == whole
    assert fingerprints.combine(whole, removed=lines[20:]) == part
    assert fingerprints.combine(whole, ["x"], ["x"]) == whole


def test_clashing_names_are_many():
    assert len(CLASHES) == len(set(CLASHES)) > 50
